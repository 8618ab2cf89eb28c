"""Items that occur together in baskets, above a minimum support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.session import written

#: Items per block of a long basket; hash cells that pairs are first counted in (bounds what is broadcast).
BLOCK, CELLS = 256, 1 << 20


def _units(items: DataFrame, block: int) -> DataFrame:
    """(basket, lo, hi, left, right): every pair of items of a basket lies in exactly one unit.

    A basket of up to `block` items is one unit. A longer one is cut into blocks by the items' hash and has a unit for
    each two of its blocks (and each one with itself), so no task holds a long basket and units are of one size.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    long_baskets = items.groupBy("basket").agg(F.count("*").alias("size")).filter(F.col("size") > block).select("basket", blocks.alias("blocks"))
    dealt = (
        items.join(written(long_baskets), ["basket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    )
    return dealt.groupBy("basket", "lo", "hi").agg(
        F.collect_list(F.when(F.col("own") == F.col("lo"), F.col("item"))).alias("left"),
        F.collect_list(F.when((F.col("own") == F.col("hi")) & (F.col("lo") < F.col("hi")), F.col("item"))).alias("right"),
    )


def _pairs(units: DataFrame) -> DataFrame:
    """(part, other) once per basket that holds both, part before other."""
    right = F.when(F.col("lo") < F.col("hi"), F.col("right")).otherwise(F.col("left"))
    met = units.select("lo", "hi", F.explode("left").alias("x"), right.alias("ys")).select("lo", "hi", "x", F.explode("ys").alias("y"))
    return met.filter((F.col("lo") < F.col("hi")) | (F.col("x") < F.col("y"))).select(
        F.least("x", "y").alias("part"), F.greatest("x", "y").alias("other")
    )


def frequent_pairs(
    items: DataFrame, basket: Column, item: Column, *, min_support: int, block: int = BLOCK, cells: int = CELLS
) -> DataFrame:
    """(part, other, orders, part_orders, other_orders) of all pairs that at least `min_support` baskets hold, part < other.

    Nothing is cut: a pair below the support is no row by definition. An item counts once per basket; rows without a
    basket or an item count nowhere. Infrequent items go first, since no pair of theirs can be frequent; then pairs are
    counted in `cells` hash cells, and only those in cells that reach the support are counted one by one.
    """
    seen = items.select(basket.alias("basket"), item.alias("item")).dropna().distinct()
    per_item = written(seen.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= min_support))
    units = written(_units(seen.join(per_item.select("item"), ["item"], "left_semi"), block))
    cell = F.pmod(F.xxhash64("part", "other"), F.lit(cells)).cast("int")
    pairs = _pairs(units).withColumn("cell", cell)
    full = written(pairs.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") >= min_support).select("cell"))
    counted = (
        pairs.join(F.broadcast(full), ["cell"], "left_semi")  # at most `cells` rows
        .groupBy("part", "other").agg(F.count("*").alias("orders")).filter(F.col("orders") >= min_support)
    )
    first = per_item.select(F.col("item").alias("part"), F.col("n").alias("part_orders"))
    second = per_item.select(F.col("item").alias("other"), F.col("n").alias("other_orders"))
    return counted.join(first, ["part"]).join(second, ["other"]).select("part", "other", "orders", "part_orders", "other_orders")
