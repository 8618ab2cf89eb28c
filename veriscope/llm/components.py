"""Connected components by alternating large-star and small-star steps (union-find at table scale)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.llm.shared import staged


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b: long) to (id, root): the least id of its component for every node on an edge.

    Both steps keep the components and only hang nodes below smaller ones, until every node hangs
    directly below its least node. Each round is a written table, so nothing is gathered and a lost
    executor costs one round; the number of rounds grows with the logarithm of the longest chain.
    Loops and repeated edges are allowed; no edge gives no row.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = None
    while True:
        sym = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: larger neighbours move below the least of the neighbourhood
        up = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: smaller neighbours and the node itself move below the least of them
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = staged(small.union(below).distinct(), "components")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
        pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )
