"""Ranks, latest rows and exact quantiles that hold when one key dominates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriscope.operators.lookup import measured
from veriscope.session import written

_SEQ, _PART, _TIE = "__seq", "__part", "__tie"


def rank_within(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], rank: str = "rank",
    equal_rows: bool = False,
) -> DataFrame:
    """1-based row number per key without gathering a key in one task.

    A range sort spreads every key, however large, over many partitions. Row
    ids of the sorted, written rows are consecutive inside a partition,
    so only one small row per key and partition is needed to turn them into
    ranks. `order_by` must be a total order for a repeatable result; say
    `equal_rows` when rows that tie are equal in every column, so that masses of
    them are spread over partitions as well.
    """
    source = df.withColumn(_TIE, F.monotonically_increasing_id()) if equal_rows else df
    ties = [_TIE] if equal_rows else []
    ordered = written(
        source.orderBy(*keys, *order_by, *ties)
        .drop(*ties)
        .withColumn(_SEQ, F.monotonically_increasing_id())
        .withColumn(_PART, F.shiftright(_SEQ, 33))
    )
    runs = ordered.groupBy(*keys, _PART).agg(
        F.min(_SEQ).alias("__first"), F.count("*").alias("__n")
    )
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    names = [*keys, _PART]
    offsets = runs.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(names)],
        (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__shift"),
    )
    same = F.lit(True)
    for i, k in enumerate(names):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = ordered.join(offsets, same)
    return joined.select(*df.columns, (F.col(_SEQ) + F.col("__shift")).alias(rank))


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Row with the greatest `order_by` per key; combined before the shuffle."""
    return _extreme(df, keys, order_by, F.max_by)


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Row with the least `order_by` per key (first row wins)."""
    return _extreme(df, keys, order_by, F.min_by)


def _extreme(df: DataFrame, keys, order_by, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    order = F.struct(*order_by) if len(order_by) > 1 else F.col(order_by[0])
    return df.groupBy(*keys).agg(pick(row, order).alias("__row")).select(*keys, "__row.*").select(
        *df.columns
    )


def top_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First n rows per key; Spark applies the limit before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def rolling_last_n(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    value: str,
    n: int,
    out: str,
    block: int = 100_000,
) -> DataFrame:
    """Mean of the last n rows at each row.

    A key is cut in blocks of consecutive ranks; each block also receives the
    n - 1 rows before it, so a dominant key is averaged by many tasks.
    """
    block = max(block, n)
    ranked = rank_within(df, keys, [F.col(c) for c in order_by], "__rank")
    own = F.floor((F.col("__rank") - 1) / block)
    tail = (F.col("__rank") - 1) % block >= block - (n - 1)
    copies = ranked.withColumn(
        "__copy",
        F.explode(
            F.when(
                tail,
                F.array(
                    F.struct(own.alias("block"), F.lit(True).alias("own")),
                    F.struct((own + 1).alias("block"), F.lit(False).alias("own")),
                ),
            ).otherwise(F.array(F.struct(own.alias("block"), F.lit(True).alias("own"))))
        ),
    ).withColumns({"__block": F.col("__copy.block"), "__own": F.col("__copy.own")})
    w = Window.partitionBy(*keys, "__block").orderBy("__rank").rowsBetween(-(n - 1), 0)
    return (
        copies.withColumn(out, F.avg(value).over(w))
        .filter("__own")
        .drop("__copy", "__block", "__own", "__rank")
    )


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]
) -> DataFrame:
    """Linear-interpolated percentiles per key: (keys, sample_count, percentiles).

    Works on distinct values with their counts (see `percentiles_of_counts`). Null values take no part.
    """
    counts = written(value_counts(df, keys, value))
    return percentiles_of_counts(counts, keys, value, probabilities)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias(value))
        .agg(F.count("*").alias("n"))
    )


def percentiles_of_counts(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    cells: int = 4096,
    ordered: int = 1 << 18,
) -> DataFrame:
    """As `exact_percentiles`, from materialised (keys, value, n) rows with distinct values.

    Ranks are found by refining histograms. Values of a range are counted in `cells` cells, combined before the shuffle;
    running counts over the cells tell which of them hold wanted ranks, and only their values go on, each
    cell a range of its own. A range with at most `ordered` distinct values is ordered. So no task ever orders
    more than `ordered` rows of a key, whatever the key's share of all rows is, and the way is the same at every size:
    a range of d distinct values takes about log(d / ordered) / log(cells) rounds. Cells are equally wide and, in every
    second round, equally wide on a log scale, for values that differ by orders of magnitude.
    """
    keys = list(keys)
    group = [*keys, "__range"]
    rows = counts.withColumn("__range", F.lit(""))
    ranges = measured(
        rows.groupBy(*group).agg(F.sum("n").alias("__total"), *_extent(value))
        .withColumns({"__ranks": _wanted_ranks(probabilities), "__before": F.lit(0).cast("long")})
    )
    totals = ranges.select(*keys, F.col("__total").alias("sample_count"))
    ranges, found, step = ranges.drop("__total"), None, 0
    while True:
        part = _ranks_in_order(rows, ranges.filter(F.col("__distinct") <= ordered), keys, value)
        found = part if found is None else found.unionByName(part)
        wide = ranges.filter(F.col("__distinct") > ordered)
        if wide.isEmpty():
            break
        rows, ranges = _refined(rows, wide, keys, value, cells, step)
        step += 1
    at = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", value))).alias("__at"))
    at = join_equal(totals, at, keys)

    def interpolate(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("sample_count") - 1)
        low = F.element_at("__at", F.floor(place).cast("long"))
        high = F.element_at("__at", F.ceil(place).cast("long"))
        return F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))

    return at.select(
        *keys, "sample_count", F.array(*[interpolate(p) for p in probabilities]).alias("percentiles")
    )


def join_equal(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, nulls equal; the names stay once, those of the left side."""
    renamed = right.withColumnsRenamed({n: f"__r_{i}" for i, n in enumerate(names)})
    same = F.lit(True)
    for i, n in enumerate(names):
        same = same & F.col(n).eqNullSafe(F.col(f"__r_{i}"))
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{i}" for i in range(len(names))])


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def _extent(value: str) -> list[Column]:
    """Distinct values and the least and greatest finite one."""
    finite = F.when(_finite(F.col(value)), F.col(value))
    return [F.count("*").alias("__distinct"), F.min(finite).alias("__low"), F.max(finite).alias("__high")]


def _cell(value: Column, low: Column, high: Column, cells: int, step: int) -> Column:
    """Cell of a value of a range: never falls as the value rises; the range's ends lie in the first and the last."""
    if step % 2 == 0:
        # halves, so that the width of a range does not overflow
        share = (value / 2 - low / 2) / (high / 2 - low / 2)
    else:
        above = (F.log(value) - F.log(low)) / (F.log(high) - F.log(low))
        below = 1 - (F.log(-value) - F.log(-high)) / (F.log(-low) - F.log(-high))
        # a range on both sides of zero is cut there first
        sides = F.when(value < 0, 0.0).when(value == 0, 0.5).otherwise(1.0)
        share = F.when(low > 0, above).when(high < 0, below).otherwise(sides)
    inner = F.least(F.greatest(F.floor(F.nanvl(F.coalesce(share, F.lit(0.0)), F.lit(0.0)) * (cells - 1)), F.lit(0)), F.lit(cells - 1))
    return (
        F.when(F.isnan(value), cells + 1).when(value == float("inf"), cells).when(value == float("-inf"), -1)
        .when(value >= high, cells - 1).otherwise(inner).cast("long")
    )


def _refined(rows, wide, keys, value, cells, step) -> tuple[DataFrame, DataFrame]:
    """Values and ranges of the cells of wide ranges that hold wanted ranks."""
    group = [*keys, "__range"]
    cell = _cell(F.col(value), F.col("__low"), F.col("__high"), cells, step)
    placed = join_equal(rows, wide.select(*group, "__low", "__high"), group).select(*group, value, "n", cell.alias("__cell"))
    before = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    filled = placed.groupBy(*group, "__cell").agg(F.sum("n").alias("__n"), *_extent(value)).withColumn(
        "__sum", F.coalesce(F.sum("__n").over(before), F.lit(0))  # at most `cells` + 3 rows a range
    )
    start = F.col("__before") + F.col("__sum")
    inside = F.filter("__ranks", lambda r: (r >= start) & (r < start + F.col("__n")))
    name = F.concat_ws(".", "__range", F.col("__cell").cast("string"))
    chosen = measured(
        join_equal(filled, wide.select(*group, "__before", "__ranks"), group)
        .withColumns({"__inside": inside, "__next": name}).filter(F.size("__inside") > 0)
        .select(*group, "__cell", "__next", "__distinct", "__low", "__high", start.alias("__start"), "__inside")
    )
    kept = join_equal(placed, chosen.select(*group, "__cell", "__next"), [*group, "__cell"])
    rows = written(kept.select(*keys, F.col("__next").alias("__range"), value, "n"))
    ranges = chosen.select(
        *keys, F.col("__next").alias("__range"), "__distinct", "__low", "__high",
        F.col("__start").alias("__before"), F.col("__inside").alias("__ranks"),
    )
    return rows, ranges


def _wanted_ranks(probabilities: Sequence[float]) -> Column:
    """0-based ranks on both sides of each percentile of `__total` values."""
    places = [F.lit(float(p)) * (F.col("__total") - 1) for p in probabilities]
    return F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))


def _explode_held(df: DataFrame) -> DataFrame:
    """Rows that hold wanted ranks, one per rank; `__end` is the running count."""
    start = F.col("__end") - F.col("n")
    # values that occur once, usually nearly all, are tested without a lambda
    single = F.array_contains("__ranks", start)
    several = F.exists("__ranks", lambda r: (r >= start) & (r < F.col("__end")))
    held = F.filter("__ranks", lambda r: (r >= start) & (r < F.col("__end")))
    holders = df.filter(F.when(F.col("n") == 1, single).otherwise(several))
    return holders.withColumn("__rank", F.explode(held))


def _ranks_in_order(rows, ranges, keys, value) -> DataFrame:
    """(keys, rank, value) of the wanted ranks of ranges that are small enough to be ordered."""
    group = [*keys, "__range"]
    small = join_equal(rows, ranges.select(*group, "__before", "__ranks"), group)
    running = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _explode_held(small.withColumn("__end", F.col("__before") + F.sum("n").over(running))).select(*keys, "__rank", value)
