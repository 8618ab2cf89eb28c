"""Result drift: Population Stability Index of result columns against a baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriscope import constants as K
from veriscope.functions import psi as P
from veriscope.operators.lookup import lookup_join, measured
from veriscope.operators.ordering import percentiles_of_counts, value_counts
from veriscope.session import written

_DECILES = [i / K.PSI_BUCKETS for i in range(K.PSI_BUCKETS + 1)]


def metric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are metrics by name (schema metadata only)."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType)
        and P.is_metric_name(f.name)
        and f.name not in exclude
    ]


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column_name, value): one row per metric value, nulls left out."""
    cells = F.array(
        *[F.struct(F.lit(c.lower()).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]
    )
    return (
        df.select(*keys, F.explode(cells).alias("cell"))
        .select(*keys, F.col("cell.name").alias("column_name"), F.col("cell.v").alias("value"))
        .filter(F.col("value").isNotNull())
    )


def psi_baseline(values: DataFrame) -> DataFrame:
    """Baseline per (agent_type, column_name) from (agent_type, column_name, value).

    Equal-frequency edges from exact deciles, expected share per bucket. Columns
    with too few values, or with one distinct decile, get no baseline.
    """
    keys = ["agent_type", "column_name"]
    counts = written(value_counts(values, keys, "value"))
    edges = (
        percentiles_of_counts(counts, keys, "value", _DECILES)
        .filter(F.col("sample_count") >= K.PSI_MIN_SAMPLES)
        .withColumn("bucket_edges", F.array_sort(F.array_distinct("percentiles")))
        .filter(F.size("bucket_edges") >= 2)
        .select(*keys, "bucket_edges", "sample_count")
    )
    edges = measured(edges)
    # counts alone are aggregated; the edge arrays are joined on afterwards
    filled = (
        counts.join(edges, keys)
        .withColumn("bucket", P.bucket_of(F.col("value"), F.col("bucket_edges")))
        .filter("bucket >= 0")
        .groupBy(*keys, "bucket")
        .agg(F.sum("n").alias("n"))
        .groupBy(*keys)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("found"),
            F.sum("n").alias("total"),
        )
        .join(edges, keys)
    )
    expected = F.transform(
        F.sequence(F.lit(0), F.size("bucket_edges") - 2),
        lambda i: F.coalesce(F.try_element_at(F.col("found"), i), F.lit(0)) / F.col("total"),
    )
    return filled.select(*keys, "bucket_edges", expected.alias("expected_pct"), "sample_count")


def pooled_values(tables: Sequence[DataFrame], agent: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Metric values of several tables, same-named columns pooled."""
    pooled = None
    for table in tables:
        part = to_long(table.withColumn("agent_type", F.lit(agent)), ["agent_type"],
                       metric_columns(table, exclude))
        pooled = part if pooled is None else pooled.unionByName(part)
    return pooled


def column_psi(values: DataFrame, baseline: DataFrame, max_buckets: int = K.PSI_BUCKETS) -> DataFrame:
    """PSI per (query_id, agent_type, column_name), rounded to 4 digits.

    Rows are reduced to at most one count per query, column and bucket before
    the shuffle. A stored baseline with more buckets than usual needs `max_buckets`.
    """
    keys = ["query_id", "agent_type", "column_name"]
    on = ["agent_type", "column_name"]
    # the name rule is applied to the few baseline columns, not to every value
    known = measured(baseline.filter(P.is_metric_column(F.col("column_name"))))
    counted = (
        values.join(known.select(*on, "bucket_edges"), on)
        .select(*keys, P.bucket_of(F.col("value"), F.col("bucket_edges"), max_buckets).alias("bucket"))
        .groupBy(*keys, "bucket")
        .agg(F.count("*").alias("n"))
        .groupBy(*keys)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("found"),
            F.sum("n").alias("value_count"),
            F.coalesce(F.sum(F.when(F.col("bucket") >= 0, F.col("n"))), F.lit(0)).alias("in_range"),
        )
        .join(known.select(*on, "expected_pct", F.size("expected_pct").alias("buckets")), on)
    )
    shared = counted.withColumn("share", P.shares(F.col("found"), F.col("in_range"), F.col("buckets")))
    psi = F.round(P.stability_index(F.col("expected_pct"), F.col("share")), K.PSI_DIGITS)
    return shared.select(*keys, psi.alias("psi"), "value_count")


def column_psi_of_rows(
    rows: DataFrame, columns: Sequence[str], baseline: DataFrame, max_buckets: int = K.PSI_BUCKETS
) -> DataFrame:
    """As `column_psi`, from wide rows (query_id, agent_type, columns): PSI of the columns that the agent's baseline knows.

    A row meets its agent's edges once, whatever the number of columns, and adds to one counter per column and bucket,
    combined before the shuffle; values are never turned into rows of their own. Null values count nowhere.
    """
    keys = ["query_id", "agent_type"]
    names = [c.lower() for c in columns]
    known = baseline.filter(P.is_metric_column(F.col("column_name")) & F.col("column_name").isin(names))
    of = lambda i, field: F.first(F.when(F.col("column_name") == names[i], F.col(field)), ignorenulls=True)
    size = range(len(names))
    agents = measured(known.groupBy("agent_type").agg(
        *[of(i, "bucket_edges").alias(f"e{i}") for i in size], *[of(i, "expected_pct").alias(f"x{i}") for i in size]
    ))
    met = rows.select(*keys, *[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).join(
        agents.select("agent_type", *[f"e{i}" for i in size]), ["agent_type"]
    )
    bucket = lambda i: P.bucket_of(F.col(f"v{i}"), F.col(f"e{i}"), max_buckets, several=True)
    placed = met.select(*keys, *[
        F.when(F.col(f"v{i}").isNotNull() & F.col(f"e{i}").isNotNull(), bucket(i)).alias(f"b{i}") for i in size
    ])
    counted = placed.groupBy(*keys).agg(
        *[F.count(f"b{i}").alias(f"n{i}") for i in size],
        *[F.count_if(F.col(f"b{i}") == b).alias(f"c{i}_{b}") for i in size for b in range(max_buckets)],
    ).join(agents, ["agent_type"])
    places = F.array(*[F.lit(b) for b in range(max_buckets)])
    cells = F.array(*[
        F.struct(
            F.lit(names[i]).alias("column_name"), F.col(f"n{i}").alias("value_count"), F.col(f"x{i}").alias("expected_pct"),
            F.map_from_arrays(places, F.array(*[F.col(f"c{i}_{b}") for b in range(max_buckets)])).alias("found"),
            sum((F.col(f"c{i}_{b}") for b in range(max_buckets)), F.lit(0)).alias("in_range"),
        )
        for i in size
    ])
    shared = counted.select(*keys, F.inline(cells)).filter("value_count > 0").withColumn("buckets", F.size("expected_pct"))
    shared = shared.withColumn("share", P.shares(F.col("found"), F.col("in_range"), F.col("buckets")))
    psi = F.round(P.stability_index(F.col("expected_pct"), F.col("share")), K.PSI_DIGITS)
    return shared.select(*keys, "column_name", psi.alias("psi"), "value_count")


def overall_psi(by_column: DataFrame) -> DataFrame:
    """One row per query: highest column PSI, class, anomaly flag."""
    scored = by_column.groupBy("query_id", "agent_type").agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", "psi"))).alias("psi_scores")
    ).withColumns(
        {
            "overall_psi": F.array_max(F.map_values("psi_scores")),
            "columns_analyzed": F.size("psi_scores"),
        }
    )
    return scored.withColumns(
        {
            "drift_classification": P.psi_class(F.col("overall_psi")),
            "is_anomaly": F.col("overall_psi") >= K.PSI_HIGH,
        }
    )


def score_result_drift(queries: DataFrame, values: DataFrame | None, baseline: DataFrame, by_column: DataFrame | None = None) -> DataFrame:
    """Every query with its PSI or the reason for skipping it.

    `queries` has (query_id, agent_type, row_count, is_aggregate). Skip states,
    in order: aggregate_query, empty_result, no_baseline, no_numeric_data; they
    score 0 and are not stored. The PSI per column comes from long `values`, or is given as `by_column`.
    """
    scored = overall_psi(column_psi(values, baseline) if by_column is None else by_column)
    known = baseline.select("agent_type").distinct().withColumn("__known", F.lit(True))
    joined = lookup_join(queries, known, ["agent_type"]).join(
        scored, ["query_id", "agent_type"], "left"
    )
    skip = (
        F.when(F.col("is_aggregate"), "aggregate_query")
        .when(F.coalesce("row_count", F.lit(0)) == 0, "empty_result")
        .when(F.col("__known").isNull(), "no_baseline")
        .when(F.col("overall_psi").isNull(), "no_numeric_data")
    )
    live = F.col("__skip").isNull()
    return (
        joined.withColumn("__skip", skip)
        .withColumns(
            {
                "overall_psi": F.when(live, F.col("overall_psi")).otherwise(0.0),
                "drift_classification": F.coalesce("__skip", "drift_classification"),
                "is_anomaly": live & F.col("is_anomaly"),
                "columns_analyzed": F.when(live, F.col("columns_analyzed")).otherwise(0),
                "stored": live,
            }
        )
        .drop("__skip", "__known", "psi_scores")
    )


def preferred_baseline(sources: Sequence[DataFrame]) -> DataFrame:
    """Baseline columns of the first source that knows the agent.

    Order of preference: stored baseline, whole tables, expected-output samples.
    """
    tagged = None
    for priority, source in enumerate(sources):
        part = source.withColumn("__priority", F.lit(priority))
        tagged = part if tagged is None else tagged.unionByName(part)
    best = tagged.groupBy("agent_type").agg(F.min("__priority").alias("__priority"))
    return tagged.join(best, ["agent_type", "__priority"]).drop("__priority")
