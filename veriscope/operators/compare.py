"""Result-set comparison, for many pairs of results at once.

Actual and expected rows are frames with the same key columns (for example
query_id); all rows of a key form one result set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriscope import constants as K
from veriscope.functions import values as V
from veriscope.functions.values import is_number
from veriscope.operators.lookup import measured
from veriscope.operators.ordering import join_equal, rank_within, top_per_key


def _name(column: str) -> str:
    return column.lower().strip()


def schemas_match(left: Sequence[str], right: Sequence[str]) -> bool:
    """Equal column names, or one side a subset of the other (metadata only)."""
    a, b = {_name(c) for c in left}, {_name(c) for c in right}
    return a <= b or b <= a


def schemas_match_column(left: Column, right: Column) -> Column:
    """The same rule for stored column lists."""
    def names(c: Column) -> Column:
        return F.array_distinct(F.transform(c, lambda n: F.lower(F.trim(n))))

    a, b = names(left), names(right)
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def _typed(df: DataFrame, skip: Sequence[str]) -> list[tuple[str, T.DataType]]:
    return [(f.name, f.dataType) for f in df.schema.fields if f.name not in skip]


def _paired(
    actual: DataFrame,
    expected: DataFrame,
    keys: Sequence[str],
    position: str,
    left: list[tuple[str, T.DataType]],
    right: list[tuple[str, T.DataType]],
) -> DataFrame:
    """Matching rows per key when both sides are read in `position` order."""
    a = actual.select(*keys, position, *[F.col(n).alias(f"a{i}") for i, (n, _) in enumerate(left)])
    b = expected.select(*keys, position, *[F.col(n).alias(f"b{i}") for i, (n, _) in enumerate(right)])
    equal = F.lit(len(left) == len(right))
    if len(left) == len(right):
        for i, ((_, lt), (_, rt)) in enumerate(zip(left, right)):
            equal = equal & V.same_value(F.col(f"a{i}"), lt, F.col(f"b{i}"), rt)
    return join_equal(a, b, [*keys, position]).groupBy(*keys).agg(F.count_if(equal).alias("matched"))


def _fingerprints(
    actual: DataFrame, expected: DataFrame, keys: Sequence[str], left: list[tuple[str, T.DataType]], right: list[tuple[str, T.DataType]],
) -> DataFrame:
    """(keys, rows_actual, rows_expected, same): `same` says that both sides hold the same rows, however they are ordered.

    A side's fingerprint is its number of rows and two sums of row hashes, combined before the shuffle, so that a result of any size
    is a few numbers. Values are compared exactly; a side with values that equal nothing (NaN, infinities), or columns of
    different kinds, is not said to be the same, which leaves the decision to the line-up of rows.
    """
    alike = len(left) == len(right) and all(
        is_number(lt) and is_number(rt) or type(lt) is type(rt) for (_, lt), (_, rt) in zip(left, right, strict=True)
    ) and not any(isinstance(t, T.MapType) for _, t in left)

    def side(df: DataFrame, columns: list[tuple[str, T.DataType]], sign: int) -> DataFrame:
        values = [F.col(n).cast("double") + 0.0 if is_number(t) else F.col(n) for n, t in columns]
        odd = F.lit(False)
        for v, (_, t) in zip(values, columns, strict=True):
            if is_number(t):
                odd = odd | F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False))
        # hashes pass over nulls, so where they are is hashed as well
        empty = [v.isNull() for v in values]
        hashes = [F.xxhash64(F.lit(seed), *values, *empty).cast("decimal(20,0)") * sign for seed in (1, 2)] if alike else [F.lit(sign).cast("decimal(20,0)")] * 2
        return df.select(*keys, F.lit(sign).alias("__sign"), odd.alias("__odd"), hashes[0].alias("__h1"), hashes[1].alias("__h2"))

    both = side(actual, left, 1).unionByName(side(expected, right, -1))
    counted = both.groupBy(*keys).agg(
        F.count_if(F.col("__sign") > 0).alias("rows_actual"), F.count_if(F.col("__sign") < 0).alias("rows_expected"),
        F.sum("__h1").alias("d1"), F.sum("__h2").alias("d2"), F.bool_or("__odd").alias("odd"),
    )
    equal = F.lit(alike) & (F.col("rows_actual") == F.col("rows_expected")) & (F.col("d1") == 0) & (F.col("d2") == 0) & ~F.col("odd")
    return counted.select(*keys, "rows_actual", "rows_expected", equal.alias("same"))


def match_rate(
    actual: DataFrame,
    expected: DataFrame,
    keys: Sequence[str],
    position: str | None = None,
    columns: tuple[Sequence[str], Sequence[str]] | None = None,
) -> DataFrame:
    """(keys, rows_actual, rows_expected, matched, content_match_rate).

    With `position` rows are compared in that order. Without it results whose fingerprints say that they are the same are
    done; those of equal size that differ are lined up by their sorted values, no others are sorted or
    shuffled. Row counts that differ rate 0, two empty sides rate 1. Null keys are keys like others.
    """
    skip = [*keys, position] if position else list(keys)
    left, right = _typed(actual, skip), _typed(expected, skip)
    if columns:
        lt, rt = dict(left), dict(right)
        left = [(c, lt[c]) for c in columns[0]]
        right = [(c, rt[c]) for c in columns[1]]
    sizes = _fingerprints(actual, expected, keys, left, right)
    if position is None:
        position = "__position"
        sizes = measured(sizes)
        open_keys = sizes.filter((F.col("rows_actual") == F.col("rows_expected")) & ~F.col("same")).select(*keys)

        def lined_up(df: DataFrame, columns: list[tuple[str, T.DataType]]) -> DataFrame:
            rows = join_equal(df.select(*keys, *[n for n, _ in columns]), open_keys, keys, "left_semi")
            return rank_within(rows, keys, V.sort_columns(columns), position, True)

        actual, expected = lined_up(actual, left), lined_up(expected, right)
    else:
        sizes = sizes.withColumn("same", F.lit(False))
    matched = _paired(actual, expected, keys, position, left, right)
    rated = join_equal(sizes, matched, keys, "left").withColumn(
        "matched", F.when(F.col("same"), F.col("rows_actual")).otherwise(F.coalesce("matched", F.lit(0)))
    ).drop("same")
    rate = (
        F.when(F.col("rows_actual") != F.col("rows_expected"), 0.0)
        .when(F.col("rows_actual") == 0, 1.0)
        .otherwise(F.col("matched") / F.col("rows_actual"))
    )
    return rated.withColumn("content_match_rate", rate)


def ladder(rate: Column) -> Column:
    """Score of a content match rate."""
    return F.when(rate >= 0.99, 1.0).when(rate >= 0.95, 0.95).when(rate >= 0.80, 0.80).otherwise(rate)


def compare_results(
    actual: DataFrame, expected: DataFrame, keys: Sequence[str], position: str | None = None
) -> DataFrame:
    """Verdict per key: schema_match, row_count_match, content_match_rate, score, is_match."""
    skip = [*keys, position] if position else list(keys)
    names_a = [n for n, _ in _typed(actual, skip)]
    names_b = [n for n, _ in _typed(expected, skip)]
    if schemas_match(names_a, names_b):
        rated = match_rate(actual, expected, keys, position)
        same = F.col("rows_actual") == F.col("rows_expected")
        rate = F.col("content_match_rate")
        return rated.select(
            *keys,
            F.lit(True).alias("schema_match"),
            same.alias("row_count_match"),
            rate,
            F.when(same, ladder(rate)).otherwise(0.3).alias("score"),
            (same & (rate >= 0.95)).alias("is_match"),
        )
    by_name_a = {_name(n): n for n in reversed(names_a)}
    by_name_b = {_name(n): n for n in reversed(names_b)}
    common = [c for c in (_name(n) for n in names_a) if c in by_name_b]
    if common:
        rated = match_rate(
            actual, expected, keys, None,
            ([by_name_a[c] for c in common], [by_name_b[c] for c in common]),
        )
    else:
        rated = match_rate(actual, expected, keys, None, ([], []))
    same = (F.col("rows_actual") == F.col("rows_expected")) & F.lit(bool(common))
    rate = F.when(same, F.col("content_match_rate")).otherwise(0.0)
    share = len(common) / max(len(names_a), len(names_b), 1)
    return rated.select(
        *keys,
        F.lit(False).alias("schema_match"),
        same.alias("row_count_match"),
        rate.alias("content_match_rate"),
        F.when(same, F.greatest(F.lit(0.1), F.lit(share) * rate)).otherwise(0.1).alias("score"),
        F.lit(False).alias("is_match"),
    )


def set_similarity(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jaccard of the normalised row sets per key; two empty sets give 1."""
    def rows(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, V.normal_row(_typed(df, keys)).alias("row"), F.lit(side).alias("side"))

    both = rows(actual, "a").unionByName(rows(expected, "e"))
    per_row = both.groupBy(*keys, "row").agg(
        F.bool_or(F.col("side") == "a").alias("in_actual"),
        F.bool_or(F.col("side") == "e").alias("in_expected"),
    )
    return per_row.groupBy(*keys).agg(
        (F.count_if(F.col("in_actual") & F.col("in_expected")) / F.count("*")).alias("set_similarity")
    )


def membership_rate(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of expected rows found anywhere in the actual rows; repeated expected rows each count."""
    def rows(df: DataFrame) -> DataFrame:
        return df.select(*keys, V.normal_row(_typed(df, keys)).alias("row"))

    present = rows(actual).groupBy(*keys, "row").agg(F.lit(1).alias("present"))
    wanted = rows(expected).groupBy(*keys, "row").agg(F.count("*").alias("n"))
    on = [wanted[k] == present[k] for k in keys] + [wanted["row"].eqNullSafe(present["row"])]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    joined = wanted.join(present, condition, "left").select(
        *[wanted[k] for k in keys], wanted["n"], present["present"]
    )
    return joined.groupBy(*keys).agg(
        (F.sum(F.when(F.col("present") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias(
            "content_match_rate"
        )
    )


def expected_output_score(schema_match: Column, row_count_match: Column, rate: Column) -> Column:
    return (
        0.20 * F.when(schema_match, 1.0).otherwise(0.0)
        + 0.20 * F.when(row_count_match, 1.0).otherwise(0.5)
        + 0.60 * rate
    )


def expected_output_confidence(score: Column) -> Column:
    return F.when(score >= 0.95, "HIGH").when(score >= 0.75, "MEDIUM").otherwise("LOW")


def match_confidence(similarity: Column) -> Column:
    """Confidence in a reference pair when its output has to be recomputed."""
    return F.when(similarity >= 0.90, "HIGH").when(similarity >= 0.75, "MEDIUM").otherwise("LOW")


def weigh(score: Column, confidence: Column) -> Column:
    return score * F.when(confidence == "MEDIUM", 0.8).when(confidence == "LOW", 0.5).otherwise(1.0)


def compare_latency(generated_ms: Column, reference_ms: Column) -> Column:
    """Struct (speedup, slowdown, performance); `unavailable` when a time is missing."""
    missing = generated_ms.isNull() | reference_ms.isNull()
    speedup = F.when(missing, None).when(generated_ms > 0, reference_ms / generated_ms).otherwise(0.0)
    slowdown = F.when(missing, None).when(reference_ms > 0, generated_ms / reference_ms).otherwise(0.0)
    label = (
        F.when(missing, "unavailable").when(speedup > 1.2, "faster")
        .when(slowdown > 1.2, "slower").otherwise("similar")
    )
    return F.struct(
        speedup.alias("speedup"), slowdown.alias("slowdown"), label.alias("performance")
    )


def judge_overall(correctness: Column, completeness: Column, quality: Column, overall: Column) -> Column:
    """Overall judged score in [0, 1]; 0.5 when a required part is missing."""
    given = F.coalesce(overall, 0.5 * correctness + 0.3 * completeness + 0.2 * quality)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), given))
    complete = correctness.isNotNull() & completeness.isNotNull() & quality.isNotNull()
    return F.when(complete, bounded).otherwise(0.5)


def execution_score(success: Column) -> Column:
    return F.when(success, 0.6).otherwise(0.0)


def judged_execution_score(success: Column, judged: Column) -> Column:
    return F.when(success, 0.3 * 1.0 + 0.7 * judged).otherwise(0.0)


def output_sample(rows: DataFrame, keys: Sequence[str], order_by: Sequence[Column],
                  n: int = K.SAMPLE_ROWS) -> DataFrame:
    """First rows kept with an evaluation."""
    return top_per_key(rows, keys, order_by, n, "sample_position")


def capture_expected(rows: DataFrame, keys: Sequence[str], order_by: Sequence[Column],
                     elapsed_ms: Column | None = None) -> DataFrame:
    """Expected output per key: columns, total row count and the first rows as text."""
    typed = _typed(rows, keys)
    total = rows.groupBy(*keys).agg(F.count("*").alias("row_count"))
    cells = F.array(
        *[
            (F.col(n).cast("double").cast("string") if isinstance(t, T.DecimalType)
             else V.iso_text(F.col(n), t) if V.is_date(t)
             else F.col(n).cast("string"))
            for n, t in typed
        ]
    )
    first = top_per_key(rows, keys, order_by, K.EXPECTED_ROWS, "position").select(
        *keys, "position", cells.alias("cells")
    )
    sample = first.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "cells"))), lambda r: r["cells"]
        ).alias("sample_rows")
    )
    return join_equal(total, sample, keys).select(
        *keys,
        F.array(*[F.lit(n) for n, _ in typed]).alias("columns"),
        "row_count",
        "sample_rows",
        (elapsed_ms if elapsed_ms is not None else F.lit(None).cast("double")).alias(
            "execution_time_ms"
        ),
    )


def capture_outcomes(queries: DataFrame, captured: DataFrame, failures: DataFrame, keys: Sequence[str], sql: str = "sql") -> DataFrame:
    """`queries` with expected_output, generation_error and outcome: captured, failed or no_sql.

    `captured` is what `capture_expected` made of the rows that statements gave, `failures` (keys, error) says which of them failed;
    a statement that is in neither gave no rows. A failed one has its error and a null output, whatever rows it gave before
    it failed; a query without a statement was not run and has neither. Of several errors of a query the first by text is kept.
    """
    said = failures.groupBy(*keys).agg(F.min("error").alias("__error"), F.lit(True).alias("__failed"))
    columns = captured.schema["columns"]
    output = F.struct("columns", "row_count", "sample_rows", "execution_time_ms")
    held = captured.select(*keys, output.alias("__output"))
    empty = F.struct(
        F.array().cast(columns.dataType).alias("columns"), F.lit(0).cast("long").alias("row_count"),
        F.array().cast("array<array<string>>").alias("sample_rows"), F.lit(None).cast("double").alias("execution_time_ms"),
    )
    joined = join_equal(join_equal(queries, held, keys, "left"), said, keys, "left")
    asked = F.coalesce(F.col(sql), F.lit("")) != ""
    outcome = F.when(~asked, "no_sql").when(F.col("__failed"), "failed").otherwise("captured")
    return joined.withColumn("outcome", outcome).select(
        *queries.columns,
        F.when(F.col("outcome") == "captured", F.coalesce("__output", empty)).alias("expected_output"),
        F.when(F.col("outcome") == "failed", F.coalesce("__error", F.lit("unknown error"))).alias("generation_error"),
        "outcome",
    )


def capture_counts(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, total_queries, success_count, fail_count); a query without a statement counts as failed."""
    ok = F.col("outcome") == "captured"
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("total_queries"), F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("fail_count")
    )
