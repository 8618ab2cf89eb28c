"""Data-quality checks of whole tables, one pass per check."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriscope import constants as K

_NOT_GROUPABLE = (T.MapType, T.VariantType)


def key_check(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Whether a declared or candidate key is present and unique: (rows, distinct_keys, null_keys, is_key)."""
    missing = F.lit(False)
    for c in key:
        missing = missing | F.col(c).isNull()
    per_key = df.groupBy(*key).agg(
        F.count("*").alias("n"), F.count_if(missing).alias("missing")
    )
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count("*").alias("distinct_keys"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("null_keys"),
    ).withColumn(
        "is_key", (F.col("total_rows") == F.col("distinct_keys")) & (F.col("null_keys") == 0)
    )


def null_shares(df: DataFrame) -> DataFrame:
    """(column_name, total_rows, null_count, percentage) of every column from a single scan."""
    counted = df.agg(
        F.count("*").alias("total"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("n")) for i, c in enumerate(df.columns)]
    )
    exploded = counted.select("total", F.explode(cells).alias("c"))
    nulls = F.col("total") - F.col("c.n")
    return exploded.select(
        F.col("c.name").alias("column_name"),
        F.col("total").alias("total_rows"),
        nulls.alias("null_count"),
        F.round(F.try_divide(nulls * 100.0, F.col("total")), 2).alias("percentage"),
    )


def duplicate_groups(df: DataFrame, columns: Sequence[str] | None = None,
                     limit: int | None = None) -> DataFrame:
    """Number of groups of equal rows: (duplicate_groups, total_rows).

    Rows are equal if they agree in all (given) columns that can be grouped; `limit` looks at the first of them only.
    """
    groupable = [
        f.name for f in df.schema.fields
        if (columns is None or f.name in columns) and not isinstance(f.dataType, _NOT_GROUPABLE)
    ][:limit]
    return df.groupBy(*groupable).agg(F.count("*").alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
    )


def table_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def document_duplicates(df: DataFrame, limit: int | None = None) -> DataFrame:
    """As `duplicate_groups` for documents, the document id left out."""
    fields = [c for c in df.columns if c != "_id"]
    return duplicate_groups(df, fields, limit)


def _issue(schema: str, table: str, kind: str, severity: str, message: Column, details: Column | None = None,
           column: Column | None = None, affected: Column | None = None,
           total: Column | None = None, percentage: Column | None = None) -> list[Column]:
    def or_null(c: Column | None, dtype: str) -> Column:
        return (F.lit(None) if c is None else c).cast(dtype)

    return [
        F.lit(schema).alias("schema_name"),
        F.lit(table).alias("table_name"),
        or_null(column, "string").alias("column_name"),
        F.lit(kind).alias("issue_type"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        or_null(details, "map<string,string>").alias("details"),
        or_null(affected, "long").alias("affected_rows"),
        or_null(total, "long").alias("total_rows"),
        or_null(percentage, "double").alias("percentage"),
    ]


def missing_key_issues(df: DataFrame, schema: str, table: str, key: Sequence[str]) -> DataFrame:
    message = F.lit(f"Table {schema}.{table} has no primary key")
    if not key:
        return df.agg(F.count("*").alias("n")).select(
            *_issue(schema, table, "missing_primary_key", "warning", message)
        )
    return key_check(df, key).filter(~F.col("is_key")).select(
        *_issue(schema, table, "missing_primary_key", "warning", message)
    )


def null_issues(df: DataFrame, schema: str, table: str) -> DataFrame:
    shares = null_shares(df).filter(F.col("percentage") > K.NULL_SHARE_LIMIT)
    message = F.concat(
        F.lit("Column '"), "column_name", F.lit("' has "),
        F.format_string("%.1f", "percentage"), F.lit("% NULL values"),
    )
    details = F.create_map(
        F.lit("null_count"), F.col("null_count").cast("string"),
        F.lit("total_rows"), F.col("total_rows").cast("string"),
    )
    return shares.select(
        *_issue(schema, table, "high_null_percentage", "warning", message, details,
                F.col("column_name"), F.col("null_count"), F.col("total_rows"), F.col("percentage"))
    )


def duplicate_issues(df: DataFrame, schema: str, table: str) -> DataFrame:
    found = duplicate_groups(df).filter(F.col("duplicate_groups") > 0)
    count = F.col("duplicate_groups")
    message = F.concat(count.cast("string"), F.lit(" duplicate row groups found"))
    return found.select(
        *_issue(schema, table, "duplicate_rows", "info", message,
                F.create_map(F.lit("count"), count.cast("string")), affected=count)
    )


def large_table_issues(df: DataFrame, schema: str, table: str, partitioned: bool = False,
                       limit: int = K.LARGE_TABLE_ROWS) -> DataFrame:
    """Large tables without a partition column (the counterpart of a missing index)."""
    rows = F.col("row_count")
    message = F.concat(F.lit("Large table ("), F.format_number(rows, 0), F.lit(" rows) with no indexes"))
    return table_size(df).filter((rows > limit) & F.lit(not partitioned)).select(
        *_issue(schema, table, "large_table_no_index", "warning", message,
                F.create_map(F.lit("rows"), rows.cast("string")), affected=rows, total=rows)
    )


Check = Callable[[DataFrame, str, str], DataFrame]


def table_profile(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """One row: total_rows, distinct_keys, null_keys, duplicate_groups and nulls (a count per column), from one scan.

    Rows are counted by key, a 128-bit digest of the columns that can be grouped and the set of columns that are null, combined
    before the shuffle, then by key; so a key or a row that repeats without end is a few rows for any task. Without a key
    distinct_keys and null_keys are null.
    """
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, _NOT_GROUPABLE)]
    names = [F.col(f"`{c}`") for c in plain]
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key)]
    held = [f"k{i}" for i in range(len(keys))]
    empty = F.array(*[F.col(f"`{c}`").isNull() for c in df.columns])
    rows = df.select(*keys, F.xxhash64(*names).alias("h1"), F.xxhash64(F.lit(1), *names).alias("h2"), empty.alias("empty"))
    per_row = rows.groupBy(*held, "h1", "h2", "empty").agg(F.count("*").alias("n"))
    counted = [F.sum(F.when(F.col("empty")[i], F.col("n")).otherwise(0)).alias(f"e{i}") for i in range(len(df.columns))]
    per_key = per_row.groupBy(*held).agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("again"), *counted)
    missing = F.lit(False)
    for k in held:
        missing = missing | F.col(k).isNull()
    nothing = F.lit(None).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return per_key.agg(
        zero(F.sum("n")).alias("total_rows"),
        (F.count("*") if held else nothing).alias("distinct_keys"),
        (zero(F.sum(F.when(missing, F.col("n")))) if held else nothing).alias("null_keys"),
        zero(F.sum("again")).alias("duplicate_groups"),
        F.array(*[zero(F.sum(f"e{i}")) for i in range(len(df.columns))]).alias("nulls"),
    )


_ISSUE_FIELDS = (
    "schema_name", "table_name", "column_name", "issue_type", "severity", "message", "details", "affected_rows", "total_rows", "percentage",
)


def profile_issues(profile: DataFrame, schema: str, table: str, columns: Sequence[str], keyed: bool, partitioned: bool = False,
                   large: int = K.LARGE_TABLE_ROWS) -> DataFrame:
    """Issues that a table's profile shows: a key that is none, columns with many nulls, duplicate rows, a large unpartitioned table."""
    total, groups = F.col("total_rows"), F.col("duplicate_groups")

    def issue(condition: Column, *args, **options) -> Column:
        fields = _issue(schema, table, *args, **options)
        return F.when(condition, F.struct(*[f.alias(n) for f, n in zip(fields, _ISSUE_FIELDS, strict=True)]))

    no_key = (total != F.col("distinct_keys")) | (F.col("null_keys") > 0) if keyed else F.lit(True)
    found = [issue(no_key, "missing_primary_key", "warning", F.lit(f"Table {schema}.{table} has no primary key"))]
    for i, c in enumerate(columns):
        nulls = F.col("nulls")[i]
        share = F.round(F.try_divide(nulls * 100.0, total), 2)
        message = F.concat(F.lit(f"Column '{c}' has "), F.format_string("%.1f", share), F.lit("% NULL values"))
        details = F.create_map(F.lit("null_count"), nulls.cast("string"), F.lit("total_rows"), total.cast("string"))
        found.append(issue(share > K.NULL_SHARE_LIMIT, "high_null_percentage", "warning", message, details, F.lit(c), nulls, total, share))
    found.append(issue(
        groups > 0, "duplicate_rows", "info", F.concat(groups.cast("string"), F.lit(" duplicate row groups found")),
        F.create_map(F.lit("count"), groups.cast("string")), affected=groups,
    ))
    if not partitioned:
        message = F.concat(F.lit("Large table ("), F.format_number(total, 0), F.lit(" rows) with no indexes"))
        found.append(issue(total > large, "large_table_no_index", "warning", message, F.create_map(F.lit("rows"), total.cast("string")),
                           affected=total, total=total))
    return profile.select(F.inline(F.array_compact(F.array(*found))))


def issue_report(tables: dict[str, DataFrame], keys: dict[str, Sequence[str]], schema: str = "public",
                 partitioned: Sequence[str] = (), extra: Sequence[Check] = ()) -> DataFrame:
    """Issues of all tables in one frame; `extra` plugs in further checks.

    The built-in checks of a table rest on one profile, so a table is scanned once. A check that cannot be planned
    for a table is reported as `check_skipped`, the others go on.
    """
    from pyspark.errors import AnalysisException

    def built_in(df: DataFrame, s: str, t: str) -> DataFrame:
        key = list(keys.get(t, ()))
        return profile_issues(table_profile(df, key), s, t, df.columns, bool(key), t in partitioned)

    report = None
    for name, df in tables.items():
        for check in (built_in, *extra):
            try:
                found = check(df, schema, name)
            except AnalysisException as failed:
                reason = F.lit(f"A check of {schema}.{name} could not be planned")
                details = F.create_map(F.lit("error"), F.lit(failed.getCondition() or str(failed)))
                found = df.sparkSession.range(1).select(*_issue(schema, name, "check_skipped", "warning", reason, details))
            report = found if report is None else report.unionByName(found)
    return report
