"""Schema discovery, relationships and schema changes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriscope.operators.ordering import latest_per_key

# fixed values: catalog name of each Spark type
SQL_TYPES = {
    T.StringType: "text",
    T.IntegerType: "integer",
    T.ShortType: "smallint",
    T.LongType: "bigint",
    T.DoubleType: "double precision",
    T.FloatType: "real",
    T.BooleanType: "boolean",
    T.DateType: "date",
    T.TimestampType: "timestamp with time zone",
    T.TimestampNTZType: "timestamp",
    T.BinaryType: "bytea",
}
# fixed values: schemas that are never discovered
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "mysql", "performance_schema", "sys")
CATALOG_KEY = ("schema_name", "table_name", "column_name")


def sql_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.DecimalType):
        return "numeric"
    return SQL_TYPES.get(type(dtype), dtype.simpleString())


def catalog_rows(spark: SparkSession, tables: dict[str, DataFrame], schema: str = "public") -> DataFrame:
    """(schema_name, table_name, column_name, data_type, is_nullable) from the tables' schemas."""
    rows = [
        (schema, name, f.name, sql_type(f.dataType), f.nullable)
        for name, df in tables.items()
        for f in df.schema.fields
        if schema not in SYSTEM_SCHEMAS
    ]
    return spark.createDataFrame(
        rows, "schema_name string, table_name string, column_name string, data_type string, is_nullable boolean"
    )


def measures_and_dimensions(tables: dict[str, DataFrame]) -> tuple[list[str], list[str]]:
    """Names of numeric and of text columns (schema metadata only)."""
    fields = [f for df in tables.values() for f in df.schema.fields]
    measures = sorted({f.name.lower() for f in fields if isinstance(f.dataType, T.NumericType)})
    dimensions = sorted({f.name.lower() for f in fields if isinstance(f.dataType, T.StringType)})
    return measures, dimensions


def json_fields(documents: DataFrame, column: str) -> DataFrame:
    """Fields of JSON objects with their types, over all rows: (field, data_type, documents, nulls).

    Types are told apart per value and merged per field, so every document
    counts, not only the first.
    """
    entries = F.from_json(column, "map<string,string>")
    fields = documents.select(F.explode(entries).alias("field", "value"))
    kind = (
        F.when(F.col("value").isNull(), "NoneType")
        .when(F.col("value").rlike(r"^-?\d+$"), "int")
        .when(F.col("value").rlike(r"^-?\d+\.\d+(?:[eE][+-]?\d+)?$"), "float")
        .when(F.col("value").isin("true", "false"), "bool")
        .when(F.col("value").startswith("{"), "dict")
        .when(F.col("value").startswith("["), "list")
        .otherwise("str")
    )
    typed = fields.withColumn("data_type", kind)
    return typed.groupBy("field").agg(
        F.concat_ws(
            "|", F.array_sort(F.collect_set(F.when(F.col("data_type") != "NoneType", F.col("data_type"))))
        ).alias("data_type"),
        F.count("*").alias("documents"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
    )


def declared_relationships(constraints: DataFrame) -> DataFrame:
    """Declared foreign keys in the common output shape."""
    return constraints.select(
        "source_schema", "source_table", "source_column",
        "target_schema", "target_table", "target_column",
        F.lit("foreign_key").alias("relationship_type"), "constraint_name",
    )


def inferred_relationships(catalog: DataFrame) -> DataFrame:
    """Relationships by name: a field `x_id` points to the table `xs`."""
    named = catalog.filter(F.col("column_name").endswith("_id") & (F.col("column_name") != "_id"))
    stem = F.expr("substring(column_name, 1, length(column_name) - 3)")
    return named.select(
        F.col("schema_name").alias("source_schema"),
        F.col("table_name").alias("source_table"),
        F.col("column_name").alias("source_column"),
        F.col("schema_name").alias("target_schema"),
        F.concat(stem, F.lit("s")).alias("target_table"),
        F.lit("_id").alias("target_column"),
        F.lit("inferred").alias("relationship_type"),
        F.lit(None).cast("string").alias("constraint_name"),
    ).distinct()


def constraint_join(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of two constraint tables that agree in all key columns (name, schema, table, column); a null agrees with nothing.

    Both sides may repeat a key: each left row meets each right row of its key, as in the catalog's own views.
    """
    return left.join(right, list(key))


def catalog_difference(current: DataFrame, stored: DataFrame, by: str = "agent_id") -> DataFrame:
    """Catalog columns that `current` has and `stored` lacks, once each: (by, schema, table, column); nulls are values."""
    key = [by, *CATALOG_KEY]
    return current.select(*key).distinct().exceptAll(stored.select(*key).distinct())


def scan_tables(tables: dict[str, DataFrame], stored: DataFrame, agent_id) -> DataFrame:
    """What a scheduler runs: (table_name, new_columns, removed_columns, changed_types, row_count) of every table that is there
    now or was stored; row_count is null for a table that is gone.
    """
    spark = stored.sparkSession
    current = catalog_rows(spark, tables).withColumn("agent_id", F.lit(agent_id))
    changes = schema_changes(current, stored, include_removed=True, include_types=True)
    count = lambda kind: F.count_if(F.col("change_type") == kind)
    counted = changes.groupBy("table_name").agg(
        count("column_added").alias("new_columns"), count("column_removed").alias("removed_columns"), count("type_changed").alias("changed_types")
    )
    sizes = spark.createDataFrame([], "table_name string, row_count long")
    for name, df in tables.items():
        sizes = sizes.unionByName(df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count"))
    names = current.select("table_name").union(stored.select("table_name")).distinct()
    return (
        names.join(sizes, ["table_name"], "left").join(counted, ["table_name"], "left")
        .na.fill(0, ["new_columns", "removed_columns", "changed_types"])
        .select("table_name", "new_columns", "removed_columns", "changed_types", "row_count")
    )


def containment(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """How many distinct child values a parent key lacks: (child_values, missing, contained)."""
    values = child.filter(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct()
    keys = parent.select(F.col(key).alias("v")).distinct().withColumn("found", F.lit(1))
    return values.join(keys, ["v"], "left").agg(
        F.count("*").alias("child_values"),
        F.count_if(F.col("found").isNull()).alias("missing"),
    ).withColumn("contained", F.col("missing") == 0)


def schema_changes(current: DataFrame, stored: DataFrame, include_removed: bool = False,
                   include_types: bool = False) -> DataFrame:
    """Change rows (agent_id, change_type, schema, table, column, data_type).

    Additions of tables and columns are always reported; removals and changed
    types only on request.
    """
    column_key = ["agent_id", *CATALOG_KEY]
    table_key = ["agent_id", "schema_name", "table_name"]

    def rows(df: DataFrame, kind: str, with_column: bool) -> DataFrame:
        return df.select(
            "agent_id", F.lit(kind).alias("change_type"), "schema_name", "table_name",
            (F.col("column_name") if with_column else F.lit(None).cast("string")).alias("column_name"),
            (F.col("data_type") if with_column else F.lit(None).cast("string")).alias("data_type"),
        )

    new_columns = current.join(stored, column_key, "left_anti")
    new_tables = current.select(*table_key).distinct().join(stored, table_key, "left_anti")
    out = rows(new_tables, "table_added", False).unionByName(rows(new_columns, "column_added", True))
    if include_removed:
        gone = stored.join(current, column_key, "left_anti")
        out = out.unionByName(rows(gone, "column_removed", True))
    if include_types:
        old = stored.select(*column_key, F.col("data_type").alias("old_type"))
        changed = current.join(old, column_key).filter(F.col("data_type") != F.col("old_type"))
        out = out.unionByName(rows(changed, "type_changed", True))
    return out


def change_counts(changes: DataFrame) -> DataFrame:
    """New tables and columns per agent with the has_changes flag."""
    counts = changes.groupBy("agent_id").agg(
        F.count_if(F.col("change_type") == "table_added").alias("new_tables"),
        F.count_if(F.col("change_type") == "column_added").alias("new_columns"),
    )
    return counts.withColumn("has_changes", (F.col("new_tables") > 0) | (F.col("new_columns") > 0))


def change_log(changes: DataFrame, detected_at: datetime) -> DataFrame:
    return changes.withColumns(
        {
            "detected_at": F.lit(detected_at).cast("timestamp_ntz"),
            "gt_generated": F.lit(False),
            "gt_query_count": F.lit(0),
        }
    )


def mark_generated(log: DataFrame, generated: DataFrame) -> DataFrame:
    """Set gt_generated and the query count on the open rows of agents in `generated`."""
    joined = log.join(
        generated.select("agent_id", F.col("query_count").alias("__count")), ["agent_id"], "left"
    )
    open_row = ~F.col("gt_generated") & F.col("__count").isNotNull()
    return joined.withColumns(
        {
            "gt_query_count": F.when(open_row, F.col("__count")).otherwise(F.col("gt_query_count")),
            "gt_generated": open_row | F.col("gt_generated"),
        }
    ).select(*log.columns)


def roll_versions(agents: DataFrame, changes: DataFrame, scanned_at: datetime,
                  generated: DataFrame | None = None) -> DataFrame:
    """Next schema version of every agent with changes; the scan time of every agent."""
    joined = agents.join(change_counts(changes), ["agent_id"], "left")
    changed = F.coalesce(F.col("has_changes"), F.lit(False))
    added = F.coalesce(F.col("new_tables") + F.col("new_columns"), F.lit(0))
    queries = F.lit(0)
    if generated is not None:
        joined = joined.join(generated, ["agent_id"], "left")
        queries = F.coalesce(F.col("query_count"), F.lit(0))
    return joined.withColumns(
        {
            "schema_version": F.col("schema_version") + changed.cast("int"),
            "schema_change_count": F.col("schema_change_count") + F.when(changed, added).otherwise(0),
            "gt_query_count": F.col("gt_query_count") + F.when(changed, queries).otherwise(0),
            "last_schema_scan_at": F.lit(scanned_at).cast("timestamp_ntz"),
        }
    ).select(*agents.columns)


def append_new(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored catalog with the rows of the current one that it lacks."""
    new = current.join(stored, ["agent_id", *CATALOG_KEY], "left_anti")
    return stored.unionByName(new.select(*stored.columns))


def scan(agents: DataFrame, stored: DataFrame, current: DataFrame, at: datetime) -> dict[str, DataFrame]:
    """One schema scan of all agents: changes, log rows, catalog and agent versions."""
    changes = schema_changes(current, stored)
    return {
        "changes": changes,
        "log": change_log(changes, at),
        "catalog": append_new(stored, current),
        "agents": roll_versions(agents, changes, at),
    }


def change_history(log: DataFrame, agent_id, n: int = 50) -> DataFrame:
    return (
        log.filter(F.col("agent_id") == agent_id)
        .orderBy(F.col("detected_at").desc(), "change_type", *CATALOG_KEY).limit(n)
    )


def nested_catalog(catalog: DataFrame) -> DataFrame:
    """(schema_name, table_name, columns): columns as a sorted list of structs."""
    return catalog.groupBy("schema_name", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("column_name", "data_type", "is_nullable"))).alias("columns")
    )


def flat_catalog(nested: DataFrame) -> DataFrame:
    return nested.select("schema_name", "table_name", F.inline("columns"))


def with_unqualified_names(catalog: DataFrame) -> DataFrame:
    """Catalog keyed by table name: qualified always, bare where one schema has the table."""
    single = (
        catalog.groupBy("table_name").agg(F.count_distinct("schema_name").alias("n"))
        .filter(F.col("n") == 1).select("table_name")
    )
    qualified = catalog.withColumn("lookup_name", F.concat_ws(".", "schema_name", "table_name"))
    bare = catalog.join(single, ["table_name"], "left_semi").withColumn("lookup_name", F.col("table_name"))
    return qualified.unionByName(bare)


def key_columns_text(columns: DataFrame, by: Sequence[str], position: str, name: str,
                     out: str = "columns") -> DataFrame:
    """Names joined in position order per group."""
    ordered = F.array_sort(F.collect_list(F.struct(position, name)))
    return columns.groupBy(*by).agg(
        F.concat_ws(", ", F.transform(ordered, lambda s: s[name])).alias(out)
    )


def value_profile(df: DataFrame, most: int = 10, shown: int = 5) -> DataFrame:
    """Columns with 2 to `most` distinct values and their first values in order.

    A sketch per column, from one scan, leaves out the columns with many
    values; only those with few are counted exactly. A table without such a column gives no row.
    """
    simple = [
        f.name for f in df.schema.fields
        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    ]
    about = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in simple]).first()
    few_valued = [c for c in simple if about[c] <= 10 * most]
    if not few_valued:
        return df.sparkSession.createDataFrame([], "column_name string, distinct_values int, sample_values string")
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v"))
            for c in few_valued
        ]
    )
    values = (
        df.select(F.explode(cells).alias("c")).select("c.*").filter(F.col("v").isNotNull()).distinct()
    )
    place = F.row_number().over(Window.partitionBy("column_name").orderBy("v"))
    few = values.withColumn("place", place).filter(F.col("place") <= most + 1)
    return (
        few.groupBy("column_name")
        .agg(
            F.max("place").alias("distinct_values"),
            F.array_sort(F.collect_list("v")).alias("values"),
        )
        .filter(F.col("distinct_values").between(2, most))
        .select("column_name", "distinct_values",
                F.concat_ws(", ", F.slice("values", 1, shown)).alias("sample_values"))
    )


def current_status(log: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Newest row per key of a status log."""
    return latest_per_key(log, keys, order_by)


def numeric_by_type_text(data_type: Column) -> Column:
    """Numeric types by their text, as catalogs without typed schemas need it."""
    # fixed values: words that mark a numeric type
    words = ("int", "float", "double", "numeric", "decimal", "real", "money", "number",
             "bigint", "smallint")
    return F.lower(data_type).rlike("|".join(words))
