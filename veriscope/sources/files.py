"""Reading source files: wide CSV exports, ground-truth JSON, parquet tables, JDBC."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriscope import schemas as S
from veriscope.functions.text import non_empty, question_key
from veriscope.operators.ordering import latest_per_key
from veriscope.sources.json_documents import read_entries

_NUMBERS = ("sales", "quantity", "discount", "profit", "shipping_cost")
POSITION = "_pos"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_tables(spark: SparkSession, folder: str, names) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in names}


def stream_files(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream; a folder that the pattern matches counts with all its part files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # in braces a plain name is a pattern too: a stream takes single files by pattern only
    return reader.parquet(f"{folder}/{{{pattern}}}")


def folder_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of all Parquet tables of a folder, whatever file system holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in files]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet") and n[0] not in "._")


def spread(scan: DataFrame) -> DataFrame:
    """Deal out a scan with far fewer splits than cores before costly work per row.

    One file of one row group is read by a single task, however many cores
    there are. Inputs with enough splits are left as they are. Only for plain
    scans: their number of splits is known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() * 4 <= cores:
        return scan.repartition(cores)
    return scan


def snake(name: str) -> str:
    return re.sub(r"\W+", "_", name.strip()).lower()


def strip_bom(df: DataFrame) -> DataFrame:
    """Header names without a byte-order mark, also one misread as Latin-1."""
    return df.toDF(*[c.replace("ï»¿", "").lstrip("﻿") for c in df.columns])


def with_position(scan: DataFrame) -> DataFrame:
    """Add the source order of a file scan, for loads in which the first row wins.

    File, start of the split and the id inside its task: ids rise in reading
    order within a split, whichever task reads it.
    """
    return scan.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(POSITION),
    )


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, with their source order."""
    raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
    return strip_bom(with_position(raw))


def number(c: Column) -> Column:
    """Numeric text with thousands separators; null when it is not a number."""
    return F.regexp_replace(c, ",", "").try_cast("double")


def mixed_date(c: Column) -> Column:
    """Dates written month first, ISO, or day first with dashes."""
    text = F.trim(c)
    # fixed values: accepted layouts in the order they are tried
    layouts = ("M/d/yyyy", "yyyy-MM-dd", "M-d-yyyy", "d-M-yyyy", "d/M/yyyy")
    return F.coalesce(*[F.try_to_date(text, layout) for layout in layouts])


def clean_spend(raw: DataFrame) -> DataFrame:
    """Typed spend rows: numbers, dates and, if absent, the year."""
    out = raw
    for c in _NUMBERS:
        if c in out.columns:
            out = out.withColumn(c, number(F.col(c)))
    out = out.withColumns({c: mixed_date(F.col(c)) for c in ("order_date", "ship_date")})
    if "year" not in out.columns:
        return out.withColumn("year", F.year("order_date"))
    return out.withColumn("year", F.col("year").try_cast("int"))


def rejected(raw: DataFrame, conversions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per column, how many non-empty texts its conversion makes null; one pass over the raw texts."""
    return raw.agg(
        *[
            F.count_if((F.coalesce(c, F.lit("")) != "") & convert(F.col(c)).isNull()).alias(c)
            for c, convert in conversions.items()
        ]
    )


def read_spend(spark: SparkSession, path: str) -> DataFrame:
    return clean_spend(read_csv(spark, path, "ISO-8859-1"))


def read_supply(spark: SparkSession, path: str) -> DataFrame:
    """Supply-chain rows with snake-case names ("Lead times" and "Lead time" stay apart)."""
    raw = read_csv(spark, path)
    named = raw.toDF(*[c if c == POSITION else snake(c) for c in raw.columns])
    return named.withColumns(
        {
            **{c: F.col(c).try_cast("double") for c in (
                "price", "revenue_generated", "shipping_costs", "manufacturing_costs",
                "defect_rates", "costs")},
            **{c: F.col(c).try_cast("int") for c in (
                "availability", "number_of_products_sold", "stock_levels", "lead_times",
                "order_quantities", "shipping_times", "lead_time", "production_volumes",
                "manufacturing_lead_time")},
        }
    )


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Entries of ground-truth files: `{queries: [...]}` or a bare list; a large file is read by many tasks."""
    found = read_entries(spark, path).select("position", F.from_json("text", S.GROUND_TRUTH_ENTRY).alias("entry"))
    return found.select("position", "entry.*")


def ground_truth_index(entries: DataFrame) -> DataFrame:
    """One entry per normalised question; of repeated questions the last one counts."""
    text = F.coalesce(*[non_empty(F.col(c)) for c in ("query_text", "natural_language", "query")])
    named = (
        entries.withColumn("question", text)
        .filter(F.col("question").isNotNull())
        .withColumns(
            {
                "question_key": question_key(F.col("question")),
                "sql": F.coalesce("sql", F.lit("")),
                "complexity": F.coalesce("complexity", F.lit("simple")),
            }
        )
    )
    return latest_per_key(named, ["question_key"], ["position"])


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """Result of a query in a relational database.

    Give partitionColumn, lowerBound, upperBound and numPartitions (with
    `dbtable` instead of a query) to read in parallel.
    """
    reader = spark.read.format("jdbc").option("url", jdbc_url(url))
    if "dbtable" not in options:
        reader = reader.option("query", query)
    return reader.options(**options).load()


def jdbc_url(url: str) -> str:
    """JDBC form of a database address; document stores cannot answer SQL."""
    scheme, _, rest = url.partition("://")
    scheme = scheme.lower().split("+")[0]
    if scheme in ("postgresql", "postgres"):
        return f"jdbc:postgresql://{rest}"
    if scheme in ("mysql", "mariadb"):
        return f"jdbc:mysql://{rest}"
    if scheme == "sqlite":
        return f"jdbc:sqlite:{rest.removeprefix('/') if rest.startswith('//') else rest}"
    raise ValueError(f"no SQL source for {scheme or url!r}")


def bounded(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """At most `max_rows` rows of a fetched result."""
    return df.limit(max_rows)


def sample_rows(df: DataFrame, n: int = 5, key: Sequence[str] = ()) -> DataFrame:
    """The same n rows on every run: the first by `key`, then by all columns; without a key those with the least row hash.

    Columns without an order (maps) do not tell rows apart. Only n rows a task are kept on the way.
    """
    columns = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    first = [F.col(c) for c in key] if key else [F.xxhash64(*columns)]
    return df.orderBy(*first, *columns).limit(n)
