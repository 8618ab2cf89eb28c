"""Helpers of the training-data operators: tables, staging, words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.session import shared_dir, ship_package

#: A word: a run without blanks (space, tab, line feed, vertical tab, form feed, carriage return).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that Python workers get at once where a row holds a whole text or shingle set.
FEW_ROWS = 1_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shipped(documents: DataFrame) -> DataFrame:
    """`documents`, after the package was sent to the Python workers: operators with Python functions begin with this."""
    ship_package(documents.sparkSession)
    return documents


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of the session."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most `rows` rows at once in what is run inside; a smaller setting of the session stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting, None)
    if before is not None and 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(setting, rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def staged(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """The rows of `df` as a table in the shared folder: computed once, readable after an executor is lost.

    With `batch`, Python functions in `df` get at most so many rows at once.
    """
    path = fresh_folder(df.sparkSession, name)
    with arrow_batches(df.sparkSession, batch) if batch else nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(left: str, right: str, *names: str) -> Column:
    """Null-safe equality of the columns `left`name and `right`name for every name."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{left}{n}").eqNullSafe(F.col(f"{right}{n}"))
    return out


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
