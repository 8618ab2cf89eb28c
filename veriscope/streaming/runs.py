"""Running a stream to the end of its input and reading what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriscope.operators.ordering import latest_per_key
from veriscope.session import shared_dir


def versioned_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: one folder per batch, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run_to_end(stream: DataFrame, path: str, mode: str = "append",
               write: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process all input that is there now, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/_state")
        .foreachBatch(write or versioned_sink(f"{path}/rows"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def newest(spark: SparkSession, path: str, schema, keys: Sequence[str]) -> DataFrame:
    """Newest version per key of what `versioned_sink` wrote."""
    rows = spark.read.schema(T.StructType(schema.fields + [T.StructField("batch_id", T.LongType())])).parquet(f"{path}/rows")
    return latest_per_key(rows, keys, ["batch_id"]).drop("batch_id")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def collect_stream(stream: DataFrame, name: str, keys: Sequence[str] = (), mode: str = "append") -> DataFrame:
    """Result table of a stream over the input that is there now."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    run_to_end(stream, path, mode)
    schema = stream.schema
    if keys:
        return newest(spark, path, schema, keys)
    return spark.read.schema(schema).parquet(f"{path}/rows/batch_id=*")


def merge_sessions_locally(spark: SparkSession) -> None:
    """Let session windows combine before the shuffle, so a hot key is reduced first."""
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")


def event_time(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))
