"""What comes too late for a stream's watermark is kept beside it instead of vanishing.

Spark's windows drop rows behind the watermark without a trace, and which rows those are depends on how files fall into
batches. The gate applies the same watermark (newest event time of the batches before, less the delay) to rows instead of
windows, ahead of them: a row at or after it goes on and can be dropped by no window, since no window that holds it has
closed; a row before it goes to a table of late rows. Nothing is lost, in whatever order files arrive: kept + late = all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.streaming.runs import run_to_end

_REPORT = "batch_id long, watermark timestamp_ntz, newest timestamp_ntz, kept long, late long, untimed long"


class LateGate:
    """Folders `kept` and `late` with a part per batch, and `report` with what happened in each.

    The report of a batch is written after its rows; a batch that is repeated before that replaces its own rows, one
    that is repeated after it finds the same watermark in the reports before it. Rows without a time pass as kept.
    """

    def __init__(self, spark: SparkSession, path: str, time: str, delay: str):
        self.spark, self.path, self.time, self.delay = spark, path.rstrip("/"), time, delay

    def _reports(self, before: int) -> DataFrame:
        done = [
            f"{self.path}/report/batch_id={b}" for b in range(before)  # numbers of a stream have no gaps
        ]
        return self.spark.read.schema(_REPORT).parquet(*done) if done else self.spark.createDataFrame([], _REPORT)

    def watermark(self, batch_id: int):
        """Newest event time of all batches before, less the delay; None before the first time."""
        newest = F.max("newest")
        return self._reports(batch_id).agg((newest - F.expr(f"INTERVAL {self.delay}")).alias("w")).first().w

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch writer."""
        mark = self.watermark(batch_id)
        time = F.col(self.time).cast("timestamp_ntz")
        limit = F.lit(mark).cast("timestamp_ntz")
        late = F.coalesce(time < limit, F.lit(False))
        rows = batch.persist()
        try:
            rows.filter(~late).write.mode("overwrite").parquet(f"{self.path}/kept/batch_id={batch_id}")
            rows.filter(late).write.mode("overwrite").parquet(f"{self.path}/late/batch_id={batch_id}")
            rows.agg(
                F.lit(batch_id).cast("long").alias("batch_id"), limit.alias("watermark"), F.max(time).alias("newest"),
                F.count_if(~late).alias("kept"), F.count_if(late).alias("late"), F.count_if(time.isNull()).alias("untimed"),
            ).write.mode("overwrite").parquet(f"{self.path}/report/batch_id={batch_id}")
        finally:
            rows.unpersist()

    def report(self) -> DataFrame:
        """A row per batch: watermark, newest time, rows kept, late and without a time."""
        return self.spark.read.schema(_REPORT).parquet(f"{self.path}/report/batch_id=*")

    def late(self, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/late/batch_id=*")

    def kept(self, schema) -> DataFrame:
        """Kept rows as a stream: the gate's batches in order, one at a time, so watermarks behind it are never ahead of its own."""
        return self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/kept")


def through_gate(stream: DataFrame, path: str, time: str, delay: str = "1 hour") -> LateGate:
    """Runs a stream to the end of its input through a gate in `path`."""
    gate = LateGate(stream.sparkSession, path, time, delay)
    run_to_end(stream, gate.path, write=gate.write)
    return gate
