"""Telemetry as a stream: windows, deduplication and scoring per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope import constants as K
from veriscope import schemas as S
from veriscope.operators.drift import score_drift
from veriscope.operators.errors import classify_errors
from veriscope.operators.scoring import text_scores
from veriscope.sources.files import spread, stream_files
from veriscope.sources.stores import register_telemetry


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet",
                files_per_batch: int = 100) -> DataFrame:
    """Event files of a folder as a stream."""
    return stream_files(spark, folder, pattern, S.EVENTS, files_per_batch)


def ingest(events: DataFrame, agents: DataFrame) -> DataFrame:
    """Telemetry of registered agents (stream-static join)."""
    return register_telemetry(events, agents)


def deduplicate(events: DataFrame, key: str = "query_id", time: str = "created_at",
                delay: str = "1 hour") -> DataFrame:
    """First delivery of each event within the allowed lateness."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def high_drift_counts(scored: DataFrame, time: str = "created_at", delay: str = "1 hour",
                      length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Strongly drifted queries per sliding window."""
    high = scored.withWatermark(time, delay).filter(F.col("drift_classification") == "high")
    counted = high.groupBy(F.window(time, length, slide).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n",
        F.when(F.col("n") > 3, "critical").otherwise("warning").alias("severity"),
    )


def daily_accuracy(evaluations: DataFrame, time: str = "created_at", delay: str = "1 hour") -> DataFrame:
    """Accuracy per day and agent."""
    per_day = evaluations.withWatermark(time, delay).groupBy(
        F.window(time, "1 day").alias("w"), "agent_type"
    )
    counted = per_day.agg(
        F.count("*").alias("total"), F.count_if(F.col("result") == "PASS").alias("passed")
    )
    return counted.select(
        F.col("w.start").alias("day"), "agent_type", "total", "passed",
        (F.col("passed") * 100.0 / F.col("total")).alias("accuracy"),
    )


def telemetry_sessions(events: DataFrame, time: str = "created_at", delay: str = "1 hour",
                       gap: str = f"{K.TELEMETRY_GAP_MINUTES} minutes") -> DataFrame:
    """Stretches of telemetry per agent without a gap; what lies between two is a silence."""
    per_agent = events.withWatermark(time, delay).groupBy(
        F.session_window(time, gap).alias("w"), "agent_type"
    )
    return per_agent.agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
        "agent_type", "events",
    )


def error_spikes(events: DataFrame, time: str = "created_at", delay: str = "1 hour",
                 limit: int = K.ERROR_SPIKE_COUNT) -> DataFrame:
    """Sliding hours with more errors than the limit."""
    errors = events.withWatermark(time, delay).filter(F.col("status") == "error")
    counted = errors.groupBy(F.window(time, "1 hour", "15 minutes").alias("w")).agg(
        F.count("*").alias("errors")
    )
    return counted.filter(F.col("errors") > limit).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "errors"
    )


def recent_accuracy(evaluations: DataFrame, time: str = "created_at", delay: str = "5 minutes") -> DataFrame:
    """Accuracy per agent over sliding five minutes."""
    counted = evaluations.withWatermark(time, delay).groupBy(
        F.window(time, "5 minutes", "1 minute").alias("w"), "agent_type"
    ).agg(F.count("*").alias("total"), F.count_if(F.col("result") == "PASS").alias("passed"))
    return counted.select(
        F.col("w.start").alias("window_start"), "agent_type", "total", "passed",
        (F.col("passed") * 100.0 / F.col("total")).alias("accuracy"),
    )


def relative_to_baseline(batch: DataFrame, baselines: DataFrame, version: int) -> DataFrame:
    """(query_id, baseline_version, relative): latency against the mean `m` of its agent in one version of the baseline.

    Agents without a baseline have a null.
    """
    joined = batch.join(baselines, ["agent_type"], "left")
    return joined.select(
        "query_id", F.lit(version).cast("long").alias("baseline_version"), F.try_divide("execution_time_ms", "m").alias("relative")
    )


def scoring_batch(path: str, measures, dimensions,
                  baselines: Callable[[SparkSession], DataFrame] | None = None):
    """foreachBatch writer that scores, checks drift and classifies errors in one batch.

    `baselines` is read again for every batch, so a baseline replaced in the
    meantime is used from the next batch on. Each output has one folder per
    batch: a repeated batch replaces its own rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = spread(batch).persist()
        try:
            live = batch.filter((F.col("status") == "success") & F.col("generated_sql").isNotNull())
            scored = text_scores(live, measures, dimensions).select(
                "query_id", "agent_type", "created_at", "intent_score", "pattern_score"
            )
            scored.write.mode("overwrite").parquet(f"{path}/scores/batch_id={batch_id}")
            failed = batch.filter((F.col("status") == "error") & F.col("error").isNotNull())
            classify_errors(failed.withColumnRenamed("error", "error_message")).select(
                "query_id", "agent_type", "created_at", "error_category", "severity", "suggested_fix"
            ).write.mode("overwrite").parquet(f"{path}/errors/batch_id={batch_id}")
            if baselines is not None:
                table = baselines(batch.sparkSession)
                score_drift(live, table, keep_baselines=False).filter("stored").select(
                    "query_id", "agent_type", "created_at", "similarity_to_baseline", "drift_score",
                    "drift_classification", "is_anomaly",
                ).write.mode("overwrite").parquet(f"{path}/drift/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write
