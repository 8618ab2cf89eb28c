"""Error classification by message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope import constants as K
from veriscope.functions.text import matches_any


def matched_category(lower: Column) -> Column:
    """First category, in order, one of whose patterns occurs in a lower-case message."""
    chain = None
    for category, patterns in K.ERROR_PATTERNS.items():
        hit = matches_any(lower, patterns)
        chain = F.when(hit, category) if chain is None else chain.when(hit, category)
    return chain


def classify_errors(errors: DataFrame, message: str = "error_message") -> DataFrame:
    """Add error_category, severity, suggested_fix and `stored` (false for empty messages).

    A matched message has the severity of its category; an unmatched one is
    AGENT_LOGIC, an empty one UNKNOWN, both of low severity.
    """
    severity = F.create_map(*[F.lit(x) for pair in K.ERROR_SEVERITY.items() for x in pair])
    advice = F.create_map(*[F.lit(x) for pair in K.ERROR_ADVICE.items() for x in pair])
    empty = F.col(message).isNull() | (F.col(message) == "")
    # one projection per step, so the message is folded and searched once
    matched = errors.withColumn("__lower", F.lower(message)).withColumn(
        "__matched", matched_category(F.col("__lower"))
    )
    category = F.when(empty, "UNKNOWN").otherwise(F.coalesce("__matched", F.lit("AGENT_LOGIC")))
    return (
        matched.withColumns(
            {
                "error_category": category,
                "severity": F.coalesce(severity[F.col("__matched")], F.lit("low")),
                "stored": ~empty,
            }
        )
        .withColumn("suggested_fix", advice[F.col("error_category")])
        .drop("__lower", "__matched")
    )


def errors_to_classify(
    telemetry: DataFrame, structural_failures: DataFrame, evaluation_failures: DataFrame
) -> DataFrame:
    """(query_id, error_message, origin): agent errors, classifiable SQL errors, evaluation errors."""
    agent = telemetry.filter((F.col("status") == "error") & (F.col("error") != "")).select(
        "query_id", F.col("error").alias("error_message"), F.lit("agent").alias("origin")
    )
    sql = structural_failures.filter("requires_classification").select(
        "query_id", "error_message", F.lit("structural").alias("origin")
    )
    run = evaluation_failures.select(
        "query_id", "error_message", F.lit("evaluation").alias("origin")
    )
    return agent.unionByName(sql).unionByName(run)


def error_frequency(errors: DataFrame, time: str = "created_at") -> DataFrame:
    """Occurrences with first and last sighting per category and message."""
    return errors.groupBy("error_category", "error_message").agg(
        F.count("*").alias("frequency_count"),
        F.min(time).alias("first_seen"),
        F.max(time).alias("last_seen"),
    )
