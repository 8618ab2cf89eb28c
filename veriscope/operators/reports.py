"""Metrics, trends, rankings and histories over the monitoring tables.

Each report is one aggregation over a table; where the same figures are needed
overall and per agent, both come from the same plan. `as_of` replaces the wall
clock.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriscope import constants as K
from veriscope.operators.ordering import top_per_key


def _passed() -> Column:
    return F.col("result") == "PASS"


def for_agent(df: DataFrame, agent: str | None, ignore_case: bool = False,
              column: str = "agent_type") -> DataFrame:
    """Optional agent filter."""
    if agent is None:
        return df
    if ignore_case:
        return df.filter(F.lower(column) == agent.lower())
    return df.filter(F.col(column) == agent)


def result_score(evaluation_data: Column) -> Column:
    """Result-check score stored in the evaluation JSON."""
    return F.get_json_object(evaluation_data, "$.scores.result_validation").cast("double")


def _scores() -> list[Column]:
    return [
        F.count("*").alias("total"),
        F.count_if(_passed()).alias("passed"),
        F.avg("final_score").alias("avg_score"),
        F.avg("structural_score").alias("avg_structural"),
        F.avg("semantic_score").alias("avg_semantic"),
        F.avg("llm_score").alias("avg_llm"),
        F.avg(result_score(F.col("evaluation_data"))).alias("avg_result"),
    ]


def share_percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def overall_metrics(evaluations: DataFrame, agent: str | None = None) -> DataFrame:
    return for_agent(evaluations, agent).agg(*_scores()).withColumns(
        {
            "failed": F.col("total") - F.col("passed"),
            "accuracy": share_percent(F.col("passed"), F.col("total")),
        }
    )


def average_latency(queries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return queries.groupBy(*by).agg(F.avg("execution_time_ms").alias("avg_latency"))


def agent_metrics(evaluations: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores, accuracy and latency per agent."""
    scores = evaluations.groupBy("agent_type").agg(*_scores())
    return (
        scores.join(average_latency(queries, ["agent_type"]), ["agent_type"], "left")
        .withColumn("accuracy", share_percent(F.col("passed"), F.col("total")))
        .na.fill(0.0, ["avg_latency"])
    )


def accuracy_trend(queries: DataFrame, evaluations: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Accuracy per day and agent over the last days, long form."""
    recent = queries.filter(F.col("created_at") > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))
    return (
        recent.select("query_id", "agent_type", "created_at")
        .join(evaluations.select("query_id", "result"), ["query_id"])
        .groupBy(F.to_date("created_at").alias("day"), "agent_type")
        .agg(F.avg(F.when(_passed(), 100.0).otherwise(0.0)).alias("accuracy"))
    )


def pivot_trend(trend: DataFrame, agents: Sequence[str]) -> DataFrame:
    """One row per day with a column per agent."""
    wide = trend.groupBy("day").pivot("agent_type", list(agents)).agg(F.first("accuracy"))
    return wide.select("day", *[F.col(a).alias(a.capitalize()) for a in agents])


def distribution(scored: DataFrame, score: str, out: str) -> DataFrame:
    """Count and mean score per class."""
    return scored.groupBy(F.lower("drift_classification").alias("drift_classification")).agg(
        F.count("*").alias("n"), F.avg(score).alias(out)
    )


def anomaly_count(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_if("is_anomaly").alias("total_anomalies"))


def daily_average(scored: DataFrame, score: str, out: str, time: str = "created_at") -> DataFrame:
    return scored.groupBy(F.to_date(time).alias("day")).agg(F.avg(score).alias(out))


def column_psi_average(results: DataFrame, latest: int = 200) -> DataFrame:
    """Mean PSI per result column over the latest results."""
    newest = results.orderBy(F.col("created_at").desc(), F.col("query_id").desc()).limit(latest)
    return (
        newest.select(F.explode("psi_scores").alias("column_name", "psi"))
        .groupBy("column_name")
        .agg(F.avg("psi").alias("avg_psi"))
    )


def error_summary(errors: DataFrame) -> DataFrame:
    """Count per category with a map of counts per severity."""
    return (
        errors.groupBy("error_category", "severity").agg(F.count("*").alias("n"))
        .groupBy("error_category")
        .agg(
            F.sum("n").alias("total"),
            F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("severities"),
        )
    )


def error_rollup(errors: DataFrame) -> DataFrame:
    """Counts per category and severity with category totals (severity null)."""
    return (
        errors.rollup("error_category", "severity").agg(F.count("*").alias("n"))
        .filter(F.col("error_category").isNotNull())
    )


def pass_rate(evaluations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rate = F.try_divide(F.count_if(_passed()) * 100.0, F.count("*"))
    return evaluations.groupBy(*by).agg(F.count("*").alias("total"), rate.alias("accuracy"))


def agent_summary(agents: DataFrame, queries: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Card per registered agent: requests, latency in seconds, accuracy, status."""
    traffic = queries.groupBy("agent_type").agg(
        F.count("*").alias("requests"), F.avg("execution_time_ms").alias("avg_latency")
    )
    rate = pass_rate(evaluations, ["agent_type"]).select("agent_type", "accuracy")
    joined = (
        agents.join(traffic, agents["agent_name"] == traffic["agent_type"], "left").drop("agent_type")
        .join(rate, F.col("agent_name") == rate["agent_type"], "left").drop("agent_type")
        .na.fill(0, ["requests"]).na.fill(0.0, ["avg_latency", "accuracy"])
    )
    shown = (
        F.when(F.col("health_status") == "healthy", "Healthy")
        .when(F.col("health_status") == "unhealthy", "Unhealthy")
        .when(F.col("health_status") == "sdk_issue", "SDK Issue")
        .otherwise("Unknown")
    )
    degraded = (
        (F.col("accuracy") < K.DEGRADED_ACCURACY) & (F.col("requests") > K.ALERT_MIN_COUNT)
    )
    return joined.withColumns(
        {
            "status": F.when((shown == "Healthy") & degraded, "Degraded").otherwise(shown),
            "latency_s": F.col("avg_latency") / 1000.0,
        }
    )


def last_evaluations(evaluations: DataFrame, n: int = K.ALERT_LAST_N) -> DataFrame:
    return evaluations.orderBy(F.col("created_at").desc(), F.col("query_id").desc()).limit(n)


def recent_mean(evaluations: DataFrame, n: int = K.ALERT_LAST_N) -> DataFrame:
    return last_evaluations(evaluations, n).agg(
        F.avg("final_score").alias("avg_score"), F.count("*").alias("n")
    )


def recent_accuracy_by_agent(evaluations: DataFrame, n: int = K.ALERT_LAST_N) -> DataFrame:
    newest = top_per_key(
        evaluations.select("agent_type", "created_at", "query_id", "result"), ["agent_type"],
        [F.col("created_at").desc(), F.col("query_id").desc()], n,
    )
    return newest.groupBy("agent_type").agg(
        F.count("*").alias("total"),
        F.count_if(_passed()).alias("passed"),
        (F.count_if(_passed()) * 100.0 / F.count("*")).alias("accuracy"),
    )


def accuracy_since(evaluations: DataFrame, agent: str, as_of: datetime, minutes: int = 5) -> DataFrame:
    """Accuracy of one agent in the last minutes."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES")
    return pass_rate(for_agent(evaluations, agent).filter(F.col("created_at") > since))


def top_error_categories(errors: DataFrame, n: int = 5) -> DataFrame:
    return (
        errors.groupBy("error_category").agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "error_category").limit(n)
    )


def confusion(labelled: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """TP/TN/FP/FN with precision, recall, F1 and accuracy."""
    counts = labelled.agg(
        F.count_if(truth & predicted).alias("tp"),
        F.count_if(~truth & ~predicted).alias("tn"),
        F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"),
    )
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns(
        {
            "precision": precision,
            "recall": recall,
            "f1": F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")),
            "accuracy": F.try_divide(
                F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
            ),
        }
    )


def period_change(df: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Previous value and change per key over an aggregated series."""
    w = Window.partitionBy(*keys).orderBy(period)
    previous = F.lag(value).over(w)
    return df.withColumns(
        {"previous": previous, "change": F.col(value) - previous}
    )


def high_samples(scored: DataFrame, queries: DataFrame, order_by: Sequence[Column], n: int = 20) -> DataFrame:
    """First n rows of class `high` with the text of their query.

    The limit is taken before the join, so only n rows look up their query.
    """
    top = scored.filter(F.lower("drift_classification") == "high").orderBy(*order_by).limit(n)
    return top.join(queries, ["query_id"], "left")


def recent_errors(errors: DataFrame, queries: DataFrame, category: str | None = None,
                  agent: str | None = None, n: int = 20) -> DataFrame:
    chosen = errors if category is None else errors.filter(F.col("error_category") == category)
    if agent is not None:
        chosen = chosen.join(
            queries.filter(F.col("agent_type") == agent).select("query_id"), ["query_id"], "left_semi"
        )
    top = chosen.orderBy(F.col("first_seen").desc(), F.col("query_id").desc()).limit(n)
    return top.join(queries.select("query_id", "query_text"), ["query_id"], "left").withColumn(
        "query_text", F.coalesce(F.nullif("query_text", F.lit("")), F.lit("Unknown"))
    )


def history(queries: DataFrame, evaluations: DataFrame, errors: DataFrame, drift: DataFrame,
            valid: Column, agent: str | None = None, n: int = 50) -> DataFrame:
    """Newest queries with their verdict, first error and drift, one row per query.

    The newest queries are picked before the joins. Of several errors the
    first seen counts.
    """
    newest = (
        for_agent(queries.filter(valid), agent, ignore_case=True)
        .orderBy(F.col("created_at").desc(), "query_id").limit(n)
    )
    ids = newest.select("query_id")
    first_error = errors.join(ids, ["query_id"], "left_semi").groupBy("query_id").agg(
        F.min_by("error_category", F.struct("first_seen", "error_category")).alias("error_category")
    )
    return (
        newest.join(evaluations.select("query_id", "result", "confidence", "evaluation_data"), ["query_id"], "left")
        .join(first_error, ["query_id"], "left")
        .join(drift.select("query_id", "drift_score", "drift_classification"), ["query_id"], "left")
        .select(
            "query_id", "query_text", "agent_type", "created_at",
            F.coalesce("result", F.lit("N/A")).alias("verdict"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
            F.coalesce("error_category", F.lit("None")).alias("error_bucket"),
            F.coalesce("drift_score", F.lit(0.0)).alias("drift_score"),
            F.coalesce("drift_classification", F.lit("N/A")).alias("drift_level"),
            result_score(F.col("evaluation_data")).alias("output_score"),
        )
    )


def run_details(queries: DataFrame, evaluations: DataFrame, drift: DataFrame) -> DataFrame:
    """Everything known about each query."""
    return (
        queries.join(evaluations.drop("agent_type", "created_at", "query_text", "generated_sql"), ["query_id"], "left")
        .join(drift.select("query_id", "drift_score", "drift_classification"), ["query_id"], "left")
        .withColumns(
            {
                "verdict": F.coalesce("result", F.lit("PENDING")),
                "confidence": F.coalesce("confidence", F.lit(0.0)),
                "score": F.coalesce("final_score", F.lit(0.0)),
                "drift_score": F.coalesce("drift_score", F.lit(0.0)),
                "drift_status": F.coalesce("drift_classification", F.lit("unknown")),
            }
        )
    )


def search_executions(executions: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows in which any column contains the text, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return executions.filter(hit)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 1).when(severity == "warning", 2).otherwise(3)


def issues_by_severity(issues: DataFrame) -> DataFrame:
    return issues.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warning"),
        F.count_if(F.col("severity") == "info").alias("info"),
    )
