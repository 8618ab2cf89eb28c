"""Alert rows and agent health."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriscope import constants as K
from veriscope.functions.text import shorten
from veriscope.operators import reports as R


def _alert(kind: str, severity: Column, message: Column) -> list[Column]:
    return [F.lit(kind).alias("alert"), severity.alias("severity"), message.alias("message")]


def accuracy_alert(evaluations: DataFrame) -> DataFrame:
    """A row when the mean of the latest evaluations is too low."""
    recent = R.recent_mean(evaluations).filter(
        (F.col("n") > K.ALERT_MIN_COUNT) & (F.col("avg_score") < K.ALERT_MEAN_SCORE)
    )
    message = F.concat(F.lit("Based on last "), F.col("n").cast("string"), F.lit(" evaluations."))
    return recent.select(*_alert("accuracy_degradation", F.lit("warning"), message), "avg_score", "n")


def high_drift_alert(drift: DataFrame, queries: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """A row when queries of the last hours drifted strongly."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")
    recent = queries.filter(F.col("created_at") > since).select("query_id")
    count = (
        drift.filter(F.col("drift_classification") == "high").select("query_id")
        .join(recent, ["query_id"]).agg(F.count("*").alias("n")).filter("n > 0")
    )
    severity = F.when(F.col("n") > 3, "critical").otherwise("warning")
    message = F.concat(F.col("n").cast("string"), F.lit(" High Drift queries detected in last 24h."))
    return count.select(*_alert("high_drift", severity, message), "n")


def query_drift_alerts(scored: DataFrame, shown: int | None = None) -> DataFrame:
    """A row per strongly drifted query with its whole text; also usable on a stream.

    `shown` shortens the message to so many characters where a display needs it.
    """
    message = F.col("query_text") if shown is None else shorten(F.col("query_text"), shown)
    return scored.filter(F.col("drift_classification") == "high").select(
        "query_id", "agent_type", "drift_score",
        *_alert("query_high_drift", F.lit("high"), message),
    )


def critical_error_alerts(errors: DataFrame, shown: int | None = None) -> DataFrame:
    """A row per critical error with its whole message, or its first `shown` characters."""
    message = F.col("error_message") if shown is None else F.substring("error_message", 1, shown)
    return errors.filter(F.col("severity") == "critical").select(
        "query_id", "error_category",
        *_alert("critical_error", F.lit("critical"), message),
    )


def accuracy_drop_alerts(daily: DataFrame) -> DataFrame:
    """A row per agent and day whose accuracy fell; `daily` has (agent_type, day, accuracy, total)."""
    changed = R.period_change(daily, ["agent_type"], "day", "accuracy").withColumn(
        "drop", F.col("previous") - F.col("accuracy")
    )
    severity = F.when(F.col("drop") > 10, "high").otherwise("medium")
    return changed.filter(F.col("drop") > 0).select(
        "agent_type", "day", F.col("accuracy").alias("current_accuracy"),
        F.col("previous").alias("previous_accuracy"), "drop", F.col("total").alias("sample_size"),
        F.lit("accuracy_drop").alias("alert"), severity.alias("severity"),
    )


def system_down_alerts(health: DataFrame) -> DataFrame:
    return health.filter(F.col("health_status") == "unhealthy").select(
        "agent_name", *_alert("system_down", F.lit("critical"), F.col("health_detail"))
    )


def error_spike_alerts(errors: DataFrame, time: str = "created_at",
                       limit: int = K.ERROR_SPIKE_COUNT) -> DataFrame:
    """A row per hour with too many errors, naming its three most frequent categories."""
    hour = F.window(F.col(time), "1 hour")["start"]
    per_category = errors.groupBy(hour.alias("hour"), "error_category").agg(F.count("*").alias("n"))
    place = Window.partitionBy("hour").orderBy(F.col("n").desc(), "error_category")
    ranked = per_category.withColumn("place", F.row_number().over(place))
    named = F.when(
        F.col("place") <= 3,
        F.struct("place", F.concat_ws(": ", "error_category", F.col("n").cast("string")).alias("label")),
    )
    return (
        ranked.groupBy("hour")
        .agg(
            F.sum("n").alias("error_count"),
            F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(named)), lambda s: s["label"]))
            .alias("top_errors"),
        )
        .filter(F.col("error_count") > limit)
        .withColumns({"alert": F.lit("error_spike"), "severity": F.lit("high")})
    )


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count("*").alias("n"))


def telemetry_health(agents: DataFrame, queries: DataFrame, as_of: datetime,
                     minutes: int = K.TELEMETRY_GAP_MINUTES) -> DataFrame:
    """Health per active agent from its address, whether it answers and recent telemetry.

    Whether an agent answers (`is_up`) is an input column.
    """
    seen = queries.groupBy("agent_type").agg(F.max("created_at").alias("last_seen"))
    joined = agents.filter(F.col("status") == "active").join(
        seen, agents["agent_name"] == seen["agent_type"], "left"
    )
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES")
    talking = F.coalesce(F.col("last_seen") > since, F.lit(False))
    no_url = F.col("agent_url").isNull() | (F.col("agent_url") == "")
    state = (
        F.when(no_url, "unknown").when(talking, "healthy")
        .when(F.col("is_up"), "sdk_issue").otherwise("unhealthy")
    )
    detail = (
        F.when(no_url, "No agent_url configured")
        .when(talking, F.lit(None))
        .when(F.col("is_up"), f"Agent is up but no telemetry in last {minutes} minutes")
        .otherwise("Health check failed — agent unreachable and no recent telemetry")
    )
    return joined.select(
        *[agents[c] for c in agents.columns if c not in ("health_status", "health_detail")],
        "last_seen", state.alias("health_status"), detail.alias("health_detail"),
    )
