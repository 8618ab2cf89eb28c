"""All checks of telemetry events in one frame: drift, evaluation, result drift and error class per query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.functions import sql_shape as S
from veriscope.functions import text as X
from veriscope.operators import drift as D
from veriscope.operators import scoring as G
from veriscope.operators.errors import classify_errors
from veriscope.operators.result_drift import column_psi, column_psi_of_rows, score_result_drift

ASSESSED = (
    "query_id long, agent_type string, created_at timestamp_ntz, drift_score double, drift_state string, "
    "eval_path string, final_score double, result string, confidence double, "
    "psi double, psi_state string, error_category string, severity string, suggested_fix string"
)


def assess(
    events: DataFrame, *, catalog: DataFrame, measures: Sequence[str], dimensions: Sequence[str], baselines: DataFrame,
    results: DataFrame, result_baseline: DataFrame, result_columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per event (columns of ASSESSED), whatever its status; a query_id occurs once in `events`.

    - drift: every event that is no error, against its agent's centroid; skip states are named, errors have none.
    - evaluation: successful events with SQL; what was found wrong before the score is in `eval_path`. The drift
      enters as the quality that can veto a score, 0.5 if there is none.
    - result drift: PSI of `results` (query_id, column_name, value), or of wide rows with `result_columns`, for evaluated events
      that are no replies without data; aggregate queries and the other skip states are named.
    - error class: the agent's message, or the engine's for a statement whose failure is worth classifying.

    `events` needs query_id, agent_type, created_at, status, query_text, generated_sql, error, embedding, ground_truth_sql,
    engine_error_type, engine_error, engine_failed, judge_score, judge_confidence, result_score. An embedding may be null.
    """
    c = F.col
    asked = events.withColumn("cleaned_sql", X.clean_sql(c("generated_sql")))
    drifted = D.score_drift(asked, baselines, keep_baselines=False)
    has_drift = (c("status") != "error") & c("stored")
    drifted = drifted.withColumns(
        {
            "drift_state": F.when(c("status") != "error", c("drift_classification")),
            "drift_quality": D.drift_quality(F.when(has_drift, c("drift_score"))),
            "drift_score": F.when(has_drift, c("drift_score")),
        }
    ).drop("similarity_to_baseline", "drift_classification", "is_anomaly", "stored")
    live = drifted.filter((c("status") == "success") & c("generated_sql").isNotNull())
    compared = S.sql_similarity(live, "cleaned_sql", "ground_truth_sql", "semantic_score")
    scored = G.text_scores(G.structural(compared, catalog, "cleaned_sql"), measures, dimensions, sql="cleaned_sql")
    judged = G.evaluate(scored.withColumn("has_ground_truth", c("ground_truth_sql").isNotNull())).select(
        "query_id", "eval_path", "final_score", "result", "confidence", "requires_classification",
    )

    checked = live.filter(~X.is_non_data_reply(c("generated_sql"))).select(
        "query_id", "agent_type", X.is_aggregate_query(c("cleaned_sql")).alias("is_aggregate")
    )
    # results are counted before they meet the events; whole rows do so once
    if result_columns is None:
        has_value = F.lit(True)
    else:
        has_value = F.coalesce(*[c(x) for x in result_columns]).isNotNull()
    sizes = results.filter(has_value).groupBy("query_id").agg(F.count("*").alias("row_count"))
    mine = results.join(checked.filter(~c("is_aggregate")).select("query_id", "agent_type"), ["query_id"])
    if result_columns is None:
        by_column = column_psi(mine.select("query_id", "agent_type", "column_name", "value"), result_baseline)
    else:
        by_column = column_psi_of_rows(mine, result_columns, result_baseline)
    psi = score_result_drift(checked.join(sizes, ["query_id"], "left"), None, result_baseline, by_column).select(
        "query_id", F.when(c("stored"), c("overall_psi")).alias("psi"), c("drift_classification").alias("psi_state")
    )

    joined = drifted.join(judged, ["query_id"], "left").join(psi, ["query_id"], "left")
    failed = (c("status") == "error") & (c("error") != "")
    message = F.when(failed, c("error")).when(c("requires_classification"), c("engine_error"))
    classed = classify_errors(joined.withColumn("__message", message), "__message")
    told = c("__message").isNotNull() & (c("__message") != "")
    return classed.select(
        "query_id", "agent_type", "created_at", "drift_score", "drift_state", "eval_path", "final_score", "result", "confidence", "psi", "psi_state",
        *[F.when(told, c(x)).alias(x) for x in ("error_category", "severity", "suggested_fix")],
    )
