"""Metrics, trends, rankings, joins, alerts and health over the stand-in telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriscope.functions import text as X
from veriscope.operators import alerts as L
from veriscope.operators import errors as E
from veriscope.operators import reports as R
from veriscope.operators.ordering import rolling_last_n, top_per_key
from veriscope.plans import standin as T
from veriscope.plans.registry import query
from veriscope.plans.standin import with_tables
from veriscope.sources.files import read_table, spread

AGENTS = ["click", "error", "purchase", "signup", "view"]


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


_SCORES_SQL = """count(*) AS total, count(*) FILTER (WHERE result = 'PASS') AS passed,
  round(avg(final_score), 6) AS avg_score, round(avg(structural_score), 6) AS avg_structural,
  round(avg(semantic_score), 6) AS avg_semantic, round(avg(llm_score), 6) AS avg_llm,
  round(avg(result_score), 6) AS avg_result"""
_SCORE_COLUMNS = ["avg_score", "avg_structural", "avg_semantic", "avg_llm", "avg_result"]


@query("A1_overall_metrics", with_tables(
    f"SELECT {_SCORES_SQL}, count(*) FILTER (WHERE result <> 'PASS') AS failed, "
    "round(count(*) FILTER (WHERE result = 'PASS') * 100.0::DOUBLE / count(*), 6) AS accuracy FROM evaluations",
    "evaluations"))
def overall(spark, d):
    m = R.overall_metrics(T.evaluations(spark, d))
    return m.select("total", "passed", "failed", _r("accuracy"), *[_r(c) for c in _SCORE_COLUMNS])


@query("A2_agent_metrics", with_tables(
    f"SELECT agent_type, {_SCORES_SQL}, "
    "round(count(*) FILTER (WHERE result = 'PASS') * 100.0::DOUBLE / count(*), 6) AS accuracy, "
    "(SELECT round(avg(execution_time_ms), 6) FROM queries q WHERE q.agent_type = e.agent_type) AS avg_latency "
    "FROM evaluations e GROUP BY agent_type", "evaluations"))
def per_agent(spark, d):
    m = R.agent_metrics(T.evaluations(spark, d), T.queries(spark, d))
    return m.select("agent_type", "total", "passed", _r("accuracy"), _r("avg_latency"),
                    *[_r(c) for c in _SCORE_COLUMNS])


@query("A3_average_latency", with_tables(
    "SELECT coalesce(agent_type, 'all') AS agent_type, round(avg(execution_time_ms), 6) AS avg_latency "
    "FROM queries GROUP BY GROUPING SETS ((agent_type), ())", "queries"))
def latency(spark, d):
    q = T.queries(spark, d)
    both = R.average_latency(q, ["agent_type"]).unionByName(
        R.average_latency(q).withColumn("agent_type", F.lit("all"))
    )
    return both.select("agent_type", _r("avg_latency"))


_TREND_SQL = """SELECT created_at::DATE AS day, q.agent_type AS agent_type,
  round(avg(CASE WHEN e.result = 'PASS' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy
  FROM (SELECT query_id, agent_type, created_at FROM queries) q JOIN (SELECT query_id, result FROM evaluations) e USING (query_id)
  WHERE created_at > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1, 2"""


@query("A4_accuracy_trend", with_tables(_TREND_SQL, "evaluations"))
def trend(spark, d):
    t = R.accuracy_trend(T.queries(spark, d), T.evaluations(spark, d), T.AS_OF)
    return t.select("day", "agent_type", _r("accuracy"))


@query("A4_accuracy_trend_pivot", with_tables(
    f"SELECT day, {', '.join(f'''max(accuracy) FILTER (WHERE agent_type = '{a}') AS {a.capitalize()}''' for a in AGENTS)} "
    f"FROM ({_TREND_SQL}) GROUP BY day", "evaluations"))
def trend_wide(spark, d):
    t = R.accuracy_trend(T.queries(spark, d), T.evaluations(spark, d), T.AS_OF)
    wide = R.pivot_trend(t, AGENTS)
    return wide.select("day", *[_r(a.capitalize()) for a in AGENTS])


@query("A5_drift_distribution", with_tables(
    "SELECT drift_classification, count(*) AS n, round(avg(drift_score), 6) AS avg_drift FROM drift GROUP BY 1", "drift"))
def drift_distribution(spark, d):
    out = R.distribution(T.drift(spark, d), "drift_score", "avg_drift")
    return out.select("drift_classification", "n", _r("avg_drift"))


@query("A6_anomaly_count", with_tables("SELECT count(*) FILTER (WHERE is_anomaly) AS total_anomalies FROM drift", "drift"))
def anomalies(spark, d):
    return R.anomaly_count(T.drift(spark, d))


@query("A7_daily_drift", with_tables(
    "SELECT created_at::DATE AS day, round(avg(drift_score), 6) AS avg_drift FROM drift GROUP BY 1", "drift"))
def daily_drift(spark, d):
    return R.daily_average(T.drift(spark, d), "drift_score", "avg_drift").select("day", _r("avg_drift"))


@query("A8_column_psi_average", """
WITH newest AS (SELECT * FROM lineitem ORDER BY l_shipdate DESC, (l_orderkey * 10 + l_linenumber) DESC, l_partkey DESC, l_suppkey DESC LIMIT 200)
SELECT 'l_discount' AS column_name, round(avg(l_discount), 8) AS avg_psi FROM newest
UNION ALL SELECT 'l_tax', round(avg(l_tax), 8) FROM newest""")
def column_average(spark, d):
    li = read_table(spark, d, "lineitem")
    results = li.select(
        F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_partkey", "l_suppkey").alias("query_id"),
        F.col("l_shipdate").alias("created_at"),
        F.create_map(F.lit("l_discount"), "l_discount", F.lit("l_tax"), "l_tax").alias("psi_scores"),
    )
    return R.column_psi_average(results).select("column_name", _r("avg_psi", 8))


@query("A9_error_rollup", with_tables(
    "SELECT error_category, severity, count(*) AS n FROM errors GROUP BY ROLLUP (error_category, severity) "
    "HAVING error_category IS NOT NULL", "errors"))
def error_rollup(spark, d):
    return R.error_rollup(T.errors(spark, d))


@query("A9_error_summary", with_tables(
    "SELECT error_category, count(*) AS total, count(*) FILTER (WHERE severity = 'high') AS high, "
    "count(*) FILTER (WHERE severity = 'low') AS low FROM errors GROUP BY 1", "errors"))
def error_summary(spark, d):
    s = R.error_summary(T.errors(spark, d))
    def count(level):
        return F.coalesce(F.try_element_at("severities", F.lit(level)), F.lit(0)).alias(level)
    return s.select("error_category", "total", count("high"), count("low"))


@query("A10_pass_rate", with_tables(
    "SELECT complexity, count(*) AS total, round(count(*) FILTER (WHERE result = 'PASS') * 100.0::DOUBLE / nullif(count(*), 0), 6) AS accuracy "
    "FROM evaluations GROUP BY 1", "evaluations"))
def pass_rate(spark, d):
    return R.pass_rate(T.evaluations(spark, d), ["complexity"]).select("complexity", "total", _r("accuracy"))


@query("A11_agent_summary", with_tables("""
SELECT agent_id, agent_name, display_name, coalesce(requests, 0) AS requests, round(coalesce(lat, 0) / 1000.0::DOUBLE, 8) AS latency_s,
  round(coalesce(acc, 0), 6) AS accuracy,
  CASE WHEN health_status = 'healthy' AND coalesce(acc, 0) < 80 AND coalesce(requests, 0) > 5 THEN 'Degraded'
       WHEN health_status = 'healthy' THEN 'Healthy' WHEN health_status = 'unhealthy' THEN 'Unhealthy' ELSE 'Unknown' END AS status
FROM agents
LEFT JOIN (SELECT agent_type, count(*) AS requests, avg(execution_time_ms) AS lat FROM queries GROUP BY 1) q ON agent_name = q.agent_type
LEFT JOIN (SELECT agent_type, count(*) FILTER (WHERE result = 'PASS') * 100.0::DOUBLE / count(*) AS acc FROM evaluations GROUP BY 1) e ON agent_name = e.agent_type""",
    "evaluations", "agents"))
def agent_summary(spark, d):
    s = R.agent_summary(T.agents(spark, d), T.queries(spark, d), T.evaluations(spark, d))
    return s.select("agent_id", "agent_name", "display_name", "requests", _r("latency_s", 8), _r("accuracy"), "status")


@query("A12_recent_mean", with_tables(
    "SELECT round(avg(final_score), 8) AS avg_score, count(*) AS n FROM "
    "(SELECT final_score FROM evaluations ORDER BY created_at DESC, query_id DESC LIMIT 50)", "evaluations"))
def recent_mean(spark, d):
    return R.recent_mean(T.evaluations(spark, d)).select(_r("avg_score", 8), "n")


@query("A13_recent_accuracy_by_agent", with_tables(
    "SELECT agent_type, count(*) AS total, count(*) FILTER (WHERE result = 'PASS') AS passed, "
    "round(count(*) FILTER (WHERE result = 'PASS') * 100.0::DOUBLE / count(*), 6) AS accuracy FROM "
    "(SELECT * FROM evaluations QUALIFY row_number() OVER (PARTITION BY agent_type ORDER BY created_at DESC, query_id DESC) <= 50) GROUP BY 1",
    "evaluations"))
def recent_by_agent(spark, d):
    return R.recent_accuracy_by_agent(T.evaluations(spark, d)).select("agent_type", "total", "passed", _r("accuracy"))


@query("A14_all_time_accuracy", with_tables(
    "SELECT agent_type, count(*) AS total, round(count(*) FILTER (WHERE result = 'PASS') * 100.0::DOUBLE / count(*), 6) AS accuracy "
    "FROM evaluations GROUP BY 1", "evaluations"))
def all_time(spark, d):
    return R.pass_rate(T.evaluations(spark, d), ["agent_type"]).select("agent_type", "total", _r("accuracy"))


@query("A15_top_error_categories", with_tables(
    "SELECT error_category, count(*) AS n FROM errors GROUP BY 1 ORDER BY n DESC, error_category LIMIT 5", "errors"))
def top_errors(spark, d):
    return R.top_error_categories(T.errors(spark, d))


@query("A16_confusion_metrics", """
WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND n_chars > 500) AS tp, count(*) FILTER (WHERE quality <> 1 AND n_chars <= 500) AS tn,
  count(*) FILTER (WHERE quality <> 1 AND n_chars > 500) AS fp, count(*) FILTER (WHERE quality = 1 AND n_chars <= 500) AS fn
  FROM labels JOIN documents USING (doc_id))
SELECT *, round(tp::DOUBLE / (tp + fp), 8) AS precision, round(tp::DOUBLE / (tp + fn), 8) AS recall,
  round(2.0::DOUBLE * tp / (2.0::DOUBLE * tp + fp + fn), 8) AS f1, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 8) AS accuracy FROM c""")
def confusion(spark, d):
    both = read_table(spark, d, "labels").join(read_table(spark, d, "documents").select("doc_id", "n_chars"), ["doc_id"])
    m = R.confusion(both, F.col("quality") == 1, F.col("n_chars") > 500)
    return m.select("tp", "tn", "fp", "fn", *[_r(c, 8) for c in ("precision", "recall", "f1", "accuracy")])


@query("A18_query_kinds", with_tables("""
SELECT CASE WHEN contains(lower(generated_sql), 'join') THEN 'JOIN'
  WHEN regexp_matches(lower(generated_sql), 'count|sum|avg|max|min|group by') THEN 'Aggregation'
  WHEN regexp_matches(lower(generated_sql), 'date|interval|now\\(\\)|date_trunc') THEN 'Date/Time' ELSE 'Simple SELECT' END AS kind, count(*) AS n
FROM queries WHERE generated_sql IS NOT NULL GROUP BY 1""", "queries"))
def kinds(spark, d):
    q = T.queries(spark, d).filter(F.col("generated_sql").isNotNull())
    return q.groupBy(X.query_kind(F.col("generated_sql")).alias("kind")).agg(F.count("*").alias("n"))


@query("A24_distinct_dimensions", "SELECT DISTINCT event_type, user_id FROM events")
def distinct(spark, d):
    return read_table(spark, d, "events").select("event_type", "user_id").distinct()


@query("A25_accuracy_of_last_minutes", with_tables(
    "SELECT count(*) AS total, round(count(*) FILTER (WHERE result = 'PASS') * 100.0::DOUBLE / nullif(count(*), 0), 6) AS accuracy "
    "FROM evaluations WHERE agent_type = 'click' AND created_at > TIMESTAMP '2024-01-30 22:00:00' - INTERVAL 500 MINUTE", "evaluations"))
def last_minutes(spark, d):
    from datetime import datetime
    out = R.accuracy_since(T.evaluations(spark, d), "click", datetime(2024, 1, 30, 22), 500)
    return out.select("total", _r("accuracy"))


@query("F1_agent_filter", with_tables(
    "SELECT count(*) AS n FROM queries WHERE agent_type = 'click'", "queries"))
def agent_filter(spark, d):
    return R.for_agent(T.queries(spark, d), "click").agg(F.count("*").alias("n"))


@query("F2_agent_filter_any_case", with_tables(
    "SELECT count(*) AS n FROM queries WHERE lower(agent_type) = lower('CLICK')", "queries"))
def agent_filter_any_case(spark, d):
    return R.for_agent(T.queries(spark, d), "CLICK", ignore_case=True).agg(F.count("*").alias("n"))


@query("F3_history_validity", with_tables(
    "SELECT agent_type, count(*) FILTER (WHERE generated_sql IS NOT NULL AND generated_sql <> '' "
    "AND generated_sql <> '-- No SQL Generated' AND status <> 'error') AS n FROM queries GROUP BY 1", "queries"))
def validity(spark, d):
    valid = X.has_sql(F.col("generated_sql"), F.col("status"))
    return T.queries(spark, d).groupBy("agent_type").agg(F.count_if(valid).alias("n"))


@query("F11_json_scores", with_tables(
    "SELECT agent_type, count(result_score) AS checked, count(*) FILTER (WHERE result_score IS NULL) AS unchecked, "
    "round(avg(result_score), 6) AS avg_result FROM evaluations GROUP BY 1", "evaluations"))
def json_scores(spark, d):
    e = T.evaluations(spark, d).withColumn("r", R.result_score(F.col("evaluation_data")))
    missing = F.get_json_object("evaluation_data", "$.steps.result_validation").isNull()
    return e.groupBy("agent_type").agg(
        F.count("r").alias("checked"), F.count_if(missing).alias("unchecked"), F.round(F.avg("r"), 6).alias("avg_result"))


@query("F12_execution_search", with_tables(
    "SELECT query_id FROM evaluations WHERE contains(lower(query_text), 'TOP') OR contains(lower(query_text), 'top') "
    "OR contains(lower(agent_type), 'top') OR contains(lower(result), 'top')", "evaluations"))
def search(spark, d):
    return R.search_executions(T.evaluations(spark, d), "TOP", ["query_text", "agent_type", "result"]).select("query_id")


@query("F16_display_defaults", with_tables("""
SELECT coalesce(result, 'N/A') AS verdict, coalesce(nullif(error_category, ''), 'None') AS error_bucket, count(*) AS n
FROM queries LEFT JOIN (SELECT query_id, result FROM evaluations) USING (query_id)
LEFT JOIN (SELECT query_id, error_category FROM errors) USING (query_id) GROUP BY ALL""", "evaluations", "errors"))
def defaults(spark, d):
    joined = (
        T.queries(spark, d).select("query_id")
        .join(T.evaluations(spark, d).select("query_id", "result"), ["query_id"], "left")
        .join(T.errors(spark, d).select("query_id", "error_category"), ["query_id"], "left")
    )
    return joined.groupBy(
        F.coalesce("result", F.lit("N/A")).alias("verdict"),
        F.coalesce(F.nullif("error_category", F.lit("")), F.lit("None")).alias("error_bucket"),
    ).agg(F.count("*").alias("n"))


@query("J1_queries_with_evaluations", with_tables(
    "SELECT q.agent_type AS agent_type, complexity, count(*) AS n, round(avg(execution_time_ms), 6) AS latency FROM queries q "
    "JOIN (SELECT query_id, complexity FROM evaluations) e USING (query_id) GROUP BY ALL", "evaluations"))
def queries_evaluations(spark, d):
    return (
        T.queries(spark, d).select("query_id", "agent_type", "execution_time_ms")
        .join(T.evaluations(spark, d).select("query_id", "complexity"), ["query_id"])
        .groupBy("agent_type", "complexity")
        .agg(F.count("*").alias("n"), F.round(F.avg("execution_time_ms"), 6).alias("latency"))
    )


@query("J2_drift_with_queries", with_tables(
    "SELECT user_id, count(*) AS n, round(max(drift_score), 6) AS worst FROM drift JOIN (SELECT query_id, user_id FROM queries) USING (query_id) GROUP BY 1", "drift"))
def drift_queries(spark, d):
    return (
        T.drift(spark, d).select("query_id", "drift_score").join(T.queries(spark, d).select("query_id", "user_id"), ["query_id"])
        .groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("drift_score"), 6).alias("worst"))
    )


@query("J3_errors_with_optional_query", with_tables(
    "SELECT e.query_id AS query_id, error_category, coalesce(query_text, 'Unknown') AS query_text FROM errors e "
    "LEFT JOIN (SELECT query_id, query_text FROM queries WHERE execution_time_ms > 10) q USING (query_id)", "errors"))
def errors_optional(spark, d):
    q = T.queries(spark, d).filter(F.col("execution_time_ms") > 10).select("query_id", "query_text")
    return T.errors(spark, d).select("query_id", "error_category").join(q, ["query_id"], "left").withColumn(
        "query_text", F.coalesce("query_text", F.lit("Unknown")))


@query("J4_history_joins", with_tables(
    "SELECT agent_type, count(*) AS n, count(result) AS evaluated, count(error_category) AS failed, count(drift_score) AS scored "
    "FROM queries LEFT JOIN (SELECT query_id, result FROM evaluations) USING (query_id) LEFT JOIN (SELECT query_id, error_category FROM errors) USING (query_id) "
    "LEFT JOIN (SELECT query_id, drift_score FROM drift) USING (query_id) GROUP BY 1", "evaluations", "errors", "drift"))
def history_joins(spark, d):
    return (
        T.queries(spark, d).select("query_id", "agent_type")
        .join(T.evaluations(spark, d).select("query_id", "result"), ["query_id"], "left")
        .join(T.errors(spark, d).select("query_id", "error_category"), ["query_id"], "left")
        .join(T.drift(spark, d).select("query_id", "drift_score"), ["query_id"], "left")
        .groupBy("agent_type")
        .agg(F.count("*").alias("n"), F.count("result").alias("evaluated"),
             F.count("error_category").alias("failed"), F.count("drift_score").alias("scored"))
    )


@query("J5_run_details", with_tables(
    "SELECT q.query_id AS query_id, q.agent_type AS agent_type, coalesce(result, 'PENDING') AS verdict, round(coalesce(confidence, 0), 8) AS confidence, "
    "round(coalesce(final_score, 0), 8) AS score, round(coalesce(drift_score, 0), 8) AS drift_score, coalesce(drift_classification, 'unknown') AS drift_status "
    "FROM queries q LEFT JOIN evaluations e ON q.query_id = e.query_id LEFT JOIN drift r ON q.query_id = r.query_id", "evaluations", "drift"))
def details(spark, d):
    out = R.run_details(T.queries(spark, d), T.evaluations(spark, d).drop("ground_truth_sql"), T.drift(spark, d))
    return out.select("query_id", "agent_type", "verdict", _r("confidence", 8), _r("score", 8), _r("drift_score", 8), "drift_status")


@query("J6_unevaluated_queries", with_tables(
    "SELECT query_id FROM queries q WHERE status = 'success' AND generated_sql IS NOT NULL AND NOT EXISTS (SELECT 1 FROM evaluations e WHERE e.query_id = q.query_id)", "evaluations"))
def unevaluated(spark, d):
    from veriscope.operators.scoring import unevaluated as anti
    return anti(T.queries(spark, d), T.evaluations(spark, d)).select("query_id")


@query("J7_errors_of_slow_agents", with_tables(
    "SELECT query_id, error_category FROM errors WHERE query_id IN (SELECT query_id FROM queries WHERE execution_time_ms > 100)", "errors"))
def semi(spark, d):
    slow = T.queries(spark, d).filter(F.col("execution_time_ms") > 100).select("query_id")
    return T.errors(spark, d).select("query_id", "error_category").join(slow, ["query_id"], "left_semi")


@query("J8_first_event_per_user_and_type", """
SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL""")
def distinct_on(spark, d):
    from veriscope.operators.ordering import first_per_key
    e = read_table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return first_per_key(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("J9_agents_with_recent_telemetry", with_tables(
    "SELECT agent_name FROM agents a WHERE EXISTS (SELECT 1 FROM queries q WHERE q.agent_type = a.agent_name AND created_at > TIMESTAMP '2024-01-30 23:50:00')", "queries", "agents"))
def recent_agents(spark, d):
    from datetime import datetime
    since = F.lit(datetime(2024, 1, 30, 23, 50)).cast("timestamp_ntz")
    recent = T.queries(spark, d).filter(F.col("created_at") > since).select(F.col("agent_type").alias("agent_name"))
    return T.agents(spark, d).select("agent_name").join(recent, ["agent_name"], "left_semi")


@query("W2_last_three_per_agent", with_tables(
    "SELECT agent_type, query_id, row_number() OVER (PARTITION BY agent_type ORDER BY created_at DESC, query_id DESC)::INTEGER AS rank FROM evaluations "
    "QUALIFY row_number() OVER (PARTITION BY agent_type ORDER BY created_at DESC, query_id DESC) <= 3", "evaluations"))
def last_three(spark, d):
    e = T.evaluations(spark, d).select("agent_type", "query_id", "created_at")
    return top_per_key(e, ["agent_type"], [F.col("created_at").desc(), F.col("query_id").desc()], 3).drop("created_at")


@query("W3_rolling_accuracy", with_tables(
    "SELECT query_id, agent_type, round(avg(CASE WHEN result = 'PASS' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) "
    "OVER (PARTITION BY agent_type ORDER BY created_at, query_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS rolling_accuracy FROM evaluations", "evaluations"))
def rolling(spark, d):
    e = T.evaluations(spark, d).select(
        "query_id", "agent_type", "created_at", F.when(F.col("result") == "PASS", 100.0).otherwise(0.0).alias("hit"))
    out = rolling_last_n(e, ["agent_type"], ["created_at", "query_id"], "hit", 50, "rolling_accuracy")
    return out.select("query_id", "agent_type", _r("rolling_accuracy"))


_DAILY_SQL = """daily AS (SELECT agent_type, created_at::DATE AS day, count(*) AS total,
  count(*) FILTER (WHERE result = 'PASS') * 100.0::DOUBLE / count(*) AS accuracy FROM evaluations GROUP BY ALL)"""


def _daily(spark, d):
    return R.pass_rate(
        T.evaluations(spark, d).withColumn("day", F.to_date("created_at")), ["agent_type", "day"])


@query("W4_accuracy_drop", with_tables(
    "SELECT agent_type, day, total AS sample_size, round(accuracy, 6) AS current_accuracy, round(previous, 6) AS previous_accuracy, "
    "round(previous - accuracy, 6) AS drop, CASE WHEN previous - accuracy > 10 THEN 'high' ELSE 'medium' END AS severity "
    "FROM (SELECT *, lag(accuracy) OVER (PARTITION BY agent_type ORDER BY day) AS previous FROM daily) WHERE previous - accuracy > 0",
    "evaluations", extra=_DAILY_SQL))
def accuracy_drop(spark, d):
    out = L.accuracy_drop_alerts(_daily(spark, d))
    return out.select("agent_type", "day", "sample_size", _r("current_accuracy"), _r("previous_accuracy"), _r("drop"), "severity")


@query("W6_yearly_growth", """
SELECT l_returnflag, year, quantity, quantity - lag(quantity) OVER (PARTITION BY l_returnflag ORDER BY year) AS change
FROM (SELECT l_returnflag, year(l_shipdate)::INTEGER AS year, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY 1, 2)""")
def yearly(spark, d):
    y = read_table(spark, d, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("year")).agg(
        F.sum("l_quantity").alias("quantity"))
    return R.period_change(y, ["l_returnflag"], "year", "quantity").drop("previous")


@query("K1_top_drift", with_tables(
    "SELECT d.query_id AS query_id, round(drift_score, 8) AS drift_score, query_text FROM (SELECT * FROM drift WHERE drift_classification = 'high' "
    "ORDER BY drift_score DESC, query_id LIMIT 20) d LEFT JOIN queries q USING (query_id)", "drift"))
def top_drift(spark, d):
    top = R.high_samples(T.drift(spark, d), T.queries(spark, d).select("query_id", "query_text"),
                         [F.col("drift_score").desc(), F.col("query_id")])
    return top.select("query_id", _r("drift_score", 8), "query_text")


@query("K2_latest_high_drift", with_tables(
    "SELECT query_id, created_at FROM drift WHERE drift_classification = 'high' ORDER BY created_at DESC, query_id LIMIT 20", "drift"))
def latest_high(spark, d):
    top = R.high_samples(T.drift(spark, d), T.queries(spark, d).select("query_id", "query_text"),
                         [F.col("created_at").desc(), F.col("query_id")])
    return top.select("query_id", "created_at")


@query("K3_recent_errors", with_tables(
    "SELECT query_id, error_category, severity, coalesce(nullif(query_text, ''), 'Unknown') AS query_text FROM "
    "(SELECT * FROM errors WHERE error_category = 'INTEGRATION' ORDER BY first_seen DESC, query_id DESC LIMIT 20) LEFT JOIN (SELECT query_id, query_text FROM queries) USING (query_id)", "errors"))
def recent_errors(spark, d):
    out = R.recent_errors(T.errors(spark, d), T.queries(spark, d), category="INTEGRATION", agent="error")
    return out.select("query_id", "error_category", "severity", "query_text")


@query("K4_errors_of_category", with_tables(
    "SELECT query_id, error_message, severity, suggested_fix, first_seen FROM errors WHERE error_category = 'DATA_ERROR'", "errors"))
def category_errors(spark, d):
    e = T.errors(spark, d).filter(F.col("error_category") == "DATA_ERROR")
    return e.select("query_id", "error_message", "severity", "suggested_fix", "first_seen").orderBy(
        F.col("first_seen").desc(), "query_id")


@query("K5_history", with_tables("""
SELECT q.query_id AS query_id, q.agent_type AS agent_type, q.created_at AS created_at, coalesce(result, 'N/A') AS verdict,
  round(coalesce(confidence, 0), 8) AS confidence, 'None' AS error_bucket, round(coalesce(drift_score, 0), 8) AS drift_score,
  coalesce(drift_classification, 'N/A') AS drift_level, result_score AS output_score
FROM (SELECT * FROM queries WHERE generated_sql IS NOT NULL AND status <> 'error' ORDER BY created_at DESC, query_id LIMIT 50) q
LEFT JOIN (SELECT query_id, result, confidence, result_score FROM evaluations) e USING (query_id)
LEFT JOIN (SELECT query_id, drift_score, drift_classification FROM drift) r USING (query_id)""", "evaluations", "drift"))
def history(spark, d):
    h = R.history(T.queries(spark, d), T.evaluations(spark, d), T.errors(spark, d), T.drift(spark, d),
                  X.has_sql(F.col("generated_sql"), F.col("status")))
    return h.select("query_id", "agent_type", "created_at", "verdict", _r("confidence", 8), "error_bucket",
                    _r("drift_score", 8), "drift_level", "output_score")


@query("K8_recent_failures", with_tables(
    "SELECT query_id, round(final_score, 8) AS final_score FROM evaluations WHERE result = 'FAIL' ORDER BY created_at DESC, query_id DESC LIMIT 10", "evaluations"))
def failures(spark, d):
    failed = R.last_evaluations(T.evaluations(spark, d).filter(F.col("result") == "FAIL"), 10)
    return failed.select("query_id", _r("final_score", 8))


@query("K9_newest_mention", with_tables(
    "SELECT query_id, query_text FROM evaluations WHERE query_text LIKE '%segments%' ORDER BY created_at DESC, query_id DESC LIMIT 1", "evaluations"))
def mention(spark, d):
    return R.last_evaluations(T.evaluations(spark, d).filter(F.col("query_text").like("%segments%")), 1).select("query_id", "query_text")


@query("K10_agents_newest_first", with_tables(
    "SELECT agent_id, agent_name, created_at FROM agents ORDER BY created_at DESC, agent_id", "agents"))
def newest_agents(spark, d):
    return T.agents(spark, d).select("agent_id", "agent_name", "created_at").orderBy(
        F.col("created_at").desc(), "agent_id")


@query("L1_accuracy_alert", with_tables(
    "SELECT 'accuracy_degradation' AS alert, 'warning' AS severity, 'Based on last ' || n || ' evaluations.' AS message, round(s, 8) AS avg_score, n FROM "
    "(SELECT avg(final_score) AS s, count(*) AS n FROM (SELECT final_score FROM evaluations ORDER BY created_at DESC, query_id DESC LIMIT 50)) WHERE n > 5 AND s < 0.9", "evaluations"))
def accuracy_alert(spark, d):
    return L.accuracy_alert(T.evaluations(spark, d)).withColumn("avg_score", F.round("avg_score", 8))


@query("L2_high_drift_alert", with_tables(
    "SELECT 'high_drift' AS alert, CASE WHEN n > 3 THEN 'critical' ELSE 'warning' END AS severity, n || ' High Drift queries detected in last 24h.' AS message, n "
    "FROM (SELECT count(*) AS n FROM drift WHERE drift_classification = 'high' AND created_at > TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR) WHERE n > 0", "drift"))
def drift_alert(spark, d):
    return L.high_drift_alert(T.drift(spark, d), T.queries(spark, d), T.AS_OF)


@query("L3_query_drift_alerts", with_tables(
    "SELECT query_id, agent_type, round(drift_score, 8) AS drift_score, 'query_high_drift' AS alert, 'high' AS severity, "
    "query_text AS message "
    "FROM drift JOIN (SELECT query_id, query_text FROM queries) USING (query_id) WHERE drift_classification = 'high'", "drift"))
def query_alerts(spark, d):
    scored = T.drift(spark, d).join(T.queries(spark, d).select("query_id", "query_text"), ["query_id"])
    return L.query_drift_alerts(scored).withColumn("drift_score", F.round("drift_score", 8))


@query("L4_critical_errors", with_tables(
    "SELECT query_id, error_category, 'critical_error' AS alert, 'critical' AS severity, error_message AS message FROM errors WHERE severity = 'critical'", "errors"))
def critical(spark, d):
    return L.critical_error_alerts(T.errors(spark, d))


@query("L4_error_spikes", with_tables("""
SELECT hour, sum(n)::BIGINT AS error_count, string_agg(CASE WHEN place <= 3 THEN error_category || ': ' || n END, '; ' ORDER BY place) AS top_errors
FROM (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY n DESC, error_category) AS place FROM
  (SELECT date_trunc('hour', created_at) AS hour, error_category, count(*) AS n FROM errors GROUP BY ALL))
GROUP BY hour HAVING sum(n) > 3""", "errors"))
def spikes(spark, d):
    return L.error_spike_alerts(T.errors(spark, d), limit=3).select("hour", "error_count", "top_errors")


@query("L4_system_down", with_tables("""
SELECT agent_name, 'system_down' AS alert, 'critical' AS severity, 'Health check failed — agent unreachable and no recent telemetry' AS message
FROM agents LEFT JOIN (SELECT agent_type, max(created_at) AS seen FROM queries GROUP BY 1) ON agent_type = agent_name
WHERE agent_url IS NOT NULL AND NOT is_up AND NOT coalesce(seen > TIMESTAMP '2024-01-31' - INTERVAL 10 MINUTE, false)""", "queries", "agents"))
def system_down(spark, d):
    return L.system_down_alerts(L.telemetry_health(T.agents(spark, d), T.queries(spark, d), T.AS_OF))


@query("L5_alerts_by_severity", with_tables(
    "SELECT severity, count(*) AS n FROM (SELECT 'high' AS severity FROM drift WHERE drift_classification = 'high' UNION ALL "
    "SELECT 'critical' FROM errors WHERE severity = 'critical') GROUP BY 1", "drift", "errors"))
def by_severity(spark, d):
    scored = T.drift(spark, d).withColumn("query_text", F.lit(""))
    both = L.query_drift_alerts(scored).select("severity").unionByName(
        L.critical_error_alerts(T.errors(spark, d)).select("severity"))
    return L.alerts_by_severity(both)


@query("H1_telemetry_health", with_tables("""
SELECT agent_name, CASE WHEN agent_url IS NULL THEN 'unknown' WHEN seen > as_of - INTERVAL 10 MINUTE THEN 'healthy'
  WHEN is_up THEN 'sdk_issue' ELSE 'unhealthy' END AS health_status, seen AS last_seen
FROM agents LEFT JOIN (SELECT agent_type, max(created_at) AS seen FROM queries GROUP BY 1) ON agent_type = agent_name,
     (SELECT TIMESTAMP '2024-01-30 23:58:00' AS as_of)""", "queries", "agents"))
def health(spark, d):
    from datetime import datetime
    out = L.telemetry_health(T.agents(spark, d), T.queries(spark, d), datetime(2024, 1, 30, 23, 58))
    return out.select("agent_name", "health_status", "last_seen")


@query("H2_agent_projection", with_tables(
    "SELECT agent_id, agent_name, health_status, agent_url, n AS requests FROM agents JOIN (SELECT agent_type, count(*) AS n FROM queries GROUP BY 1) ON agent_type = agent_name", "queries", "agents"))
def projection(spark, d):
    n = T.queries(spark, d).groupBy(F.col("agent_type").alias("agent_name")).agg(F.count("*").alias("requests"))
    return T.agents(spark, d).join(n, ["agent_name"]).select("agent_id", "agent_name", "health_status", "agent_url", "requests")


@query("E1_error_categories", with_tables(
    "SELECT query_id, error_category, severity, error_category <> 'UNKNOWN' AS stored FROM errors", "errors"))
def categories(spark, d):
    return T.errors(spark, d).select("query_id", "error_category", "severity", "stored")


@query("E1_document_messages", f"""
WITH c AS (SELECT {T._category_sql('text')} AS c FROM documents)
SELECT CASE c WHEN 'DEFAULT' THEN 'AGENT_LOGIC' ELSE c END AS error_category, count(*) AS n FROM c GROUP BY 1""")
def document_messages(spark, d):
    docs = spread(read_table(spark, d, "documents")).select("doc_id", F.col("text").alias("error_message"))
    return E.classify_errors(docs).groupBy("error_category").agg(F.count("*").alias("n"))


@query("E2_advice", with_tables(
    "SELECT error_category, severity, suggested_fix, count(*) AS n FROM errors GROUP BY ALL", "errors"))
def advice(spark, d):
    return T.errors(spark, d).groupBy("error_category", "severity", "suggested_fix").agg(F.count("*").alias("n"))


@query("E3_errors_to_classify", with_tables("""
SELECT origin, count(*) AS n FROM (
  SELECT 'agent' AS origin FROM queries WHERE status = 'error' AND error <> ''
  UNION ALL SELECT 'structural' FROM queries WHERE contains(generated_sql, 'unlisted_table')
  UNION ALL SELECT 'evaluation' FROM queries WHERE execution_time_ms > 200) GROUP BY 1""", "queries"))
def to_classify(spark, d):
    q = T.queries(spark, d)
    failed = q.withColumns(
        {"requires_classification": F.coalesce(F.contains("generated_sql", F.lit("unlisted_table")), F.lit(False)),
         "error_message": F.lit("table not found")})
    crashed = q.filter(F.col("execution_time_ms") > 200).withColumn("error_message", F.lit("timeout"))
    return E.errors_to_classify(q, failed, crashed).groupBy("origin").agg(F.count("*").alias("n"))


@query("S30_error_frequency", with_tables(
    "SELECT error_category, error_message, count(*) AS frequency_count, min(created_at) AS first_seen, max(created_at) AS last_seen FROM errors GROUP BY 1, 2", "errors"))
def frequency(spark, d):
    return E.error_frequency(T.errors(spark, d))
