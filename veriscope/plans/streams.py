"""Streaming queries: run to the end of the event file and compared with their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriscope import constants as K
from veriscope.operators import catalog as C
from veriscope.operators.assessment import ASSESSED, assess
from veriscope.operators.drift import centroids, drift_class
from veriscope.plans import drift as D
from veriscope.plans import scoring as E
from veriscope.plans import standin as T
from veriscope.plans.quality import COLUMNS
from veriscope.plans.drift import embedding_baselines
from veriscope.plans.registry import query
from veriscope.plans.standin import with_tables
from veriscope.session import written
from veriscope.sources.files import folder_tables, read_table, read_tables, stream_files
from veriscope.sources.snapshots import SnapshotTable, upsert_batches
from veriscope.streaming import telemetry as M
from veriscope.streaming.lateness import through_gate
from veriscope.streaming.runs import collect_stream, fresh_path, merge_sessions_locally, run_to_end
from veriscope.streaming.silence import silent_agents


def _events(spark, d):
    """Event stream in telemetry form."""
    e = M.read_events(spark, d)
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("query_id"), F.col("event_type").alias("agent_type"), F.col("ts").cast("timestamp").alias("created_at"),
        F.col("value").alias("execution_time_ms"), F.when(failed, "error").otherwise("success").alias("status"),
        (1.0 - F.least(F.col("value") / 100.0, F.lit(1.0))).alias("similarity"))


def _ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("T1_scored_stream", with_tables("""
SELECT agent_type, 'scored' AS kind, count(*) AS n FROM queries WHERE status = 'success' AND generated_sql IS NOT NULL GROUP BY 1
UNION ALL SELECT agent_type, 'error', count(*) FROM queries WHERE status = 'error' GROUP BY 1
UNION ALL SELECT 'embeddings', 'drift', count(*) FROM embeddings""", "queries"))
def scored(spark, d):
    measures, dimensions = C.measures_and_dimensions(read_tables(spark, d, ["orders", "lineitem"]))
    path = fresh_path(spark, "scored")
    e = M.read_events(spark, d)
    n = F.floor("value").cast("string")
    failed = F.col("event_type") == "error"
    # the stand-in columns again, on the stream
    stream = e.select(
        F.col("event_id").alias("query_id"), F.col("event_type").alias("agent_type"), F.col("ts").alias("created_at"),
        T._pick([q for q, _, _ in T.CORPUS], n).alias("query_text"),
        F.when(~failed, T._pick([s for _, s, _ in T.CORPUS], n)).alias("generated_sql"),
        F.when(failed, T._pick(T.MESSAGES, n)).alias("error"),
        F.when(failed, "error").otherwise("success").alias("status"))
    run_to_end(stream, path, write=M.scoring_batch(path, measures, dimensions))
    vectors = (
        stream_files(spark, d, "embeddings.parquet", read_table(spark, d, "embeddings").schema)
        .select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("agent_type"), "embedding",
                F.lit("success").alias("status"), F.lit("q").alias("query_text"), F.lit("SELECT 1").alias("generated_sql"),
                F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    )
    drift_path = fresh_path(spark, "scored-drift")
    run_to_end(vectors, drift_path, write=M.scoring_batch(drift_path, measures, dimensions, lambda s: embedding_baselines(s, d)))

    def counted(folder, kind, key=F.col("agent_type")):
        rows = spark.read.parquet(folder)
        return rows.groupBy(key.alias("agent_type")).agg(F.count("*").alias("n")).select("agent_type", F.lit(kind).alias("kind"), "n")

    return (
        counted(f"{path}/scores", "scored").unionByName(counted(f"{path}/errors", "error"))
        .unionByName(counted(f"{drift_path}/drift", "drift", F.lit("embeddings")))
    )


# what the engine said of a statement, as a message of its kind
_ENGINE_MESSAGES = {
    "UNDEFINED_TABLE": "relation unlisted_table does not exist", "UNDEFINED_COLUMN": "column unlisted_column does not exist",
    "SYNTAX_ERROR": "syntax error at or near not",
}
_ENGINE_MESSAGE_SQL = "CASE engine_error_type " + " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in _ENGINE_MESSAGES.items()) + " END"
_ASSESSED_INPUT_SQL = E._EVAL_INPUT_SQL.replace(
    "greatest(0.0::DOUBLE, 1.0::DOUBLE - s.execution_time_ms / 100.0::DOUBLE) AS drift_quality",
    "CASE WHEN v.sim IS NULL THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, v.sim) END AS drift_quality",
).replace("FROM structural s JOIN", "FROM structural s LEFT JOIN vsims v ON v.vec_id = s.query_id JOIN")
_VECTORS_SQL = """cells AS (SELECT vec_id, event_type AS agent, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
  FROM embeddings JOIN events ON event_id = vec_id),
lengths AS (SELECT vec_id, sqrt(sum(x * x)) AS size FROM cells GROUP BY vec_id),
means AS (SELECT agent, pos, avg(x) AS m FROM cells JOIN lengths USING (vec_id) WHERE size > 0.01 GROUP BY ALL),
centroids AS (SELECT agent, list(m ORDER BY pos) AS c FROM means GROUP BY agent),
vsims AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], c) AS sim FROM embeddings JOIN events ON event_id = vec_id JOIN centroids ON agent = event_type)"""


@query("T1_assessed_stream", with_tables(f"""
SELECT q.query_id, q.agent_type, CASE WHEN q.status <> 'error' THEN round(1.0::DOUBLE - v.sim, 8) END AS drift_score,
  CASE WHEN q.status = 'error' THEN NULL WHEN v.sim IS NULL THEN 'embedding_failed' WHEN v.sim >= 0.7 THEN 'normal' WHEN v.sim >= 0.5 THEN 'medium' ELSE 'high' END AS drift_state,
  f.eval_path, round(f.final_score, 8) AS final_score, CASE WHEN f.final_score >= 0.6 THEN 'PASS' WHEN f.final_score IS NOT NULL THEN 'FAIL' END AS result,
  round(CASE WHEN f.eval_path IN ('heuristic', 'heuristic_fallback') THEN f.final_score WHEN f.eval_path = 'ground_truth' THEN (0.8::DOUBLE + f.final_score) / 2
    WHEN f.eval_path IN ('non_business', 'no_from') THEN 1.0 WHEN f.eval_path IS NOT NULL THEN 0.0 END, 8)::DOUBLE AS confidence,
  CASE WHEN p.state IS NULL THEN p.psi END AS psi,
  coalesce(p.state, CASE WHEN p.psi IS NULL THEN NULL ELSE {D._CLASS_SQL.format(p='p.psi')} END) AS psi_state, c.error_category, c.severity
FROM queries q LEFT JOIN vsims v ON v.vec_id = q.query_id LEFT JOIN finals f USING (query_id)
LEFT JOIN (SELECT query_id, psi, CASE WHEN regexp_matches(upper(cleaned_sql), '\\bGROUP\\s+BY\\b|\\b(SUM|AVG|COUNT|MAX|MIN)\\s*\\(') THEN 'aggregate_query'
    WHEN psi IS NULL THEN 'empty_result' END AS state
  FROM finals LEFT JOIN (SELECT k AS query_id, max(psi) AS psi FROM column_psi GROUP BY k) USING (query_id) WHERE eval_path <> 'non_data_reply') p USING (query_id)
LEFT JOIN (SELECT query_id, CASE cat WHEN 'DEFAULT' THEN 'AGENT_LOGIC' ELSE cat END AS error_category,
    CASE cat {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in K.ERROR_SEVERITY.items())} ELSE 'low' END AS severity
  FROM (SELECT query_id, {T._category_sql('message')} AS cat FROM (
    SELECT query_id, error AS message FROM queries WHERE status = 'error' UNION ALL SELECT query_id, {_ENGINE_MESSAGE_SQL} FROM structural) WHERE message <> '')) c USING (query_id)""",
    "queries", extra=",\n".join((E._CLEAN_SQL, _VECTORS_SQL, D._BASE_SQL.replace("l_suppkey", "l_orderkey"), D._column_psi_sql("query_id"),
                                 E._KNOWN_SQL, E._STRUCT_SQL, E._INTENT_SQL, E._PATTERN_SQL, E._SIM_SQL, _ASSESSED_INPUT_SQL))))
def assessed(spark, d):
    """Drift, verdict, result drift and error class of every event, upserted by query_id batch for batch."""
    path = _dealt(spark, d, "assessed", ("event_id % 2 = 0", "event_id % 2 = 1"))
    stream = M.read_events(spark, f"{path}/events.parquet", "*.parquet", files_per_batch=1)
    table = SnapshotTable(spark, f"{path}/assessed", ASSESSED, ["query_id"])
    run_to_end(stream, path, write=upsert_batches(table, assessed_events(spark, d)))
    return table.read().select(
        "query_id", "agent_type", F.round("drift_score", 8).alias("drift_score"), "drift_state", "eval_path", F.round("final_score", 8).alias("final_score"),
        "result", F.round("confidence", 8).alias("confidence"), "psi", "psi_state", "error_category", "severity")


def assessed_events(spark, d):
    """Function from a batch of events to their assessment; the stand-in columns are made on the batch."""
    tables = read_tables(spark, d, E._TABLES)
    measures, dimensions = C.measures_and_dimensions({t: tables[t] for t in ("orders", "lineitem")})
    vectors = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    events = read_table(spark, d, "events").select(F.col("event_id").alias("query_id"), F.col("event_type").alias("agent_type"))
    agents = F.explode(F.array(*[F.lit(a) for a in ("click", "error", "purchase", "signup", "view")]))
    fixed = {
        "catalog": C.catalog_rows(spark, tables), "measures": measures, "dimensions": dimensions,
        "baselines": written(centroids(events.join(vectors, ["query_id"]))),
        "results": tables["lineitem"].select(F.col("l_orderkey").alias("query_id"), *D._METRICS), "result_columns": D._METRICS,
        "result_baseline": written(D.lineitem_baseline(spark, d).withColumn("agent_type", agents)),
    }

    def run(batch):
        asked = E.reported_by_engine(T.with_standin_columns(batch)).join(vectors, ["query_id"], "left")
        ms, has = F.col("execution_time_ms"), F.col("ground_truth_sql").isNotNull()
        message = F.create_map(*[F.lit(x) for pair in _ENGINE_MESSAGES.items() for x in pair])[F.col("engine_error_type")]
        return assess(asked.withColumns({
            "engine_error": message, "judge_score": F.when(has, F.when(ms < 60, 1.0).otherwise(0.0)), "judge_confidence": F.lit(0.8),
            "result_score": F.when(ms > 8, (F.col("query_id") * 53 % 101) / 100.0),
        }), **fixed)

    return run


@query("T2_high_drift_windows", """
WITH h AS (SELECT ts FROM events WHERE 1.0::DOUBLE - least(value / 100.0::DOUBLE, 1.0::DOUBLE) < 0.5 AND event_type <> 'error'),
w AS (SELECT unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS window_start FROM h)
SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*) AS n, CASE WHEN count(*) > 3 THEN 'critical' ELSE 'warning' END AS severity FROM w GROUP BY 1""")
def high_drift(spark, d):
    e = _events(spark, d).filter(F.col("status") == "success").withColumn("drift_classification", drift_class(F.col("similarity")))
    out = collect_stream(M.high_drift_counts(e), "high-drift", ["window_start", "window_end"], "update")
    return _ntz(out, "window_start", "window_end")


@query("T3_daily_accuracy", """
SELECT date_trunc('day', ts) AS day, event_type AS agent_type, count(*) AS total, count(*) FILTER (WHERE value < 60) AS passed,
  round(count(*) FILTER (WHERE value < 60) * 100.0::DOUBLE / count(*), 6) AS accuracy FROM events GROUP BY ALL""")
def daily(spark, d):
    e = _events(spark, d).withColumn("result", F.when(F.col("execution_time_ms") < 60, "PASS").otherwise("FAIL"))
    out = collect_stream(M.daily_accuracy(e), "daily", ["day", "agent_type"], "update")
    return _ntz(out, "day").withColumn("accuracy", F.round("accuracy", 6))


@query("T4_telemetry_sessions", """
WITH s AS (SELECT event_type, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 10 MINUTE
     OR lag(ts) OVER (PARTITION BY event_type ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT event_type AS agent_type, min(ts) AS session_start, max(ts) + INTERVAL 10 MINUTE AS session_end, count(*) AS events FROM g GROUP BY event_type, g
HAVING max(ts) + INTERVAL 10 MINUTE < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def sessions(spark, d):
    """Sessions that the watermark has closed."""
    merge_sessions_locally(spark)
    out = collect_stream(M.telemetry_sessions(_events(spark, d)), "sessions")
    return _ntz(out, "session_start", "session_end")


@query("T4_silent_agents", """
WITH s AS (SELECT event_type, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 10 MINUTE
     OR lag(ts) OVER (PARTITION BY event_type ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT event_type AS agent_type, min(ts) AS first_seen, max(ts) AS last_seen, max(ts) + INTERVAL 10 MINUTE AS silent_since, count(*) AS events FROM g GROUP BY event_type, g
HAVING max(ts) + INTERVAL 10 MINUTE < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def silences(spark, d):
    """Silences that had lasted ten minutes when the watermark passed them."""
    out = collect_stream(silent_agents(_events(spark, d)), "silent")
    return _ntz(out, "first_seen", "last_seen", "silent_since")


def _dealt(spark, d, name, parts):
    """Events as files of a fresh folder, one per condition, written (and so streamed) in that order."""
    path = fresh_path(spark, name)
    for part in parts:
        read_table(spark, d, "events").filter(part).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return path


# days in the order in which their files arrive: the third quarter of the month before the second
_QUARTERS = ("day(ts) <= 8", "day(ts) > 16 AND day(ts) <= 24", "day(ts) > 8 AND day(ts) <= 16", "day(ts) > 24")


@query("T5_late_rows", """
WITH q AS (SELECT *, CASE WHEN day(ts) <= 8 THEN 0 WHEN day(ts) <= 16 THEN 2 WHEN day(ts) <= 24 THEN 1 ELSE 3 END AS batch FROM events),
m AS (SELECT batch, max(ts) AS newest, count(*) AS n FROM q GROUP BY 1),
w AS (SELECT b.batch, max(a.newest) - INTERVAL 1 HOUR AS mark FROM m b LEFT JOIN m a ON a.batch < b.batch GROUP BY b.batch)
SELECT batch::BIGINT AS batch_id, mark AS watermark, count(*) FILTER (WHERE NOT coalesce(ts < mark, false)) AS kept,
  count(*) FILTER (WHERE coalesce(ts < mark, false)) AS late FROM q JOIN w USING (batch) GROUP BY ALL""")
def late_rows(spark, d):
    """What a gate of one hour keeps and finds late when a quarter of the month arrives out of order."""
    path = _dealt(spark, d, "late", _QUARTERS)
    stream = M.read_events(spark, f"{path}/events.parquet", "*.parquet", files_per_batch=1)
    return through_gate(stream, fresh_path(spark, "gate"), "ts").report().select("batch_id", "watermark", "kept", "late")


@query("T3_daily_accuracy_of_kept_rows", """
WITH q AS (SELECT *, CASE WHEN day(ts) <= 8 THEN 0 WHEN day(ts) <= 16 THEN 2 WHEN day(ts) <= 24 THEN 1 ELSE 3 END AS batch FROM events),
m AS (SELECT batch, max(ts) AS newest FROM q GROUP BY 1),
w AS (SELECT b.batch, max(a.newest) - INTERVAL 1 HOUR AS mark FROM m b LEFT JOIN m a ON a.batch < b.batch GROUP BY b.batch)
SELECT date_trunc('day', ts) AS day, event_type AS agent_type, count(*) FILTER (WHERE NOT is_late) AS total,
  count(*) FILTER (WHERE NOT is_late AND value < 60) AS passed, count(*) FILTER (WHERE is_late) AS late
FROM (SELECT *, coalesce(ts < mark, false) AS is_late FROM q JOIN w USING (batch)) GROUP BY 1, 2""")
def daily_of_kept(spark, d):
    """Accuracy per day behind the gate, beside the rows that came too late for it."""
    path = _dealt(spark, d, "late", _QUARTERS)
    stream = M.read_events(spark, f"{path}/events.parquet", "*.parquet", files_per_batch=1)
    gate = through_gate(stream, fresh_path(spark, "gate"), "ts")
    kept = gate.kept(stream.schema).select(
        F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("agent_type"),
        F.when(F.col("value") < 60, "PASS").otherwise("FAIL").alias("result"))
    counted = _ntz(collect_stream(M.daily_accuracy(kept), "kept", ["day", "agent_type"], "update"), "day").drop("accuracy")
    late = gate.late(stream.schema).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.col("event_type").alias("agent_type")).agg(
        F.count("*").alias("late"))
    return counted.join(late, ["day", "agent_type"], "full").na.fill(0, ["total", "passed", "late"])


@query("T5_deduplicated_stream", "SELECT event_id AS query_id, event_type AS agent_type FROM events")
def deduplicated(spark, d):
    e = _events(spark, d)
    twice = e.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")
    return collect_stream(M.deduplicate(twice), "dedup").select("query_id", "agent_type")


@query("T6_stream_with_replaced_baseline", """
WITH early AS (SELECT event_type, avg(value) AS m FROM events WHERE day(ts) <= 16 GROUP BY 1),
whole AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1)
SELECT event_id AS query_id, (CASE WHEN day(ts) <= 16 THEN 0 ELSE 1 END)::BIGINT AS baseline_version,
  round(value / CASE WHEN day(ts) <= 16 THEN early.m ELSE whole.m END, 8) AS relative
FROM events JOIN early USING (event_type) JOIN whole USING (event_type)""")
def replaced_baseline(spark, d):
    """A writer replaces the baseline between two batches; every batch is bound to one version and records it."""
    path = _dealt(spark, d, "baseline", ("day(ts) <= 16", "day(ts) > 16"))
    baselines = SnapshotTable(spark, f"{path}/baselines", "agent_type string, m double", ["agent_type"], buckets=4)

    def published(rows, version):
        baselines.replace(rows.groupBy(F.col("event_type").alias("agent_type")).agg(F.avg("value").alias("m")), version)

    events = read_table(spark, d, "events")
    published(events.filter("day(ts) <= 16"), 0)

    def write(batch, batch_id):
        version = baselines.versions()[-1]
        M.relative_to_baseline(batch, baselines.read(version), version).write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
        published(events, 1)  # the other job, after the first batch; later calls find the version there

    stream = M.read_events(spark, f"{path}/events.parquet", "*.parquet", files_per_batch=1).select(
        F.col("event_id").alias("query_id"), F.col("event_type").alias("agent_type"), F.col("value").alias("execution_time_ms"))
    run_to_end(stream, path, write=write)
    rows = spark.read.schema("query_id long, baseline_version long, relative double").parquet(f"{path}/rows/batch_id=*")
    return rows.withColumn("relative", F.round("relative", 8))


# stored when the last scan ran: no events yet, labels with another type, and a table that is gone
_LAST_SCAN = {t: {c: "text" if (t, c) == ("labels", "toxic") else k for c, k in columns.items()} for t, columns in COLUMNS.items() if t != "events"}
_LAST_SCAN["dropped"] = {"a": "integer", "b": "text"}


@query("T7_scheduled_schema_scan", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {len(columns) if t == 'events' else 0}::BIGINT AS new_columns, 0::BIGINT AS removed_columns, "
    f"{1 if t == 'labels' else 0}::BIGINT AS changed_types, count(*) AS row_count FROM {t}" for t, columns in COLUMNS.items())
    + " UNION ALL SELECT 'dropped', 0, 2, 0, NULL")
def scheduled_scan(spark, d):
    """A scan of every table of the folder against the stored catalog."""
    rows = [(1, "public", t, c, k, True) for t, columns in _LAST_SCAN.items() for c, k in columns.items()]
    stored = spark.createDataFrame(rows, "agent_id int, schema_name string, table_name string, column_name string, data_type string, is_nullable boolean")
    return C.scan_tables(read_tables(spark, d, folder_tables(spark, d)), stored, 1)


@query("T8_error_spikes", """
WITH w AS (SELECT unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts), INTERVAL 15 MINUTE)) AS window_start FROM events WHERE event_type = 'error')
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS errors FROM w GROUP BY 1 HAVING count(*) > 4""")
def spikes(spark, d):
    out = collect_stream(M.error_spikes(_events(spark, d), limit=4), "spikes", ["window_start", "window_end"], "update")
    return _ntz(out, "window_start", "window_end")


@query("T8_recent_accuracy", """
WITH w AS (SELECT unnest(generate_series(date_trunc('minute', ts) - INTERVAL 4 MINUTE, date_trunc('minute', ts), INTERVAL 1 MINUTE)) AS window_start, event_type, value FROM events)
SELECT window_start, event_type AS agent_type, count(*) AS total, count(*) FILTER (WHERE value < 60) AS passed FROM w GROUP BY 1, 2""")
def recent_accuracy(spark, d):
    e = _events(spark, d).withColumn("result", F.when(F.col("execution_time_ms") < 60, "PASS").otherwise("FAIL"))
    out = collect_stream(M.recent_accuracy(e), "recent", ["window_start", "agent_type"], "update")
    return _ntz(out, "window_start").drop("accuracy")


@query("S18_telemetry_ingest", with_tables("SELECT query_id, agent_type, agent_id FROM queries JOIN (SELECT agent_id, agent_name FROM agents) ON agent_type = agent_name WHERE agent_type <> 'view'", "queries", "agents"))
def ingest(spark, d):
    agents = T.agents(spark, d).filter(F.col("agent_name") != "view").select("agent_id", "agent_name")
    stream = _events(spark, d).withColumn("agent_type", F.upper("agent_type"))
    return collect_stream(M.ingest(stream, agents).select("query_id", "agent_type", "agent_id"), "ingest")
