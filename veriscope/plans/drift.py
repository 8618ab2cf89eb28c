"""Question drift, result drift and ground-truth matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriscope import constants as K
from veriscope.functions import vectors as V
from veriscope.operators import drift as D
from veriscope.operators import matching as M
from veriscope.operators import result_drift as P
from veriscope.operators.ordering import exact_percentiles, first_per_key
from veriscope.plans.registry import query
from veriscope.sources.files import read_table, spread

_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")

_LONG_SQL = """long AS (
  SELECT l_suppkey AS query_id, year(l_shipdate) AS ship_year, column_name, value
  FROM (UNPIVOT (SELECT l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
        ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME column_name VALUE value))"""

_BASE_SQL = _LONG_SQL + """,
edges AS (
  SELECT column_name, count(*) AS sample_count,
         list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e
  FROM long GROUP BY column_name HAVING count(*) >= 20),
slots AS (SELECT column_name, sample_count, e, len(e) - 1 AS n, unnest(range(len(e) - 1)) AS bucket FROM edges),
placed AS (
  SELECT query_id, ship_year, column_name, value,
         CASE WHEN value < e[1] OR value > e[len(e)] THEN -1
              ELSE least(len(list_filter(e, lambda x: x <= value)) - 1, len(e) - 2) END AS bucket
  FROM long JOIN edges USING (column_name)),
base AS (
  SELECT s.column_name, s.bucket, s.n, s.sample_count, s.e[s.bucket + 1] AS low, s.e[s.bucket + 2] AS high,
         count(p.bucket)::DOUBLE / max(t.total) AS expected
  FROM slots s LEFT JOIN placed p ON p.column_name = s.column_name AND p.bucket = s.bucket
  JOIN (SELECT column_name, count(*) AS total FROM placed WHERE bucket >= 0 GROUP BY column_name) t
    ON t.column_name = s.column_name
  GROUP BY s.column_name, s.bucket, s.n, s.sample_count, low, high)"""


def _column_psi_sql(key: str) -> str:
    return f"""counted AS (SELECT {key} AS k, column_name, bucket, count(*) AS c FROM placed WHERE bucket >= 0 GROUP BY ALL),
totals AS (SELECT k, column_name, sum(c) AS total FROM counted GROUP BY ALL),
column_psi AS (
  SELECT t.k, b.column_name, round(sum((a - e) * ln(a / e)), 4) AS psi FROM (
    SELECT t.k, b.column_name, greatest(b.expected, 0.0001::DOUBLE) AS e,
           greatest(coalesce(c.c, 0)::DOUBLE / t.total, 0.0001::DOUBLE) AS a
    FROM totals t JOIN base b USING (column_name)
    LEFT JOIN counted c ON c.k = t.k AND c.column_name = b.column_name AND c.bucket = b.bucket) x
  JOIN totals t USING (k, column_name) JOIN (SELECT DISTINCT column_name FROM base) b USING (column_name)
  GROUP BY t.k, b.column_name)"""


_CLASS_SQL = "CASE WHEN {p} < 0.1 THEN 'normal' WHEN {p} < 0.2 THEN 'medium' ELSE 'high' END"


def lineitem_baseline(spark, d):
    table = spread(read_table(spark, d, "lineitem"))
    return P.psi_baseline(P.pooled_values([table], "lineitem", exclude=_KEYS))


def supplier_values(spark, d):
    table = spread(read_table(spark, d, "lineitem")).select(
        F.col("l_suppkey").alias("query_id"), F.lit("lineitem").alias("agent_type"), *_METRICS
    )
    return P.to_long(table, ["query_id", "agent_type"], _METRICS)


def supplier_psi(spark, d):
    """PSI of the metric columns of every supplier's line items."""
    rows = spread(read_table(spark, d, "lineitem")).select(F.col("l_suppkey").alias("query_id"), F.lit("lineitem").alias("agent_type"), *_METRICS)
    return P.column_psi_of_rows(rows, _METRICS, lineitem_baseline(spark, d))


@query("P4_result_drift_by_supplier", f"""
WITH {_BASE_SQL}, {_column_psi_sql('query_id')}
SELECT k AS query_id, max(psi) AS overall_psi, count(*)::INTEGER AS columns_analyzed,
       {_CLASS_SQL.format(p='max(psi)')} AS drift_classification, max(psi) >= 0.2 AS is_anomaly
FROM column_psi GROUP BY k""")
def result_drift_by_supplier(spark, d):
    scored = P.overall_psi(supplier_psi(spark, d))
    return scored.select(
        "query_id", "overall_psi", "columns_analyzed", "drift_classification", "is_anomaly"
    )


@query("P3_column_psi_by_ship_year", f"""
WITH {_BASE_SQL}, {_column_psi_sql('ship_year')}
SELECT k AS query_id, column_name, psi FROM column_psi""")
def column_psi_by_year(spark, d):
    table = spread(read_table(spark, d, "lineitem")).select(
        F.year("l_shipdate").cast("long").alias("query_id"), F.lit("lineitem").alias("agent_type"), *_METRICS
    )
    return P.column_psi_of_rows(table, _METRICS, lineitem_baseline(spark, d)).select("query_id", "column_name", "psi")


@query("P1_result_baseline_buckets", f"""
WITH {_BASE_SQL}
SELECT column_name, bucket::INTEGER AS bucket, low, high, expected, sample_count FROM base""")
def baseline_buckets(spark, d):
    b = lineitem_baseline(spark, d)
    rows = b.select("column_name", "sample_count", "bucket_edges", F.posexplode("expected_pct").alias("bucket", "expected"))
    return rows.select(
        "column_name", "bucket", F.element_at("bucket_edges", F.col("bucket") + 1).alias("low"),
        F.element_at("bucket_edges", F.col("bucket") + 2).alias("high"), "expected", "sample_count",
    )


@query("P2_bucket_counts_out_of_range", f"""
WITH {_BASE_SQL}
SELECT column_name, bucket::INTEGER AS bucket, count(*) AS n
FROM (SELECT b.column_name,
        CASE WHEN v < e[1] OR v > e[len(e)] THEN -1 ELSE least(len(list_filter(e, lambda x: x <= v)) - 1, len(e) - 2) END AS bucket
      FROM (SELECT column_name, value * 1.5::DOUBLE AS v FROM long) b JOIN edges USING (column_name))
GROUP BY ALL""")
def bucket_counts(spark, d):
    from veriscope.functions.psi import bucket_of
    from veriscope.operators.lookup import lookup_join

    values = supplier_values(spark, d).withColumn("value", F.col("value") * 1.5)
    placed = lookup_join(values, lineitem_baseline(spark, d), ["agent_type", "column_name"], "inner")
    return placed.groupBy(
        "column_name", bucket_of(F.col("value"), F.col("bucket_edges")).alias("bucket")
    ).agg(F.count("*").alias("n"))


@query("P5_result_drift_classes", f"""
WITH {_BASE_SQL}, {_column_psi_sql('query_id')},
overall AS (SELECT k, max(psi) AS psi FROM column_psi GROUP BY k)
SELECT {_CLASS_SQL.format(p='psi')} AS drift_classification, count(*) AS n, round(avg(psi), 8) AS avg_psi,
       count(*) FILTER (WHERE psi >= 0.2) AS anomalies
FROM overall GROUP BY 1""")
def result_drift_classes(spark, d):
    scored = P.overall_psi(supplier_psi(spark, d))
    return scored.groupBy("drift_classification").agg(
        F.count("*").alias("n"), F.round(F.avg("overall_psi"), 8).alias("avg_psi"),
        F.count_if("is_anomaly").alias("anomalies"),
    )


@query("P6_result_drift_skip_states", f"""
WITH {_BASE_SQL}, {_column_psi_sql('query_id')},
asked AS (SELECT s_suppkey AS query_id,
            CASE WHEN s_acctbal < 0 THEN 'unknown' ELSE 'lineitem' END AS agent_type,
            s_nationkey < 3 AS is_aggregate,
            CASE WHEN s_nationkey > 22 THEN 0 ELSE (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) END AS row_count
          FROM supplier),
overall AS (SELECT k, max(psi) AS psi FROM column_psi GROUP BY k),
state AS (SELECT a.*, o.psi, CASE WHEN is_aggregate THEN 'aggregate_query' WHEN row_count = 0 THEN 'empty_result'
            WHEN agent_type = 'unknown' THEN 'no_baseline' WHEN o.psi IS NULL THEN 'no_numeric_data' END AS skip
          FROM asked a LEFT JOIN overall o ON o.k = a.query_id AND a.agent_type = 'lineitem')
SELECT query_id, coalesce(skip, {_CLASS_SQL.format(p='psi')}) AS drift_classification,
       CASE WHEN skip IS NULL THEN psi ELSE 0 END::DOUBLE AS overall_psi, skip IS NULL AS stored,
       skip IS NULL AND psi >= 0.2 AS is_anomaly
FROM state""")
def result_drift_skips(spark, d):
    suppliers = read_table(spark, d, "supplier")
    counts = read_table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    asked = suppliers.join(counts, ["s_suppkey"], "left").select(
        F.col("s_suppkey").alias("query_id"),
        F.when(F.col("s_acctbal") < 0, "unknown").otherwise("lineitem").alias("agent_type"),
        (F.col("s_nationkey") < 3).alias("is_aggregate"),
        F.when(F.col("s_nationkey") > 22, 0).otherwise(F.coalesce("n", F.lit(0))).alias("row_count"),
    )
    scored = P.score_result_drift(asked, None, lineitem_baseline(spark, d), supplier_psi(spark, d))
    return scored.select("query_id", "drift_classification", "overall_psi", "stored", "is_anomaly")


@query("P7_pooled_table_baseline", """
WITH v AS (SELECT 'o_totalprice' AS column_name, o_totalprice AS value FROM orders
           UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
           UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem
           UNION ALL SELECT 'l_discount', l_discount FROM lineitem
           UNION ALL SELECT 'l_tax', l_tax FROM lineitem),
e AS (SELECT column_name, count(*) AS sample_count,
        list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e
      FROM v GROUP BY column_name HAVING count(*) >= 20)
SELECT column_name, sample_count, (len(e) - 1)::INTEGER AS buckets, e[1] AS low, e[len(e)] AS high FROM e WHERE len(e) >= 2""")
def pooled_baseline(spark, d):
    tables = [read_table(spark, d, "orders"), read_table(spark, d, "lineitem")]
    values = P.pooled_values(tables, "shop", exclude=(*_KEYS, "o_orderkey", "o_custkey"))
    return P.psi_baseline(values).select(
        "column_name", "sample_count", F.size("expected_pct").alias("buckets"),
        F.element_at("bucket_edges", 1).alias("low"), F.element_at("bucket_edges", -1).alias("high"),
    )


@query("P8_baseline_fallback", """
WITH v AS (SELECT n_name AS agent_type, s_acctbal AS value, 1 AS priority FROM supplier JOIN nation ON s_nationkey = n_nationkey
           UNION ALL SELECT n_name, c_acctbal, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey),
b AS (SELECT agent_type, priority, count(*) AS sample_count FROM v GROUP BY ALL HAVING count(*) >= 20),
best AS (SELECT agent_type, min(priority) AS priority FROM b GROUP BY 1)
SELECT agent_type, sample_count FROM b JOIN best USING (agent_type, priority)""")
def baseline_fallback(spark, d):
    nation = read_table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("agent_type"))

    def source(table, key, value):
        rows = read_table(spark, d, table).join(F.broadcast(nation), F.col(key) == F.col("n_nationkey"))
        return P.psi_baseline(rows.select("agent_type", F.lit("acctbal").alias("column_name"), F.col(value).alias("value")))

    chosen = P.preferred_baseline(
        [source("supplier", "s_nationkey", "s_acctbal"), source("customer", "c_nationkey", "c_acctbal")]
    )
    return chosen.select("agent_type", "sample_count")


@query("A21_exact_deciles", """
SELECT l_returnflag, count(*) AS sample_count, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) AS decile,
       unnest(quantile_cont(l_extendedprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS value
FROM lineitem GROUP BY l_returnflag""")
def exact_deciles(spark, d):
    rows = exact_percentiles(
        read_table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [i / 10 for i in range(11)]
    )
    return rows.select("l_returnflag", "sample_count", F.posexplode("percentiles").alias("decile", "value"))


_CENTROID_SQL = """cells AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
lengths AS (SELECT vec_id, sqrt(sum(x * x)) AS size FROM cells GROUP BY vec_id),
means AS (SELECT label, pos, avg(x) AS m FROM cells JOIN lengths USING (vec_id) WHERE size > 0.01 GROUP BY ALL),
centroids AS (SELECT label, list(m ORDER BY pos) AS c FROM means GROUP BY label)"""


def embedding_baselines(spark, d):
    e = read_table(spark, d, "embeddings").select(F.col("label").cast("string").alias("agent_type"), "embedding")
    return D.centroids(e)


@query("A20_centroid_components", f"""
WITH {_CENTROID_SQL}
SELECT label::VARCHAR AS agent_type, (pos - 1)::INTEGER AS component, round(m, 9) AS mean,
       (SELECT count(*) FROM embeddings e WHERE e.label = means.label) AS num_queries
FROM means""")
def centroid_components(spark, d):
    b = embedding_baselines(spark, d)
    return b.select(
        "agent_type", "num_queries", F.posexplode("centroid").alias("component", "mean")
    ).withColumn("mean", F.round("mean", 9))


@query("V1_centroid_baseline", f"""
WITH {_CENTROID_SQL}
SELECT label::VARCHAR AS agent_type, len(c)::INTEGER AS dimension, count(*) AS num_queries, 1 AS version,
       round(sqrt(list_sum(list_transform(c, lambda v: v * v))), 8) AS length
FROM centroids JOIN embeddings USING (label) GROUP BY label, c""")
def centroid_baseline(spark, d):
    return embedding_baselines(spark, d).select(
        "agent_type", F.size("centroid").alias("dimension"), "num_queries", "version",
        F.round(V.norm("centroid"), 8).alias("length"),
    )


_DRIFT_VEC_SQL = f"""{_CENTROID_SQL},
sims AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], c) AS s FROM embeddings JOIN centroids USING (label))"""


def _scored_embeddings(spark, d):
    e = read_table(spark, d, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("agent_type"), "embedding"
    )
    return D.score_drift(e, embedding_baselines(spark, d))


@query("V2_cosine_drift", f"""
WITH {_DRIFT_VEC_SQL}
SELECT vec_id AS query_id, label::VARCHAR AS agent_type, round(s, 8) AS similarity_to_baseline,
       round(1.0::DOUBLE - s, 8) AS drift_score,
       CASE WHEN s >= 0.7 THEN 'normal' WHEN s >= 0.5 THEN 'medium' ELSE 'high' END AS drift_classification,
       s < 0.5 AS is_anomaly
FROM sims""")
def cosine_drift(spark, d):
    return _scored_embeddings(spark, d).select(
        "query_id", "agent_type", F.round("similarity_to_baseline", 8).alias("similarity_to_baseline"),
        F.round("drift_score", 8).alias("drift_score"), "drift_classification", "is_anomaly",
    )


@query("V3_drift_skip_states", f"""
WITH {_DRIFT_VEC_SQL},
state AS (SELECT vec_id, s, label,
    CASE WHEN embedding[1] > 0.2 THEN 'embedding_failed' WHEN label >= 8 THEN 'no_baseline'
         WHEN embedding[2] > 0.2 THEN 'dimension_mismatch' END AS skip
  FROM sims JOIN embeddings USING (vec_id, label))
SELECT coalesce(skip, CASE WHEN s >= 0.7 THEN 'normal' WHEN s >= 0.5 THEN 'medium' ELSE 'high' END) AS drift_classification,
       skip IS NULL AS stored, count(*) AS n, round(sum(CASE WHEN skip IS NULL THEN 1.0::DOUBLE - s ELSE 0.0::DOUBLE END), 6) AS drift
FROM state GROUP BY ALL""")
def drift_skips(spark, d):
    e = read_table(spark, d, "embeddings")
    v = F.col("embedding")
    damaged = (
        F.when(v[0] > 0.2, F.transform(v, lambda x: F.lit(0.0).cast("float")))
        .when(v[1] > 0.2, F.slice(v, 1, 10)).otherwise(v)
    )
    known = embedding_baselines(spark, d).filter(F.col("agent_type").cast("int") < 8)
    scored = D.score_drift(
        e.select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("agent_type"), damaged.alias("embedding")),
        known,
    )
    return scored.groupBy("drift_classification", "stored").agg(
        F.count("*").alias("n"), F.round(F.sum("drift_score"), 6).alias("drift")
    )


@query("V4_agents_needing_baseline", """
SELECT DISTINCT source AS agent_type FROM documents
WHERE source NOT IN (SELECT 'src' || label FROM embeddings)""")
def agents_needing_baseline(spark, d):
    agents = read_table(spark, d, "documents").select(F.col("source").alias("agent_type")).distinct()
    baselines = embedding_baselines(spark, d).withColumn(
        "agent_type", F.concat(F.lit("src"), "agent_type")
    )
    return D.agents_without_baseline(agents, baselines)


@query("V5_drift_quality", f"""
WITH {_DRIFT_VEC_SQL}
SELECT doc_id AS query_id, CASE WHEN s IS NULL THEN 0.5 ELSE round(greatest(0, 1.0::DOUBLE - (1.0::DOUBLE - s)), 8) END::DOUBLE AS drift_quality
FROM documents LEFT JOIN sims ON doc_id = vec_id""")
def drift_quality(spark, d):
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("query_id"))
    joined = docs.join(_scored_embeddings(spark, d).select("query_id", "drift_score"), ["query_id"], "left")
    return joined.select("query_id", F.round(D.drift_quality(F.col("drift_score")), 8).alias("drift_quality"))


@query("V6_backfill_unscored", f"""
WITH {_CENTROID_SQL},
done AS (SELECT DISTINCT event_id FROM events WHERE value > 40),
todo AS (SELECT * FROM embeddings JOIN events ON vec_id = event_id
         WHERE event_type <> 'error' AND vec_id NOT IN (SELECT event_id FROM done))
SELECT vec_id AS query_id, round(1.0::DOUBLE - list_cosine_similarity(embedding::DOUBLE[], c), 8) AS drift_score
FROM todo JOIN centroids USING (label)""")
def backfill(spark, d):
    e, ev = read_table(spark, d, "embeddings"), read_table(spark, d, "events")
    queries = e.join(ev, e["vec_id"] == ev["event_id"]).select(
        F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("agent_type"), "embedding",
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
    )
    done = ev.filter(F.col("value") > 40).select(F.col("event_id").alias("query_id"))
    todo = D.unscored(queries, done)
    return D.score_drift(todo, embedding_baselines(spark, d)).select(
        "query_id", F.round("drift_score", 8).alias("drift_score")
    )


@query("W1_baseline_in_force", """
SELECT * FROM (SELECT l_returnflag AS agent_type, year(l_shipdate) AS version, count(*) AS num_queries FROM lineitem GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY agent_type ORDER BY version DESC) = 1""")
def in_force(spark, d):
    versions = read_table(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("agent_type"), F.year("l_shipdate").cast("long").alias("version")
    ).agg(F.count("*").alias("num_queries"))
    return D.baseline_in_force(versions)


_GT_SQL = """gt AS (
  SELECT label AS position, arg_min(embedding, vec_id)::DOUBLE[] AS g, arg_min(text, vec_id) AS gt_text
  FROM embeddings LEFT JOIN documents ON doc_id = vec_id GROUP BY label),
pairs AS (
  SELECT vec_id, position, gt_text, list_cosine_similarity(embedding::DOUBLE[], g) AS s FROM embeddings, gt),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, position) = 1)"""


def _like_any(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{p}')" for p in phrases) + ")"


_CONFLICT_SQL = (
    f"({_like_any('d.text', K.LESS_PHRASES)} AND {_like_any('gt_text', K.MORE_PHRASES)}) OR "
    f"({_like_any('d.text', K.MORE_PHRASES)} AND {_like_any('gt_text', K.LESS_PHRASES)})"
)


def _questions_and_entries(spark, d):
    e = read_table(spark, d, "embeddings")
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("query_text"))
    joined = e.join(docs, ["vec_id"], "left")
    entries = first_per_key(joined, ["label"], ["vec_id"]).select(
        F.col("label").cast("long").alias("position"), F.col("query_text").alias("gt_text"),
        F.col("embedding").alias("gt_embedding"),
    )
    return joined.select(F.col("vec_id").alias("query_id"), "query_text", "embedding"), entries


@query("J11_nearest_ground_truth", f"""
WITH {_GT_SQL}
SELECT vec_id AS query_id, position::BIGINT AS position, round(s, 8) AS match_score FROM best""")
def nearest_entries(spark, d):
    questions, entries = _questions_and_entries(spark, d)
    return M.best_entries(questions, entries).withColumn("match_score", F.round("match_score", 8))


@query("G1_ground_truth_match", f"""
WITH {_GT_SQL}
SELECT b.vec_id AS query_id, position::BIGINT AS position, round(s, 8) AS match_score,
       s >= 0.7 AND NOT coalesce({_CONFLICT_SQL}, false) AS is_match,
       s >= 0.8 AND NOT coalesce({_CONFLICT_SQL}, false) AS trusted
FROM best b LEFT JOIN documents d ON d.doc_id = b.vec_id""")
def ground_truth_match(spark, d):
    questions, entries = _questions_and_entries(spark, d)
    return M.match_ground_truth(questions, entries).select(
        "query_id", "position", F.round("match_score", 8).alias("match_score"), "is_match", "trusted"
    )


@query("F10_zero_vectors", """
SELECT label, count(*) AS n, count(*) FILTER (WHERE sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) > 0.01) AS usable
FROM embeddings GROUP BY label""")
def zero_vectors(spark, d):
    e = read_table(spark, d, "embeddings").withColumn("size", V.norm("embedding"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("size") > K.ZERO_NORM).alias("usable"))
