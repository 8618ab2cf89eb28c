"""Result-set comparison queries: line items per supplier against altered copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriscope.functions import text as X
from veriscope.functions import values as V
from veriscope.operators import compare as C
from veriscope.plans import standin as T
from veriscope.plans.registry import query
from veriscope.plans.standin import with_tables
from veriscope.sources.files import read_table

_COLUMNS = ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"]


def _actual(spark, d):
    return read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), *_COLUMNS)


def _expected(spark, d):
    """Copies with noise: tiny and large numeric changes, padded texts, fewer rows for some suppliers."""
    li = read_table(spark, d, "lineitem")
    kept = ~((F.col("l_suppkey") < 10) & (F.col("l_quantity") > 49))
    return li.filter(kept).select(
        F.col("l_suppkey").alias("query_id"), "l_orderkey", "l_partkey",
        (F.col("l_quantity") + F.when((F.col("l_suppkey") >= 50) & (F.col("l_quantity") > 40), 1.0).otherwise(0.00001)).alias("l_quantity"),
        F.concat(F.col("l_returnflag"), F.lit("  ")).alias("l_returnflag"), "l_shipdate",
    )


_PAIR_SQL = """actual AS (SELECT l_suppkey AS query_id, l_orderkey, l_partkey, l_quantity, l_returnflag, l_shipdate FROM lineitem),
expected AS (SELECT l_suppkey AS query_id, l_orderkey, l_partkey,
    l_quantity + CASE WHEN l_suppkey >= 50 AND l_quantity > 40 THEN 1.0 ELSE 0.00001 END::DOUBLE AS l_quantity,
    l_returnflag || '  ' AS l_returnflag, l_shipdate FROM lineitem WHERE NOT (l_suppkey < 10 AND l_quantity > 49)),
ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY l_orderkey, l_partkey, l_quantity, l_returnflag, l_shipdate) AS p FROM actual),
re AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY l_orderkey, l_partkey, l_quantity, l_returnflag, l_shipdate) AS p FROM expected),
hit AS (SELECT query_id, count(*) AS m FROM ra JOIN re e USING (query_id, p) WHERE ra.l_orderkey = e.l_orderkey AND ra.l_partkey = e.l_partkey
   AND abs(ra.l_quantity - e.l_quantity) < 0.0001 AND trim(ra.l_returnflag) = trim(e.l_returnflag) AND ra.l_shipdate = e.l_shipdate GROUP BY 1),
sizes AS (SELECT query_id, a.n AS rows_actual, e.n AS rows_expected FROM (SELECT query_id, count(*) AS n FROM actual GROUP BY 1) a
   FULL JOIN (SELECT query_id, count(*) AS n FROM expected GROUP BY 1) e USING (query_id)),
rates AS (SELECT query_id, rows_actual, rows_expected, CASE WHEN rows_actual <> rows_expected THEN 0.0 ELSE coalesce(m, 0)::DOUBLE / rows_actual END::DOUBLE AS rate
   FROM sizes LEFT JOIN hit USING (query_id))"""


@query("C5_unordered_comparison", f"""WITH {_PAIR_SQL}
SELECT query_id, true AS schema_match, rows_actual = rows_expected AS row_count_match, round(rate, 8) AS content_match_rate,
  round(CASE WHEN rows_actual <> rows_expected THEN 0.3 WHEN rate >= 0.99 THEN 1.0 WHEN rate >= 0.95 THEN 0.95 WHEN rate >= 0.8 THEN 0.8 ELSE rate END, 8)::DOUBLE AS score,
  rows_actual = rows_expected AND rate >= 0.95 AS is_match FROM rates""")
def unordered(spark, d):
    out = C.compare_results(_actual(spark, d), _expected(spark, d), ["query_id"])
    return out.withColumns({c: F.round(c, 8) for c in ("content_match_rate", "score")})


@query("C2_row_counts", f"WITH {_PAIR_SQL} SELECT query_id, rows_actual, rows_expected, rows_actual = rows_expected AS row_count_match FROM sizes")
def row_counts(spark, d):
    a = _actual(spark, d).groupBy("query_id").agg(F.count("*").alias("rows_actual"))
    e = _expected(spark, d).groupBy("query_id").agg(F.count("*").alias("rows_expected"))
    return a.join(e, ["query_id"], "full").withColumn("row_count_match", F.col("rows_actual") == F.col("rows_expected"))


@query("C9_score_ladder", f"""WITH {_PAIR_SQL}
SELECT CASE WHEN rate >= 0.99 THEN 1.0 WHEN rate >= 0.95 THEN 0.95 WHEN rate >= 0.8 THEN 0.8 ELSE round(rate, 2) END::DOUBLE AS score, count(*) AS n FROM rates GROUP BY 1""")
def ladder(spark, d):
    rates = C.match_rate(_actual(spark, d), _expected(spark, d), ["query_id"])
    step = C.ladder(F.col("content_match_rate"))
    return rates.groupBy(F.when(step < 0.8, F.round(step, 2)).otherwise(step).alias("score")).agg(F.count("*").alias("n"))


@query("C4_ordered_comparison", """
WITH e AS (SELECT user_id AS query_id, event_id AS position, value, event_type FROM events),
x AS (SELECT query_id, position, CASE WHEN value > 100 THEN value + 1 ELSE value END AS value, event_type || CASE WHEN value > 150 THEN '!' ELSE ' ' END AS event_type FROM e)
SELECT query_id, count(*) AS rows_actual, count(*) FILTER (WHERE abs(e.value - x.value) < 0.0001 AND trim(e.event_type) = trim(x.event_type)) AS matched,
  round(count(*) FILTER (WHERE abs(e.value - x.value) < 0.0001 AND trim(e.event_type) = trim(x.event_type))::DOUBLE / count(*), 8) AS content_match_rate
FROM e JOIN x USING (query_id, position) GROUP BY 1""")
def ordered(spark, d):
    e = read_table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("position"), "value", "event_type")
    x = e.withColumns(
        {"event_type": F.concat("event_type", F.when(F.col("value") > 150, "!").otherwise(" ")),
         "value": F.when(F.col("value") > 100, F.col("value") + 1).otherwise(F.col("value"))})
    out = C.match_rate(e, x, ["query_id"], "position")
    return out.select("query_id", "rows_actual", "matched", F.round("content_match_rate", 8).alias("content_match_rate"))


@query("C8_partial_schema_comparison", """
WITH a AS (SELECT l_suppkey AS query_id, l_orderkey, l_quantity FROM lineitem),
e AS (SELECT query_id, l_orderkey, CASE WHEN l_quantity = 50 THEN 51 ELSE l_quantity END AS l_quantity FROM a),
ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY l_orderkey, l_quantity) AS p FROM a),
re AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY l_orderkey, l_quantity) AS p FROM e),
r AS (SELECT query_id, count(*) FILTER (WHERE ra.l_orderkey = re.l_orderkey AND abs(ra.l_quantity - re.l_quantity) < 0.0001)::DOUBLE / count(*) AS rate FROM ra JOIN re USING (query_id, p) GROUP BY 1)
SELECT query_id, false AS schema_match, true AS row_count_match, round(rate, 8) AS content_match_rate,
  round(greatest(0.1, 2.0::DOUBLE / 3 * rate), 8)::DOUBLE AS score, false AS is_match FROM r""")
def partial(spark, d):
    li = read_table(spark, d, "lineitem").withColumn("query_id", F.col("l_suppkey"))
    a = li.select("query_id", "l_orderkey", "l_quantity", "l_tax")
    e = li.select("query_id", F.col("l_orderkey").alias("L_ORDERKEY"),
                  F.when(F.col("l_quantity") == 50, 51.0).otherwise(F.col("l_quantity")).alias("l_quantity"), "l_discount")
    out = C.compare_results(a, e, ["query_id"])
    return out.withColumns({c: F.round(c, 8) for c in ("content_match_rate", "score")})


@query("C1_schema_matches", """
SELECT doc_id, lang = 'en' OR n_chars < 1000 OR source IN ('src1', 'src2') AS schema_match FROM documents""")
def schema_matches(spark, d):
    docs = read_table(spark, d, "documents")
    left = F.array(F.lit("id"), F.lit(" Name "))
    right = (
        F.when(F.col("lang") == "en", F.array(F.lit("NAME"), F.lit("id")))
        .when(F.col("n_chars") < 1000, F.array(F.lit("id")))
        .when(F.col("source").isin("src1", "src2"), F.array(F.lit("name"), F.lit("id"), F.lit("city")))
        .otherwise(F.array(F.lit("id"), F.lit("city")))
    )
    return docs.select("doc_id", C.schemas_match_column(left, right).alias("schema_match"))


@query("C3_ordering_matters", with_tables("""
SELECT query_id, coalesce(contains(CASE WHEN contains(generated_sql, ')') THEN regexp_extract(upper(generated_sql), '\\)([^)]*)$', 1) ELSE upper(generated_sql) END, 'ORDER BY'), false) AS ordered FROM queries""".replace("\\\\", "\\"), "queries"))
def ordering_matters(spark, d):
    return T.queries(spark, d).select("query_id", X.orders_rows(F.col("generated_sql")).alias("ordered"))


@query("C6_value_equality", """
SELECT event_id, coalesce(abs(value - (value + CASE WHEN value > 50 THEN 0.00005 ELSE 0.0002 END)) < 0.0001, false) AS numbers,
  event_type = trim(event_type || '  ') AS texts, true AS nulls, ts = ts AS times, value > 30 AS iso
FROM events""")
def value_equality(spark, d):
    e = read_table(spark, d, "events")
    t = {f.name: f.dataType for f in e.schema.fields}
    moved = F.col("value") + F.when(F.col("value") > 50, 0.00005).otherwise(0.0002)
    iso = F.when(F.col("value") > 30, F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))).otherwise("2024")
    null = F.lit(None).cast("double")
    return e.select(
        "event_id",
        V.same_value(F.col("value"), t["value"], moved, t["value"]).alias("numbers"),
        V.same_value(F.col("event_type"), t["event_type"], F.concat("event_type", F.lit("  ")), t["event_type"]).alias("texts"),
        V.same_value(null, t["value"], null, t["value"]).alias("nulls"),
        V.same_value(F.col("ts"), t["ts"], F.col("ts"), t["ts"]).alias("times"),
        V.same_value(F.col("ts"), t["ts"], iso, t["event_type"]).alias("iso"),
    )


@query("C7_normalised_rows", """
SELECT round(l_quantity, 6) AS quantity, trim(l_returnflag) AS flag, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS shipped, count(*) AS n FROM lineitem GROUP BY ALL""")
def normalised_rows(spark, d):
    li = read_table(spark, d, "lineitem")
    t = {f.name: f.dataType for f in li.schema.fields}
    return li.groupBy(
        V.normal_text(F.col("l_quantity"), t["l_quantity"]).cast("double").alias("quantity"),
        V.normal_text(F.concat(F.lit(" "), "l_returnflag"), t["l_returnflag"]).alias("flag"),
        V.normal_text(F.col("l_shipdate"), t["l_shipdate"]).alias("shipped"),
    ).agg(F.count("*").alias("n"))


_SET_SQL = """a AS (SELECT DISTINCT l_suppkey AS query_id, l_quantity, l_returnflag FROM lineitem WHERE l_quantity < 40),
e AS (SELECT DISTINCT l_suppkey AS query_id, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 10 AND l_tax > 0.02)"""


@query("U2_set_similarity", f"""WITH {_SET_SQL}, u AS (SELECT * FROM a UNION SELECT * FROM e), i AS (SELECT * FROM a INTERSECT SELECT * FROM e)
SELECT query_id, round(coalesce(x.n, 0)::DOUBLE / y.n, 8) AS set_similarity FROM (SELECT query_id, count(*) AS n FROM u GROUP BY 1) y
LEFT JOIN (SELECT query_id, count(*) AS n FROM i GROUP BY 1) x USING (query_id)""")
def set_similarity(spark, d):
    li = read_table(spark, d, "lineitem")
    rows = [F.col("l_suppkey").alias("query_id"), F.col("l_quantity"), F.col("l_returnflag")]
    a = li.filter(F.col("l_quantity") < 40).select(*rows)
    e = li.filter((F.col("l_quantity") > 10) & (F.col("l_tax") > 0.02)).select(*rows)
    return C.set_similarity(a, e, ["query_id"]).withColumn("set_similarity", F.round("set_similarity", 8))


_MEMBER_SQL = """a AS (SELECT DISTINCT l_suppkey AS query_id, l_quantity, l_returnflag FROM lineitem WHERE l_quantity < 40 AND l_suppkey < 90),
e AS (SELECT l_suppkey AS query_id, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 10 AND l_tax > 0.02),
m AS (SELECT e.query_id AS query_id, avg(CASE WHEN a.query_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n FROM e LEFT JOIN a USING (query_id, l_quantity, l_returnflag) GROUP BY 1)"""


def _membership(spark, d):
    li = read_table(spark, d, "lineitem")
    rows = [F.col("l_suppkey").alias("query_id"), F.col("l_quantity"), F.col("l_returnflag")]
    a = li.filter((F.col("l_quantity") < 40) & (F.col("l_suppkey") < 90)).select(*rows)
    e = li.filter((F.col("l_quantity") > 10) & (F.col("l_tax") > 0.02)).select(*rows)
    return C.membership_rate(a, e, ["query_id"])


@query("U3_membership_rate", f"WITH {_MEMBER_SQL} SELECT query_id, round(rate, 8) AS content_match_rate FROM m")
def membership(spark, d):
    return _membership(spark, d).withColumn("content_match_rate", F.round("content_match_rate", 8))


@query("C10_expected_output_scores", f"""WITH {_MEMBER_SQL},
s AS (SELECT query_id, 0.2 * CASE WHEN query_id >= 20 THEN 1.0 ELSE 0.0 END + 0.2 * CASE WHEN query_id < 60 THEN 1.0 ELSE 0.5 END + 0.6 * rate AS score FROM m)
SELECT query_id, round(score, 6)::DOUBLE AS score, CASE WHEN score >= 0.95 THEN 'HIGH' WHEN score >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s""")
def expected_scores(spark, d):
    score = C.expected_output_score(F.col("query_id") >= 20, F.col("query_id") < 60, F.col("content_match_rate"))
    return _membership(spark, d).withColumn("score", score).select(
        "query_id", F.round("score", 6).alias("score"), C.expected_output_confidence(F.col("score")).alias("confidence"))


@query("C11_confidence_weights", with_tables("""
SELECT query_id, round(result_score * CASE WHEN semantic_score >= 0.9 THEN 1.0 WHEN semantic_score >= 0.75 THEN 0.8 ELSE 0.5 END, 6)::DOUBLE AS weighed FROM evaluations""", "evaluations"))
def weights(spark, d):
    return T.evaluations(spark, d).select(
        "query_id", F.round(C.weigh(F.col("result_score"), C.match_confidence(F.col("semantic_score"))), 6).alias("weighed"))


@query("C12_latency_comparison", """
WITH t AS (SELECT event_id AS query_id, value AS g, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN 0.0 ELSE 40.0 END::DOUBLE AS r FROM events),
s AS (SELECT query_id, CASE WHEN r IS NULL THEN NULL WHEN g > 0 THEN r / g ELSE 0 END AS speedup, CASE WHEN r IS NULL THEN NULL WHEN r > 0 THEN g / r ELSE 0 END AS slowdown FROM t)
SELECT query_id, round(speedup, 8) AS speedup, round(slowdown, 8) AS slowdown,
  CASE WHEN speedup IS NULL THEN 'unavailable' WHEN speedup > 1.2 THEN 'faster' WHEN slowdown > 1.2 THEN 'slower' ELSE 'similar' END AS performance FROM s""")
def latency(spark, d):
    e = read_table(spark, d, "events")
    reference = F.when(F.col("event_type") == "click", 0.0).when(F.col("event_type") != "view", 40.0)
    out = e.select(F.col("event_id").alias("query_id"), C.compare_latency(F.col("value"), reference).alias("c"))
    return out.select("query_id", F.round("c.speedup", 8).alias("speedup"), F.round("c.slowdown", 8).alias("slowdown"), "c.performance")


@query("C13_output_samples", """
SELECT l_suppkey AS query_id, l_orderkey, l_linenumber, l_partkey,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity)::INTEGER AS sample_position FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) <= 10""")
def samples(spark, d):
    li = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")]
    return C.output_sample(li, ["query_id"], order).drop("l_quantity")


@query("C14_execution_scores", """
WITH t AS (SELECT event_id AS query_id, event_type <> 'error' AS ok, value / 100.0::DOUBLE AS c, CASE WHEN event_type <> 'view' THEN 0.5::DOUBLE END AS m, 0.25::DOUBLE AS q FROM events),
j AS (SELECT query_id, ok, CASE WHEN m IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, 0.5::DOUBLE * c + 0.3::DOUBLE * m + 0.2::DOUBLE * q)) END::DOUBLE AS judged FROM t)
SELECT query_id, CASE WHEN ok THEN 0.6 ELSE 0.0 END::DOUBLE AS execution, round(judged, 8) AS judged, round(CASE WHEN ok THEN 0.3 + 0.7::DOUBLE * judged ELSE 0.0 END, 8)::DOUBLE AS blended FROM j""")
def execution_scores(spark, d):
    e = read_table(spark, d, "events")
    ok = F.col("event_type") != "error"
    middle = F.when(F.col("event_type") != "view", 0.5)
    judged = C.judge_overall(F.col("value") / 100.0, middle, F.lit(0.25), F.lit(None).cast("double"))
    out = e.select(F.col("event_id").alias("query_id"), ok.alias("ok"), judged.alias("judged"))
    return out.select("query_id", C.execution_score(F.col("ok")).alias("execution"), F.round("judged", 8).alias("judged"),
                      F.round(C.judged_execution_score(F.col("ok"), F.col("judged")), 8).alias("blended"))


@query("S29_expected_output_capture", """
WITH r AS (SELECT l_suppkey AS query_id, l_orderkey, l_quantity, l_shipdate, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS p FROM lineitem)
SELECT query_id, count(*) AS row_count, min(CASE WHEN p = 1 THEN l_orderkey END)::VARCHAR AS first_key,
  strftime(min(CASE WHEN p = 1 THEN l_shipdate END), '%Y-%m-%dT%H:%M:%S') AS first_date, count(*) FILTER (WHERE p <= 20)::INTEGER AS sampled, 3 AS columns FROM r GROUP BY 1""")
def capture(spark, d):
    li = read_table(spark, d, "lineitem")
    order = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")]
    keyed = li.select(F.col("l_suppkey").alias("query_id"), "l_orderkey", "l_quantity", "l_shipdate", "l_linenumber", "l_partkey")
    out = C.capture_expected(keyed, ["query_id"], order)
    first = F.get("sample_rows", F.lit(0))
    return out.select("query_id", "row_count", F.get(first, F.lit(0)).alias("first_key"), F.get(first, F.lit(2)).alias("first_date"),
                      F.size("sample_rows").alias("sampled"), (F.size("columns") - 2).alias("columns"))


_OUTCOME_SQL = """q AS (SELECT s_suppkey AS query_id, s_nationkey AS agent, CASE WHEN s_nationkey >= 3 THEN 'SELECT ' || s_suppkey END AS sql, s_acctbal < 0 AS broken FROM supplier),
r AS (SELECT l_suppkey AS query_id, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1),
o AS (SELECT query_id, agent, CASE WHEN sql IS NULL THEN 'no_sql' WHEN broken THEN 'failed' ELSE 'captured' END AS outcome, coalesce(n, 0) AS n FROM q LEFT JOIN r USING (query_id))"""


def _outcomes(spark, d):
    """A statement per supplier: some are missing, some fail, the others gave the supplier's large line items."""
    s = read_table(spark, d, "supplier").withColumns({
        "query_id": F.col("s_suppkey"), "agent": F.col("s_nationkey"),
        "sql": F.when(F.col("s_nationkey") >= 3, F.concat(F.lit("SELECT "), F.col("s_suppkey").cast("string")))})
    li = read_table(spark, d, "lineitem").filter("l_quantity > 49").withColumn("query_id", F.col("l_suppkey"))
    rows = li.select("query_id", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    captured = C.capture_expected(rows, ["query_id"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")])
    failures = s.filter("s_acctbal < 0").select("query_id", F.concat(F.lit("balance of "), "s_name", F.lit(" is negative")).alias("error"))
    return C.capture_outcomes(s.select("query_id", "agent", "sql"), captured, failures, ["query_id"])


@query("S29_capture_outcomes", f"""WITH {_OUTCOME_SQL}
SELECT query_id, outcome, CASE WHEN outcome = 'captured' THEN o.n END AS row_count, CASE WHEN outcome = 'captured' THEN least(o.n, 20) END::INTEGER AS sampled,
  CASE WHEN outcome = 'failed' THEN 'balance of ' || s_name || ' is negative' END AS generation_error FROM o JOIN supplier ON s_suppkey = query_id""")
def outcomes(spark, d):
    out = F.col("expected_output")
    return _outcomes(spark, d).select(
        "query_id", "outcome", out["row_count"].alias("row_count"), F.when(out.isNotNull(), F.size(out["sample_rows"])).alias("sampled"), "generation_error")


@query("S29_capture_counts", f"""WITH {_OUTCOME_SQL}
SELECT agent, count(*) AS total_queries, count(*) FILTER (WHERE outcome = 'captured') AS success_count, count(*) FILTER (WHERE outcome <> 'captured') AS fail_count FROM o GROUP BY 1""")
def outcome_counts(spark, d):
    return C.capture_counts(_outcomes(spark, d), ["agent"])


@query("U4_fulfilled_intents", """
WITH t AS (SELECT doc_id, [lang, source, 'x'] AS a, [lang, 'x', 'y'] AS b FROM documents)
SELECT doc_id, array_to_string(list_sort(list_intersect(a, b)), ',') AS matched, array_to_string(list_sort(list_filter(a, lambda v: NOT list_contains(b, v))), ',') AS missing FROM t""")
def fulfilled(spark, d):
    a = F.array("lang", "source", F.lit("x"))
    b = F.array("lang", F.lit("x"), F.lit("y"))
    return read_table(spark, d, "documents").select(
        "doc_id", F.concat_ws(",", F.array_sort(F.array_intersect(a, b))).alias("matched"),
        F.concat_ws(",", F.array_sort(F.array_except(a, b))).alias("missing"))


@query("U5_overlap_coefficient", """
WITH t AS (SELECT b.item_id, list_distinct(string_split(lower(b.text), ' ')) AS a, list_distinct(string_split(lower(n.text), ' ')) AS c
  FROM benchmark b JOIN benchmark n ON n.item_id = b.item_id + 1)
SELECT item_id, round(len(list_intersect(a, c))::DOUBLE / least(len(a), len(c)), 8) AS overlap FROM t""")
def overlap(spark, d):
    from veriscope.functions.sql_shape import overlap as coefficient
    b = read_table(spark, d, "benchmark")
    words = F.array_distinct(F.split(F.lower("text"), " ", -1))
    left = b.select("item_id", words.alias("a"))
    right = b.select((F.col("item_id") - 1).alias("item_id"), words.alias("c"))
    return left.join(right, ["item_id"]).select("item_id", F.round(coefficient(F.col("a"), F.col("c")), 8).alias("overlap"))


@query("U6_registered_and_legacy_agents", """
SELECT DISTINCT event_type AS agent FROM events UNION SELECT DISTINCT role FROM conversations""")
def agents_union(spark, d):
    new = read_table(spark, d, "events").select(F.col("event_type").alias("agent"))
    old = read_table(spark, d, "conversations").select(F.col("role").alias("agent"))
    return new.unionByName(old).distinct()


@query("J12_positional_join", """
WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS p FROM events),
s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT r.user_id AS user_id, p AS position, r.event_id AS by_value, s.event_id AS by_time FROM r FULL JOIN s USING (user_id, p)""")
def positional(spark, d):
    from veriscope.operators.ordering import rank_within
    e = read_table(spark, d, "events").select("user_id", "event_id", "value")
    a = rank_within(e, ["user_id"], [F.col("value"), F.col("event_id")], "position").select("user_id", "position", F.col("event_id").alias("by_value"))
    b = rank_within(e, ["user_id"], [F.col("event_id")], "position").select("user_id", "position", F.col("event_id").alias("by_time"))
    return a.join(b, ["user_id", "position"], "full")
