"""Text rules, clause extraction and scores on golden pairs."""

import pytest
from pyspark.sql import functions as F

from veriscope.functions import intents as I
from veriscope.functions import sql_shape as S
from veriscope.functions import text as X
from veriscope.operators import errors as E
from veriscope.operators import scoring as G


def one(spark, value, fn, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, key", [("  Top 5?! ", "top 5"), ("a?b.", "a?b"), ("\tX\n", "x"), ("?!.", "")])
def test_question_key(spark, text, key):
    assert one(spark, text, X.question_key) == key


@pytest.mark.parametrize("sql, clean", [
    ("```sql\nSELECT 1\n```", "SELECT 1"), ("  SELECT 2 ", "SELECT 2"), ("```SELECT sql_id", "```SELECT _id"),
    ("text ```sql SELECT sql FROM t``` more", "SELECT  FROM t"),
])
def test_clean_sql(spark, sql, clean):
    assert one(spark, sql, X.clean_sql) == clean


def test_clean_sql_can_keep_the_word(spark):
    assert one(spark, "```sql SELECT sql_id FROM t```", lambda c: X.clean_sql(c, drop_sql_word=False)) == "SELECT sql_id FROM t"


@pytest.mark.parametrize("question, business", [
    ("tell me a joke", False), ("Hi!", False), ("high priority orders", True), ("thanks", False),
    ("what is your name", False), ("show sales", True), ("OK ..", False), ("okay then show", True),
])
def test_business(spark, question, business):
    assert one(spark, question, X.is_business_question) is business


@pytest.mark.parametrize("sql, strict, words", [
    ("select 1", True, True), ("SELECT created_at FROM t", False, True), ("DROP TABLE t", False, False),
    (" with a as (select 1) select * from a", True, True), ("SELECT 1; DELETE FROM t", False, False),
])
def test_read_only(spark, sql, strict, words):
    assert one(spark, sql, X.is_read_only) is strict
    assert one(spark, sql, lambda c: X.is_read_only(c, whole_words=True)) is words


@pytest.mark.parametrize("sql, ordered", [
    ("select a from t order by a", True), ("select a from (select b from t order by b) x", False),
    ("select sum(a) from t order by 1", True), (None, False),
])
def test_orders_rows(spark, sql, ordered):
    assert one(spark, sql, X.orders_rows) is ordered


def test_polarity(spark):
    rows = [("orders below 5", "orders above 5", True), ("no more than 5", "less than 3", True),
            ("at least 3", "more than 2", False), ("orders", "above 3", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", X.polarity_conflict(F.col("a"), F.col("b"))).collect())


@pytest.mark.parametrize("item, bare", [
    ("c.region", "region"), ("AVG(o.profit) as avg_profit", "avg(profit)"), ("spend.orders o", "orders"),
    ("SUM(o.sales * o.qty) AS total", "sum(sales * qty)"), ("coalesce(sum(a.x), 0)", "coalesce(sum(x), 0)"),
    (" Region ", "region"), ("f(a.b) + c.d", "f(b) + c.d"),
])
def test_bare_reference(spark, item, bare):
    assert one(spark, item, S.bare_reference) == bare


def test_prefixes_go_in_calls_of_any_length(spark):
    call = "f({})"
    names = [f"c{i}" for i in range(1500)]
    prefixed = call.format(", ".join(f"t.{n}" for n in names))
    assert len(prefixed) > 9000
    assert one(spark, prefixed, S.bare_reference) == call.format(", ".join(names))
    assert one(spark, "g(a.b, h(c.d.e)) x.y f(p.q r.s", S.bare_reference) == "g(b, h(d.e)) x.y f(p.q r.s"


def test_known_columns_limit_the_prefix_rule(spark):
    assert one(spark, "a.b c.d", lambda c: S.bare_reference(c, ["z"])) == "a.b c.d"


def test_clauses(spark):
    sql = ("SELECT  a, SUM(b) AS s FROM x.t LEFT JOIN u ON t.i = u.i\nWHERE a > 3 AND c LIKE 'x%' GROUP BY a HAVING s > 1 "
           "ORDER BY s DESC, a LIMIT 7;")
    c = S.with_clauses(spark.createDataFrame([(sql,)], "q string"), "q", "c").first().c.asDict()
    assert c == {
        "select": ["a", "sum(b) as s"], "from": ["x.t"], "where": ["a > 3 and c like 'x%'"], "group_by": ["a"],
        "order_by": ["s desc", "a"], "limit": "7", "joins": ["u"],
    }


@pytest.mark.parametrize("where, pairs", [
    ("o.a between 1 and 2 and b >= 3", {"a between", "b >="}), ("x in (1, 2) and y is not null", {"x in", "y is_null"}),
    ("a = 'x' or not b like 'y'", {"a =", "b like"}), ("a = b", set()),
])
def test_where_pairs(spark, where, pairs):
    assert set(one(spark, where, S.where_pairs)) == pairs


@pytest.mark.parametrize("a, b, score", [
    ("SELECT a FROM t;", "select  a from T", 1.0),
    ("SELECT a FROM t WHERE a > 3", "SELECT a FROM t WHERE a > 9", 0.94),
    ("SELECT a FROM t", "SELECT b FROM t", 0.6),
    ("SELECT a FROM t WHERE a > 3 AND b = 1", "SELECT a FROM t WHERE a > 3 AND c = 1", 0.8 + 0.2 * (0.6 / 3 + 0.35 / 2)),
    ("SELECT a FROM t WHERE a > 3", "SELECT a FROM t", 0.8),
])
def test_sql_similarity(spark, a, b, score):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert S.sql_similarity(df, "a", "b").first().similarity == pytest.approx(score)


MEASURES, DIMENSIONS = ["sales", "profit"], ["region", "category"]


@pytest.mark.parametrize("question, asked", [
    ("Show me the top 5 products by sales", {"maximization", "limiting"}),
    ("List all product categories", set()),
    ("sales per region", {"grouping"}),
    ("What is the total sales?", {"summation"}),
    ("products with sales greater than 100", {"filtering"}),
    ("average profit by region", {"aggregation", "grouping"}),
    ("highest profit", {"maximization"}),
    ("customers named Bob sorted by name", {"filtering", "sorting"}),
])
def test_requested_intents(spark, question, asked):
    got = one(spark, question, lambda c: I.requested(F.lower(c), MEASURES, DIMENSIONS))
    assert set(got) == asked


def test_total_without_schema_is_a_summation(spark):
    assert one(spark, "grand total please", lambda c: I.requested(F.lower(c), [], [])) == ["summation"]


@pytest.mark.parametrize("sql, done", [
    ("SELECT MAX(a) FROM t", {"maximization"}), ("SELECT a FROM t ORDER BY a", {"sorting", "minimization"}),
    ("SELECT a, COUNT(*) FROM t WHERE b GROUP BY a ORDER BY 2 DESC LIMIT 3", {"summation", "filtering", "grouping", "sorting", "maximization", "limiting"}),
])
def test_performed(spark, sql, done):
    assert set(one(spark, sql.upper(), I.performed)) == done


@pytest.mark.parametrize("sql, score", [
    ("SELECT * FROM T", 0.65), ("SELECT * FROM T LIMIT 5", 0.62), ("SELECT A FROM T, U", 0.60),
    ("SELECT A, SUM(B) AS S FROM T GROUP BY A ORDER BY S DESC LIMIT 5", 0.93), ("SELECT *, SUM(A) FROM T WHERE B", 0.49),
    ("SELECT DISTINCT A FROM T", 0.80),
])
def test_pattern_score(spark, sql, score):
    assert one(spark, sql, I.pattern_score) == pytest.approx(score)


def test_scores_stay_in_range(spark):
    sql = "SELECT *, SUM(A) FROM T, U LIMIT 1"
    df = spark.createDataFrame([("how many, average and lowest by sales", sql)], "query_text string, generated_sql string")
    r = G.text_scores(df, MEASURES, DIMENSIONS).first()
    assert 0 <= r.intent_score <= 1 and 0 <= r.pattern_score <= 1


GOLDEN_ERRORS = [
    ("SQL_GENERATION", "high", "Syntax error at or near 'FROM'"), ("SQL_GENERATION", "high", "unexpected token 'LIMIT'"),
    ("CONTEXT_RETRIEVAL", "high", "relation 'public.users' does not exist"), ("CONTEXT_RETRIEVAL", "high", "no such table: x"),
    ("INTEGRATION", "critical", "HTTP error 503 service unavailable"), ("INTEGRATION", "critical", "max retries exceeded"),
    ("DATA_ERROR", "medium", "no rows returned for query"), ("DATA_ERROR", "medium", "10 rows"),
    ("AGENT_LOGIC", "medium", "missing filter condition"), ("AGENT_LOGIC", "low", "what happened"),
    ("UNKNOWN", "low", ""), ("UNKNOWN", "low", None), ("AGENT_LOGIC", "low", "relation x\ny does not exist"),
    ("SQL_GENERATION", "high", "syntax error: relation a does not exist"),
]


def test_error_categories(spark):
    df = spark.createDataFrame(GOLDEN_ERRORS, "category string, want string, error_message string")
    for r in E.classify_errors(df).collect():
        assert (r.error_category, r.severity, r.stored) == (r.category, r.want, r.category != "UNKNOWN"), r.error_message


def test_judgement(spark):
    text = "verdict:\n VERDICT: pass \nCONFIDENCE: .8\nREASONING: ok: yes\nVERDICT: FAIL\nVERDICT:PASS"
    r = one(spark, text, G.parse_judgement)
    assert (r.verdict, r.confidence, r.reasoning) == ("PASS", 0.8, "ok: yes")
    r = one(spark, "nothing", G.parse_judgement)
    assert (r.verdict, r.confidence, r.reasoning) == ("FAIL", 0.5, "nothing")
    r = one(spark, "VERDICT: maybe\nCONFIDENCE: high", G.parse_judgement)
    assert (r.verdict, r.confidence) == ("FAIL", 0.5)


def _evaluate(spark, **given):
    row = dict(generated_sql="SELECT a FROM t", query_text="sales", cleaned_sql="SELECT a FROM t", structural_score=1.0,
               requires_classification=False, has_ground_truth=False, intent_score=1.0, pattern_score=0.8, drift_quality=1.0,
               semantic_score=None, judge_score=None, judge_confidence=None, result_score=None)
    row.update(given)
    schema = ("generated_sql string, query_text string, cleaned_sql string, structural_score double, requires_classification boolean, "
              "has_ground_truth boolean, intent_score double, pattern_score double, drift_quality double, semantic_score double, "
              "judge_score double, judge_confidence double, result_score double")
    return G.evaluate(spark.createDataFrame([tuple(row.values())], schema)).first()


@pytest.mark.parametrize("given, path, score, result", [
    ({}, "heuristic", 0.95, "PASS"),
    ({"intent_score": 0.2, "drift_quality": 0.05, "structural_score": 0.4}, "heuristic", 0.0, "FAIL"),
    ({"structural_score": 0.4, "intent_score": 0.3, "drift_quality": 0.05}, "heuristic", 0.47, "FAIL"),
    ({"query_text": "tell me a joke"}, "non_business", 0.0, "FAIL"),
    ({"cleaned_sql": "SELECT 1"}, "no_from", 0.0, "FAIL"),
    ({"structural_score": 0.0, "requires_classification": True}, "classified_error", 0.0, "FAIL"),
    ({"structural_score": 0.0}, "structural_fail", 0.0, "FAIL"),
    ({"generated_sql": "I cannot answer"}, "non_data_reply", 0.0, "FAIL"),
    ({"has_ground_truth": True, "semantic_score": 1.0, "judge_score": 1.0, "judge_confidence": 0.9, "result_score": 1.0}, "ground_truth", 1.0, "PASS"),
    ({"has_ground_truth": True, "semantic_score": 0.5, "judge_score": 0.0, "judge_confidence": 0.9, "result_score": 0.5}, "ground_truth", 0.625, "PASS"),
    ({"has_ground_truth": True, "semantic_score": 1.0, "judge_score": 1.0, "judge_confidence": 0.9, "result_score": 0.2}, "heuristic_fallback", 0.95, "PASS"),
    ({"has_ground_truth": True, "semantic_score": 1.0, "judge_score": 0.0, "judge_confidence": 0.9, "result_score": None}, "heuristic_fallback", 0.95, "PASS"),
])
def test_decision_order(spark, given, path, score, result):
    r = _evaluate(spark, **given)
    assert (r.eval_path, r.result) == (path, result) and r.final_score == pytest.approx(score)


def test_result_score_zero_counts_as_missing(spark):
    df = spark.createDataFrame([(0.0,), (None,), (0.5,)], "r double")
    got = [r[0] for r in df.select(G.ground_truth_score(F.lit(1.0), F.lit(0.5), F.lit(1.0), F.col("r"))).collect()]
    assert got == pytest.approx([0.95, 0.95, 0.775])
