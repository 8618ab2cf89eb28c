"""Result comparison on hand-made result sets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veriscope.operators import compare as C

SCHEMA = "query_id long, n double, s string, d date"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(1, *r) for r in rows], schema)


def verdict(spark, actual, expected, a=SCHEMA, e=SCHEMA):
    return C.compare_results(frame(spark, actual, a), frame(spark, expected, e), ["query_id"]).first()


DAY = dt.date(2021, 2, 1)


def test_reordered_rows_with_tolerance_match(spark):
    r = verdict(spark, [(1.0, "a", DAY), (None, "b ", None)], [(None, " b", None), (1.00009, "a", DAY)])
    assert (r.score, r.is_match, r.content_match_rate) == (1.0, True, 1.0)


def test_difference_above_the_tolerance(spark):
    r = verdict(spark, [(1.0, "a", DAY)], [(1.00011, "a", DAY)])
    assert (r.score, r.is_match, r.row_count_match) == (0.0, False, True)


def test_row_count(spark):
    r = verdict(spark, [(1.0, "a", DAY)] * 2, [(1.0, "a", DAY)])
    assert (r.score, r.is_match, r.row_count_match) == (0.3, False, False)


def test_null_is_not_a_value(spark):
    assert verdict(spark, [(None, "a", DAY)], [(0.0, "a", DAY)]).content_match_rate == 0


def test_date_against_iso_text(spark):
    r = verdict(spark, [(1.0, "a", DAY)], [(1.0, "a", " 2021-02-01")], e="query_id long, n double, s string, d string")
    assert r.is_match


def test_subset_schema_counts_as_match_but_rows_differ(spark):
    r = verdict(spark, [(1.0, "a", DAY)], [(1.0,)], e="query_id long, N double")
    assert (r.schema_match, r.score) == (True, 0.0)


def test_overlapping_schema_is_rated_on_common_columns(spark):
    r = verdict(spark, [(1.0, "a"), (2.0, "b")], [(1.0, 5), (3.0, 6)],
                a="query_id long, n double, s string", e="query_id long, n double, x int")
    assert (r.schema_match, r.is_match) == (False, False)
    assert r.score == pytest.approx(0.25) and r.content_match_rate == 0.5


def test_disjoint_schema(spark):
    r = verdict(spark, [(1.0,)], [(1,)], a="query_id long, n double", e="query_id long, x int")
    assert (r.score, r.row_count_match, r.content_match_rate) == (0.1, False, 0.0)


@pytest.mark.parametrize("rate, score", [(0.99, 1.0), (0.95, 0.95), (0.8, 0.8), (0.79, 0.79)])
def test_ladder(spark, rate, score):
    assert spark.range(1).select(C.ladder(F.lit(rate))).first()[0] == score


def test_ordered_comparison_uses_positions(spark):
    schema = "query_id long, p int, v int"
    a = frame(spark, [(1, 10), (2, 20)], schema)
    e = frame(spark, [(1, 20), (2, 10)], schema)
    assert C.match_rate(a, e, ["query_id"], "p").first().content_match_rate == 0
    assert C.match_rate(a.drop("p"), e.drop("p"), ["query_id"]).first().content_match_rate == 1


def test_repeated_expected_rows_each_count(spark):
    schema = "query_id long, v double, s string"
    a = frame(spark, [(1.0, "x"), (2.0, None)], schema)
    e = frame(spark, [(1.0000000001, "x "), (1.0, "x"), (3.0, "y"), (2.0, None)], schema)
    assert C.membership_rate(a, e, ["query_id"]).first().content_match_rate == 0.75
    assert C.set_similarity(a, e, ["query_id"]).first().set_similarity == pytest.approx(2 / 3)


def test_number_and_text_are_different_rows(spark):
    a = frame(spark, [(1.0,)], "query_id long, v double")
    e = frame(spark, [("1.0",)], "query_id long, v string")
    assert C.membership_rate(a, e, ["query_id"]).first().content_match_rate == 0


def test_expected_output_scores(spark):
    rows = [(True, True, 1.0, 1.0, "HIGH"), (True, False, 1.0, 0.9, "MEDIUM"), (False, False, 0.5, 0.4, "LOW")]
    df = spark.createDataFrame(rows, "s boolean, c boolean, r double, want double, level string")
    score = C.expected_output_score(F.col("s"), F.col("c"), F.col("r"))
    for r in df.withColumn("score", score).withColumn("got", C.expected_output_confidence(F.col("score"))).collect():
        assert r.score == pytest.approx(r.want) and r.got == r.level


def test_latency(spark):
    rows = [(100.0, 50.0, "slower"), (50.0, 100.0, "faster"), (100.0, 100.0, "similar"), (None, 1.0, "unavailable"), (0.0, 5.0, "similar")]
    df = spark.createDataFrame(rows, "g double, r double, want string").withColumn("c", C.compare_latency(F.col("g"), F.col("r")))
    assert all(r.c.performance == r.want for r in df.collect())


def test_capture(spark):
    rows = [(float(i), f"s{i}", DAY) for i in range(25)]
    r = C.capture_expected(frame(spark, rows), ["query_id"], [F.col("n")]).first()
    assert (r.row_count, len(r.sample_rows), r.columns) == (25, 20, ["n", "s", "d"])
    assert r.sample_rows[0] == ["0.0", "s0", "2021-02-01"]


def test_fingerprints_find_equal_results_without_a_line_up(spark, monkeypatch):
    shape = "k string, x double, t string, d date"
    rows = [("same", 1.5, "a", None), ("same", 1.5, "a", None), ("same", None, "b", None), ("near", 1.0, "a", None), ("far", 1.0, "a", None),
            ("odd", float("nan"), "a", None), ("longer", 1.0, "a", None), (None, 2.0, "n", None), ("zero", 0.0, "z", None)]
    moved = [("near", 1.00005, " a ", None), ("far", 9.0, "a", None), ("odd", float("nan"), "a", None), ("same", None, "b", None), ("same", 1.5, "a", None),
             ("same", 1.5, "a", None), ("longer", 1.0, "a", None), ("longer", 1.0, "a", None), (None, 2.0, "n", None), ("zero", -0.0, "z", None), ("only", 1.0, "e", None)]
    actual, expected = spark.createDataFrame(rows, shape), spark.createDataFrame(moved, shape)
    lined = []
    rank = C.rank_within
    monkeypatch.setattr(C, "rank_within", lambda df, *args: lined.append({r.k for r in df.select("k").collect()}) or rank(df, *args))
    got = {r.k: (r.rows_actual, r.rows_expected, r.matched, r.content_match_rate) for r in C.match_rate(actual, expected, ["k"]).collect()}
    assert got == {"same": (3, 3, 3, 1.0), "near": (1, 1, 1, 1.0), "far": (1, 1, 0, 0.0), "odd": (1, 1, 0, 0.0), "longer": (1, 2, 0, 0.0),
                   None: (1, 1, 1, 1.0), "zero": (1, 1, 1, 1.0), "only": (0, 1, 0, 0.0)}
    assert lined == [{"near", "far", "odd"}] * 2


def test_pairs_of_rows_do_not_cancel_out(spark):
    """Two rows twice and another row twice have the same exclusive or, not the same sums."""
    a = spark.createDataFrame([(1, "x")] * 2, "k int, v string")
    b = spark.createDataFrame([(1, "y")] * 2, "k int, v string")
    assert C.match_rate(a, b, ["k"]).first().content_match_rate == 0.0
    c = spark.createDataFrame([(1, None, "x")], "k int, u string, v string")
    d = spark.createDataFrame([(1, "x", None)], "k int, u string, v string")
    assert C.match_rate(c, d, ["k"]).first().content_match_rate == 0.0


def test_capture_outcomes_and_counts(spark):
    queries = spark.createDataFrame(
        [(1, "a", "SELECT 1"), (2, "a", "SELECT 2"), (3, "b", None), (4, "b", ""), (5, "b", "SELECT 5"), (None, "b", "SELECT n")], "q int, agent string, sql string")
    rows = spark.createDataFrame([(1, 7, "x"), (1, 3, "y"), (2, 1, "half"), (None, 9, "n")], "q int, n int, s string")
    failures = spark.createDataFrame([(2, "timeout"), (2, "broken"), (9, "of no query"), (4, "never run")], "q int, error string")
    out = C.capture_outcomes(queries, C.capture_expected(rows, ["q"], [F.col("n")]), failures, ["q"])
    got = {r.q: (r.outcome, r.generation_error, r.expected_output and (r.expected_output.row_count, r.expected_output.sample_rows)) for r in out.collect()}
    assert got == {
        1: ("captured", None, (2, [["3", "y"], ["7", "x"]])), 2: ("failed", "broken", None), 3: ("no_sql", None, None), 4: ("no_sql", None, None),
        5: ("captured", None, (0, [])), None: ("captured", None, (1, [["9", "n"]])),
    }
    assert {tuple(r) for r in C.capture_counts(out, ["agent"]).collect()} == {("a", 2, 1, 1), ("b", 4, 2, 2)}
    assert C.capture_counts(out.limit(0)).first().total_queries == 0
