"""Work that is done for many columns or patterns of a row at once."""

import random

from pyspark.sql import functions as F

from veriscope.functions import intents as I
from veriscope.functions import psi as P
from veriscope.functions import text as X
from veriscope.operators import result_drift as R


def test_buckets_of_several_columns_are_those_of_one(spark):
    edges = [[0.0, 1.0], [0.0, 1.0, 2.5, 7.0], [float("-inf"), 0.0, float("inf")], [float(i) for i in range(11)]]
    values = [None, -1.0, 0.0, 0.5, 1.0, 2.5, 7.0, 8.0, 10.0, float("nan"), float("inf"), float("-inf"), -0.0]
    rows = spark.createDataFrame([(v, e) for v in values for e in edges], "v double, e array<double>")
    one, several = (P.bucket_of(F.col("v"), F.col("e"), several=s) for s in (False, True))
    assert rows.filter(~one.eqNullSafe(several)).count() == 0


def test_wide_rows_are_placed_without_a_comparison_per_edge(spark):
    """Ten edges in each of four columns made a method of generated code that was too long to be compiled."""
    names = ["a", "b", "c", "d"]
    base = spark.createDataFrame([("x", n, [float(i) for i in range(11)], [0.1] * 10) for n in names],
                                 "agent_type string, column_name string, bucket_edges array<double>, expected_pct array<double>")
    rows = spark.createDataFrame([(1, "x", 1.0, 2.0, 3.0, None)], "query_id long, agent_type string, a double, b double, c double, d double")
    found = R.column_psi_of_rows(rows, names, base)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(") >= 4 and plan.count("[10]") == 0
    assert sorted((r.column_name, r.value_count) for r in found.collect()) == [("a", 1), ("b", 1), ("c", 1)]


def test_whatever_a_pattern_matches_holds_one_of_its_marks(spark):
    words = """total sum overall average mean avg count number of how many price kind per by for each breakdown break down group split
        top highest maximum best in terms lowest minimum bottom worst first limit 5 list show get find select with where having < > = >=
        campaigns products users customers orders greater less equal above below between than to have contain whose name named called the
        case-insensitive matching starts start ends end with includes their its 'x' "y" a.b 12""".split()
    pick = random.Random(7)
    texts = spark.createDataFrame([(" ".join(pick.choices(words, k=pick.randint(1, 7))),) for _ in range(6000)], "q string")
    checks = [(I.COMPARISON_PATTERNS, I.COMPARISON_MARKS), (I.TEXT_SEARCH_PATTERNS, I.TEXT_SEARCH_MARKS)]
    for intent, marks in I.PHRASE_MARKS.items():
        checks.append(([p.replace("{M}", "price").replace("{D}", "kind") for p, i in I.PHRASES if i == intent], marks))
    assert {i for _, i in I.PHRASES} == set(I.PHRASE_MARKS)
    for patterns, marks in checks:
        hit = F.col("q").rlike(X.any_of(patterns))
        n = texts.agg(F.count_if(hit), F.count_if(hit & ~X.contains_any(F.col("q"), marks))).first()
        assert n[0] > 0 and n[1] == 0, (patterns, n)
