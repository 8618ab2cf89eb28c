"""Result drift of assessed events from wide rows and from one row per value."""

from datetime import datetime

from pyspark.sql import functions as F

from veriscope.operators.assessment import assess
from veriscope.operators.result_drift import to_long

NAMES = ["price", "tax"]


def test_wide_results_give_what_long_ones_give(spark):
    asked = [(1, "SELECT price FROM shop"), (2, "SELECT SUM(price) FROM shop"), (3, "SELECT tax FROM shop"), (4, "SELECT price FROM shop"), (5, "SELECT price FROM shop")]
    columns = ("query_id long, agent_type string, created_at timestamp_ntz, status string, query_text string, generated_sql string, error string, "
               "embedding array<float>, ground_truth_sql string, engine_error_type string, engine_error string, engine_failed boolean, "
               "judge_score double, judge_confidence double, result_score double")
    events = spark.createDataFrame(
        [(i, "x", datetime(2024, 1, 1), "success", "list price", q, None, [1.0, 0.0], None, None, None, False, None, 0.8, None) for i, q in asked], columns)
    # 3 has nulls in one column, 4 in both, 5 no rows
    wide = spark.createDataFrame([(1, float(i), float(i % 3)) for i in range(8)] + [(2, 1.0, 1.0), (3, None, 2.0), (4, None, None)], "query_id long, price double, tax double")
    base = spark.createDataFrame([("x", n, [0.0, 2.0, 5.0], [0.5, 0.5]) for n in NAMES], "agent_type string, column_name string, bucket_edges array<double>, expected_pct array<double>")
    fixed = {
        "catalog": spark.createDataFrame([("public", "shop", n) for n in NAMES], "schema_name string, table_name string, column_name string"),
        "measures": NAMES, "dimensions": ["kind"], "result_baseline": base,
        "baselines": spark.createDataFrame([("x", [1.0, 0.0])], "agent_type string, centroid array<double>"),
    }
    a = assess(events, results=to_long(wide, ["query_id"], NAMES), **fixed)
    b = assess(events, results=wide, result_columns=NAMES, **fixed)
    found = [{r.query_id: r for r in df.orderBy(F.col("query_id")).collect()} for df in (a, b)]
    assert found[0] == found[1]
    assert [found[1][i].psi_state for i in (2, 4, 5)] == ["aggregate_query", "empty_result", "empty_result"]
    assert found[1][1].psi is not None and found[1][3].psi is not None
