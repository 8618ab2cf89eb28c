"""Data quality, catalogs and schema changes."""

import datetime as dt

from pyspark.sql import functions as F

from veriscope.operators import alerts as A
from veriscope.operators import catalog as C
from veriscope.operators import quality as Q
from veriscope.operators import reports as R

AT = dt.datetime(2024, 1, 31)


def test_null_share_must_exceed_the_limit(spark):
    rows = [(i, None if i < 1 else "x", None if i < 2 else "y") for i in range(5)]
    df = spark.createDataFrame(rows, "id int, twenty string, forty string")
    issues = Q.null_issues(df, "public", "t").collect()
    assert [(i.column_name, i.percentage, i.message) for i in issues] == [("forty", 40.0, "Column 'forty' has 40.0% NULL values")]
    assert issues[0].details == {"null_count": "2", "total_rows": "5"}


def test_duplicates_look_at_all_columns(spark):
    names = [f"c{i}" for i in range(11)]
    same = [tuple(range(11)), tuple(range(10)) + (99,)]
    df = spark.createDataFrame(same, ", ".join(f"{n} int" for n in names))
    assert Q.duplicate_groups(df).first().duplicate_groups == 0
    assert Q.duplicate_groups(df, limit=10).first().duplicate_groups == 1
    assert Q.duplicate_groups(df, names[5:]).first().duplicate_groups == 0


def test_key_check(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    r = Q.key_check(df, ["k"]).first()
    assert (r.total_rows, r.distinct_keys, r.null_keys, r.is_key) == (3, 2, 1, False)
    assert Q.key_check(df, ["v"]).first().is_key


def test_large_tables_and_empty_report(spark):
    df = spark.range(10)
    assert Q.large_table_issues(df, "p", "t", limit=9).count() == 1
    assert Q.large_table_issues(df, "p", "t", partitioned=True, limit=9).count() == 0
    report = Q.issue_report({"t": df}, {"t": ["id"]})
    assert report.count() == 0


def test_failing_checks_are_reported_as_skipped(spark):

    report = Q.issue_report({"t": spark.range(3)}, {"t": []}, extra=[lambda d, s, t: d.select(F.col("missing"))])
    assert [r.issue_type for r in report.collect()] == ["missing_primary_key", "check_skipped"]


def _catalog(spark, rows):
    return spark.createDataFrame([(1, "public", *r, True) for r in rows],
                                 "agent_id int, schema_name string, table_name string, column_name string, data_type string, is_nullable boolean")


def test_schema_changes(spark):
    stored = _catalog(spark, [("t", "a", "int"), ("t", "b", "int"), ("gone", "x", "int")])
    current = _catalog(spark, [("t", "a", "bigint"), ("t", "c", "int"), ("new", "y", "int")])
    plain = {(r.change_type, r.table_name, r.column_name) for r in C.schema_changes(current, stored).collect()}
    assert plain == {("table_added", "new", None), ("column_added", "t", "c"), ("column_added", "new", "y")}
    every = {(r.change_type, r.column_name) for r in C.schema_changes(current, stored, True, True).collect()}
    assert {("column_removed", "b"), ("column_removed", "x"), ("type_changed", "a")} <= every
    assert C.schema_changes(stored, stored, True, True).count() == 0


def test_version_roll_and_scan(spark):
    agents = spark.createDataFrame([(1, 1, 0, 5, None), (2, 3, 4, 0, None)],
                                   "agent_id int, schema_version int, schema_change_count long, gt_query_count long, last_schema_scan_at timestamp_ntz")
    stored = _catalog(spark, [("t", "a", "int")])
    current = _catalog(spark, [("t", "a", "int"), ("n", "b", "int")])
    out = C.scan(agents, stored, current, AT)
    got = {r.agent_id: r for r in out["agents"].collect()}
    assert (got[1].schema_version, got[1].schema_change_count) == (2, 2)
    assert (got[2].schema_version, got[2].schema_change_count, got[2].last_schema_scan_at) == (3, 4, AT)
    assert out["catalog"].count() == 2 and out["log"].count() == 2
    assert C.scan(agents, out["catalog"], current, AT)["changes"].count() == 0


def test_inferred_relationships(spark):
    catalog = _catalog(spark, [("orders", "customer_id", "int"), ("orders", "_id", "int"), ("orders", "total", "int")])
    got = [(r.source_column, r.target_table, r.target_column) for r in C.inferred_relationships(catalog).collect()]
    assert got == [("customer_id", "customers", "_id")]


def test_value_profile(spark):
    rows = [("a" if i % 2 else "b", str(i), "same") for i in range(12)]
    out = C.value_profile(spark.createDataFrame(rows, "two string, many string, one string")).collect()
    assert [(r.column_name, r.distinct_values, r.sample_values) for r in out] == [("two", 2, "a, b")]
    many = spark.range(1000).selectExpr("cast(id as string) AS a", "id AS b")
    assert C.value_profile(many).collect() == []


def test_nested_catalog_round_trip(spark):
    flat = _catalog(spark, [("t", "b", "int"), ("t", "a", "text"), ("u", "c", "int")])
    back = C.flat_catalog(C.nested_catalog(flat))
    assert sorted((r.table_name, r.column_name, r.data_type) for r in back.collect()) == [("t", "a", "text"), ("t", "b", "int"), ("u", "c", "int")]


def test_unqualified_names_keep_every_column(spark):
    rows = [("s1", "t", "a"), ("s1", "t", "b"), ("s1", "u", "a"), ("s2", "u", "a")]
    df = spark.createDataFrame(rows, "schema_name string, table_name string, column_name string")
    got = sorted((r.lookup_name, r.column_name) for r in C.with_unqualified_names(df).collect() if "." not in r.lookup_name)
    assert got == [("t", "a"), ("t", "b")]


def test_health_states(spark):
    agents = spark.createDataFrame(
        [("quiet_up", "u", True), ("quiet_down", "u", False), ("busy_down", "u", False), ("no_url", None, True)],
        "agent_name string, agent_url string, is_up boolean").selectExpr("*", "'active' AS status")
    queries = spark.createDataFrame([("busy_down", dt.datetime(2024, 1, 30, 23, 55)), ("quiet_up", dt.datetime(2024, 1, 30, 23, 49))],
                                    "agent_type string, created_at timestamp_ntz")
    got = {r.agent_name: r.health_status for r in A.telemetry_health(agents, queries, AT).collect()}
    assert got == {"quiet_up": "sdk_issue", "quiet_down": "unhealthy", "busy_down": "healthy", "no_url": "unknown"}


def test_accuracy_drop_severity(spark):
    rows = [("a", 1, 90.0, 5), ("a", 2, 80.0, 5), ("a", 3, 69.9, 5), ("a", 4, 95.0, 5)]
    out = A.accuracy_drop_alerts(spark.createDataFrame(rows, "agent_type string, day int, accuracy double, total long"))
    assert [(r.day, r.severity) for r in out.orderBy("day").collect()] == [(2, "medium"), (3, "high")]


def test_no_alert_for_few_evaluations(spark):
    df = spark.createDataFrame([(i, 0.1, AT) for i in range(5)], "query_id int, final_score double, created_at timestamp_ntz")
    assert A.accuracy_alert(df).count() == 0
    assert A.accuracy_alert(df.union(df)).first().n == 10


def test_empty_metrics_divide_safely(spark):
    empty = spark.createDataFrame([], "result string, final_score double, structural_score double, semantic_score double, llm_score double, evaluation_data string")
    r = R.overall_metrics(empty).first()
    assert (r.total, r.accuracy, r.avg_score) == (0, 0.0, None)


def test_profile_of_odd_tables(spark):
    rows = [(1, "a", [1], 0.5), (1, "a", [1], 0.5), (1, "a", [2], 0.5), (2, None, None, None), (None, None, [1], None), (None, "a", [1], None)]
    df = spark.createDataFrame(rows, "`k 1` int, `v.2` string, x array<int>, n_rows double")
    r = Q.table_profile(df, ["k 1"]).first()
    assert (r.total_rows, r.distinct_keys, r.null_keys, r.duplicate_groups, r.nulls) == (6, 3, 2, 1, [2, 2, 1, 3])
    r = Q.table_profile(df).first()
    assert (r.total_rows, r.distinct_keys, r.null_keys, r.duplicate_groups) == (6, None, None, 1)
    r = Q.table_profile(df.limit(0), ["k 1"]).first()
    assert (r.total_rows, r.distinct_keys, r.null_keys, r.duplicate_groups, r.nulls) == (0, 0, 0, 0, [0, 0, 0, 0])


def test_profile_tells_nulls_from_their_neighbours(spark):
    """Rows that differ in where their null lies are no duplicates."""
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a")], "x string, y string")
    assert Q.table_profile(df).first().duplicate_groups == 0


def test_report_from_profiles(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    got = Q.issue_report({"t": df, "ok": spark.range(3)}, {"t": ["k"], "ok": ["id"]}).collect()
    assert {(r.table_name, r.issue_type, r.column_name, r.affected_rows, r.percentage) for r in got} == {
        ("t", "missing_primary_key", None, None, None), ("t", "high_null_percentage", "v", 1, 33.33), ("t", "duplicate_rows", None, 1, None)}
    assert {r.message for r in got} >= {"Column 'v' has 33.3% NULL values", "1 duplicate row groups found"}
    big = Q.profile_issues(Q.table_profile(spark.range(30), ["id"]), "p", "t", ["id"], True, large=29)
    assert [(r.issue_type, r.message) for r in big.collect()] == [("large_table_no_index", "Large table (30 rows) with no indexes")]


def test_scan_of_tables_against_the_stored_catalog(spark):

    tables = {"t": spark.createDataFrame([(1, "a")], "k int, v string"), "new": spark.range(4), "same": spark.range(2)}
    stored = C.catalog_rows(spark, {"t": spark.createDataFrame([], "k long, w string"), "same": spark.range(1), "gone": spark.range(1)})
    got = C.scan_tables(tables, stored.withColumn("agent_id", F.lit(7)), 7).collect()
    assert {tuple(r) for r in got} == {("t", 1, 1, 1, 1), ("new", 1, 0, 0, 4), ("same", 0, 0, 0, 2), ("gone", 0, 1, 0, None)}


def test_catalog_difference_and_constraint_join(spark):

    shape = "agent_id int, schema_name string, table_name string, column_name string"
    now = spark.createDataFrame([(1, "p", "t", "a"), (1, "p", "t", "a"), (1, "p", "t", None), (2, "p", "t", "a")], shape)
    before = spark.createDataFrame([(2, "p", "t", "a"), (2, "p", "t", "a")], shape)
    assert {tuple(r) for r in C.catalog_difference(now, before).collect()} == {(1, "p", "t", "a"), (1, "p", "t", None)}
    left = spark.createDataFrame([("s", "c1", 1), ("s", "c1", 2), (None, "c1", 3)], "schema string, name string, l int")
    right = spark.createDataFrame([("s", "c1", "x"), (None, "c1", "y")], "schema string, name string, r string")
    assert {(r.l, r.r) for r in C.constraint_join(left, right, ["schema", "name"]).collect()} == {(1, "x"), (2, "x")}
