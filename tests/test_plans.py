"""Registered queries against their SQL, and what the plans look like.

A selection runs by default; VERISCOPE_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SOME = (
    "P4_result_drift_by_supplier", "P6_result_drift_skip_states", "A21_exact_deciles", "V2_cosine_drift", "V3_drift_skip_states",
    "G1_ground_truth_match", "A2_agent_metrics", "A4_accuracy_trend_pivot", "A11_agent_summary", "A13_recent_accuracy_by_agent",
    "W3_rolling_accuracy", "K5_history", "J4_history_joins", "L4_error_spikes", "H1_telemetry_health", "E1_error_categories",
    "D7_issue_report", "R5_schema_changes", "R11_value_profile", "Q1_schema_references", "Q5_intent_scores", "Q11_sql_similarity",
    "G8_evaluation", "C5_unordered_comparison", "C8_partial_schema_comparison", "U3_membership_rate", "S8_first_order_wins",
    "S11_ground_truth_index", "S25_append_entries", "B12_ordered_with_best_seller", "B17_supplier_scores", "B19_forecast",
    "T1_scored_stream", "T2_high_drift_windows", "T4_telemetry_sessions", "T5_deduplicated_stream", "S18_telemetry_ingest",
)
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = list(QUERIES) if os.environ.get("VERISCOPE_ALL") else SOME


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, folder, name):
    message, ok = compare(spark, con, name, QUERIES[name], ORACLES.get(name), folder)
    assert ok or message.startswith("ok"), message


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["A1_overall_metrics", "A2_agent_metrics", "B4_sales_by_region_and_segment", "D2_null_shares", "K5_history"])
def test_no_cartesian_products(spark, folder, name):
    assert "CartesianProduct" not in plan(QUERIES[name](spark, folder))


def test_null_shares_scan_once(spark, folder):
    physical = QUERIES["D2_null_shares"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("FileScan") == 1


def test_last_n_is_limited_before_the_shuffle(spark, folder):
    physical = QUERIES["A13_recent_accuracy_by_agent"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("WindowGroupLimit") == 2


def test_scans_read_only_what_they_need(spark, folder):
    physical = QUERIES["B1_totals_of_a_year"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" not in physical and "PushedFilters: [IsNotNull(o_orderdate)" in physical
