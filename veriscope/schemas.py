"""Schemas of the stored telemetry and monitoring tables, as DDL text.

Text needs no session, so modules can be imported before one exists.
"""

TELEMETRY = (
    "query_id string, query_text string, agent_type string, status string, "
    "generated_sql string, error string, execution_time_ms double, "
    "created_at timestamp_ntz, agent_response string, user_id string, session_id string"
)

EVALUATIONS = (
    "query_id string, query_text string, agent_type string, complexity string, "
    "generated_sql string, ground_truth_sql string, structural_score double, "
    "semantic_score double, llm_score double, final_score double, result string, "
    "confidence double, reasoning string, evaluation_data string, created_at timestamp_ntz"
)

ERRORS = (
    "query_id string, evaluation_id long, error_category string, error_message string, "
    "severity string, suggested_fix string, first_seen timestamp_ntz, last_seen timestamp_ntz"
)

DRIFT = (
    "query_id string, query_embedding array<float>, drift_score double, "
    "drift_classification string, similarity_to_baseline double, is_anomaly boolean, "
    "created_at timestamp_ntz"
)

PSI_BASELINE = (
    "agent_type string, column_name string, bucket_edges array<double>, "
    "expected_pct array<double>, sample_count long"
)

PSI_RESULTS = (
    "query_id string, agent_type string, psi_scores map<string,double>, overall_psi double, "
    "drift_classification string, is_anomaly boolean, columns_analyzed int, "
    "created_at timestamp_ntz"
)

CATALOG = (
    "agent_id string, schema_name string, table_name string, column_name string, "
    "data_type string, is_nullable boolean"
)

ISSUES = (
    "agent_id string, schema_name string, table_name string, column_name string, "
    "issue_type string, severity string, message string, details map<string,string>, "
    "affected_rows long, total_rows long, percentage double"
)

GROUND_TRUTH_ENTRY = (
    "struct<query_id:string, query_text:string, natural_language:string, query:string, "
    "sql:string, complexity:string, agent_type:string, expected_output:"
    "struct<columns:array<string>, row_count:long, sample_rows:array<array<string>>, "
    "execution_time_ms:double>, generation_error:string>"
)
GROUND_TRUTH_DOCUMENT = (
    f"agent_id string, agent_name string, total_queries long, queries array<{GROUND_TRUTH_ENTRY}>"
)

EVENTS = (
    "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
)
