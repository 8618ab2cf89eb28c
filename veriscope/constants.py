"""Fixed values.

Everything in this file must equal the published behaviour exactly: thresholds,
weights, word lists and text patterns. Nothing here is computed.
"""

# --- question drift -------------------------------------------------------
SIMILARITY_NORMAL = 1.0 - 0.3
SIMILARITY_MEDIUM = 1.0 - 0.5
ZERO_NORM = 0.01
BASELINE_QUESTIONS = 50

# --- result drift (Population Stability Index) ----------------------------
PSI_BUCKETS = 10
PSI_MIN_SAMPLES = 20
PSI_FLOOR = 0.0001
PSI_MEDIUM = 0.10
PSI_HIGH = 0.20
PSI_DIGITS = 4

# fixed values: column names that are never metrics
NON_METRIC_NAMES = (
    "id", "c_date", "date", "campaign_id", "category", "campaign_name", "name",
    "status", "type", "timestamp", "created_at", "updated_at", "row_id", "log_id",
)
# fixed values: column name endings that are never metrics
NON_METRIC_SUFFIXES = (
    "_id", "_date", "_at", "_time", "_name", "_code", "_key", "_status", "_type", "_label",
)

# --- result comparison ----------------------------------------------------
VALUE_EPSILON = 0.0001
SAMPLE_ROWS = 10
EXPECTED_ROWS = 20

# --- evaluation -----------------------------------------------------------
PASS_THRESHOLD = 0.60
GT_MATCH = 0.70
GT_TRUST = 0.80
GT_USE_OUTPUT = 0.65

# fixed values: replies that are not data queries
NON_DATA_REPLIES = (
    "this is not a database",
    "not a database-related",
    "not a data",
    "please provide a question",
    "i cannot answer",
    "not related to",
    "cannot generate sql",
    "provide a question related",
)

# fixed values: questions that are not business questions
NON_BUSINESS_PATTERNS = (
    r"\btell\s+(?:me\s+)?(?:a\s+)?joke\b",
    r"\bfunny\s+joke\b",
    r"^(?:hi|hello|hey)\b[\s!.]*$",
    r"\bhow\s+are\s+you\b",
    r"\bwhat(?:\'s|\s+is)\s+(?:your\s+)?name\b",
    r"\bwrite\s+(?:a\s+)?(?:poem|story|song|essay)\b",
    r"\bwho\s+(?:are|is)\s+you\b",
    r"\bthank(?:s| you)\b",
    r"^(?:lol|haha|ok|okay|sure|bye|goodbye)[\s!.]*$",
)

# fixed values: statement words that make a query unsafe to run
WRITE_KEYWORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE",
    "REPLACE", "MERGE", "GRANT", "REVOKE",
)

# fixed values: payload fields that carry SQL, and the pattern that recognises SQL
SQL_FIELDS = ("sql", "generated_sql", "sql_query", "response_sql", "query_sql")
SQL_TEXT_PATTERN = (
    r"\b(SELECT\s.+\sFROM|INSERT\s+INTO|UPDATE\s.+\sSET|DELETE\s+FROM|WITH\s.+\sAS)\b"
)

# fixed values: comparison direction phrases
LESS_PHRASES = (
    "less than", "fewer than", "below", "under", "smaller than", "at most",
    "no more than", "not more than", "no greater than",
)
MORE_PHRASES = (
    "more than", "greater than", "above", "over", "larger than", "at least",
    "no less than", "not less than", "no fewer than",
)

# fixed values: words that are never a WHERE column
WHERE_SKIP_WORDS = ("and", "or", "not", "where", "is", "in", "like", "between")

# fixed values: error categories in the order they are tried
ERROR_PATTERNS = {
    "SQL_GENERATION": (
        r"syntax error", r"invalid sql", r"could not parse", r"failed to generate",
        r"empty sql", r"no sql returned", r"unexpected token",
    ),
    "CONTEXT_RETRIEVAL": (
        r"relation .* does not exist", r"column .* does not exist", r"table .* not found",
        r"schema .* does not exist", r"unknown column", r"no such table",
    ),
    "DATA_ERROR": (
        r"no rows returned", r"empty result", r"0 rows", r"no data", r"null value",
        r"out of range", r"invalid input syntax for type",
    ),
    "INTEGRATION": (
        r"connection refused", r"timeout", r"connection error", r"http error",
        r"service unavailable", r"could not connect", r"max retries",
    ),
    "AGENT_LOGIC": (
        r"incorrect logic", r"wrong aggregation", r"missing filter", r"wrong table",
        r"incorrect join",
    ),
}
# fixed values: severity of a matched category
ERROR_SEVERITY = {
    "SQL_GENERATION": "high",
    "CONTEXT_RETRIEVAL": "high",
    "DATA_ERROR": "medium",
    "INTEGRATION": "critical",
    "AGENT_LOGIC": "medium",
}
# fixed values: advice per category
ERROR_ADVICE = {
    "SQL_GENERATION": "Check few-shot examples, add more schema context to prompt",
    "CONTEXT_RETRIEVAL": "Verify schema_info refresh — table/column may have changed",
    "DATA_ERROR": "Query is valid but data missing — check filters / date range",
    "INTEGRATION": "Check DB connection / agent HTTP server is running",
    "AGENT_LOGIC": "Review prompt and few-shot examples for this query pattern",
    "UNKNOWN": "Manual review needed",
}
CLASSIFIABLE_ERRORS = ("SYNTAX_ERROR", "UNDEFINED_TABLE", "UNDEFINED_COLUMN")

# --- data quality ---------------------------------------------------------
NULL_SHARE_LIMIT = 20
LARGE_TABLE_ROWS = 100_000

# --- alerts and health ----------------------------------------------------
ALERT_MEAN_SCORE = 0.90
ALERT_LAST_N = 50
ALERT_MIN_COUNT = 5
DEGRADED_ACCURACY = 80
TELEMETRY_GAP_MINUTES = 10
ERROR_SPIKE_COUNT = 10
