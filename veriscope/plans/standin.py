"""Telemetry tables derived from the driver's event table, in Spark and in SQL.

The event table plays the telemetry log: its type is the agent, its value the
latency. Questions and statements are templates over the driver's tables, error messages hold
the categories' own patterns, all filled with the event's own value; scores are arithmetic over id and
value. Every frame has a SQL twin for the comparison queries.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.constants import ERROR_PATTERNS
from veriscope.operators import scoring as G
from veriscope.operators.drift import drift_class
from veriscope.sources.files import read_table, spread

AS_OF = datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"

# table, key, measure, dimension of the driver's tables; every template is filled with each
SUBJECTS = (
    ("lineitem", "l_orderkey", "l_extendedprice", "l_returnflag"),
    ("lineitem", "l_partkey", "l_quantity", "l_linestatus"),
    ("lineitem", "l_suppkey", "l_discount", "l_returnflag"),
    ("lineitem", "l_orderkey", "l_tax", "l_shipdate"),
    ("orders", "o_orderkey", "o_totalprice", "o_orderpriority"),
    ("orders", "o_custkey", "o_totalprice", "o_orderstatus"),
    ("customer", "c_custkey", "c_acctbal", "c_mktsegment"),
    ("customer", "c_nationkey", "c_acctbal", "c_name"),
    ("supplier", "s_suppkey", "s_acctbal", "s_nationkey"),
    ("part", "p_partkey", "p_retailprice", "p_brand"),
    ("part", "p_partkey", "p_size", "p_type"),
)
# question, statement, reference statement (None: no reference); {n} is a number of the event
_TEMPLATES = (
    ("Top {n} {k} of {t} ordered by {m}",
     "SELECT {k}, SUM({m}) AS s FROM public.{t} GROUP BY {k} ORDER BY s DESC LIMIT {n}",
     "SELECT x.{k}, SUM(x.{m}) AS s2 FROM public.{t} x GROUP BY x.{k} ORDER BY s2 DESC LIMIT 5"),
    ("List each {d} found in {t}", "SELECT DISTINCT {d} FROM public.{t}", "SELECT DISTINCT x.{d} FROM public.{t} x"),
    ("Compare {t} with the unlisted table", "SELECT * FROM public.unlisted_table", None),
    ("Read the unlisted column of {t}", "SELECT {t}.unlisted_column FROM {t}", None),
    ("Maximum {m} in {t}?", "SELECT MAX({m}) FROM public.{t}", "SELECT MAX(x.{m}) AS most FROM public.{t} x;"),
    ("Export {t} whole", "SELECT * FROM public.{t}", None),
    ("A sample of {n} from {t}", "SELECT * FROM public.{t} LIMIT {n}", None),
    ("Total {m} per {d} for more than {n}",
     "SELECT a.{d}, SUM(a.{m}) AS s FROM public.{t} a JOIN public.{t} b ON a.{k} = b.{k} WHERE a.{m} > {n} GROUP BY a.{d} HAVING SUM(a.{m}) > {n} ORDER BY s",
     "SELECT {d}, SUM({m}) FROM {t} WHERE {m} > 40 AND {d} = 'F' GROUP BY {d} ORDER BY {d}"),
    ("Average {m} by {d}",
     "SELECT {d}, AVG({m}) FROM {t} WHERE {m} BETWEEN {n} AND 90000 GROUP BY {d}",
     "SELECT {d}, AVG({m}) FROM {t} WHERE {m} BETWEEN 10 AND 20 GROUP BY {d}"),
    ("Pair {t} with every nation", "SELECT {k}, n_name FROM {t}, nation", None),
    ("write a poem about {t}", "SELECT 'poem' AS poem", None),
    ("ok", "No statement was made for {t}", None),
    ("xyzzy {t};", "```sql\nSELECT {d} FROM {t} LIMIT 1\n```", None),
    ("Find {k} of {t} with {m} less than {n}",
     "SELECT {k} FROM {t} WHERE {m} < {n} AND {d} IN ('F','O') AND {d} LIKE '%HIGH%'",
     "SELECT {k} FROM {t} WHERE {m} < 100 AND {d} IN ('F') ORDER BY {k}"),
)


def _filled(text: str | None, subject: tuple[str, str, str, str]) -> str | None:
    for mark, name in zip(("{t}", "{k}", "{m}", "{d}"), subject, strict=True):
        text = text and text.replace(mark, name)
    return text


CORPUS = tuple(tuple(_filled(x, subject) for x in t) for subject in SUBJECTS for t in _TEMPLATES)


def _messages() -> tuple[str, ...]:
    """Messages that hold a pattern of a category each, on a table, and some that hold none."""
    out = [""]
    patterns = [p for patterns in ERROR_PATTERNS.values() for p in patterns]
    for i, p in enumerate(patterns):
        table, _, measure, _ = SUBJECTS[i % len(SUBJECTS)]
        out.append(f"[{table}] {'step {n}: ' * (i % 2)}{p.replace('.*', measure)}")
    out += [f"[{table}] step {{n}}: gave up on {measure}" for table, _, measure, _ in SUBJECTS]
    return tuple(out)


MESSAGES = _messages()


def _pick(options, n: Column) -> Column:
    texts = F.array(*[F.lit(o) for o in options])
    text = F.element_at(texts, (F.col("event_id") % len(options) + 1).cast("int"))
    return F.replace(text, F.lit("{n}"), n)


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """Telemetry log."""
    return with_standin_columns(spread(read_table(spark, folder, "events")))


def with_standin_columns(e: DataFrame) -> DataFrame:
    """Events, also of a stream's batch, as rows of the telemetry log."""
    n = F.floor("value").cast("string")
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("query_id"),
        F.col("event_type").alias("agent_type"),
        _pick([q for q, _, _ in CORPUS], n).alias("query_text"),
        F.when(~failed, _pick([s for _, s, _ in CORPUS], n)).alias("generated_sql"),
        _pick([g for _, _, g in CORPUS], n).alias("ground_truth_sql"),
        F.when(failed, _pick(MESSAGES, n)).alias("error"),
        F.when(failed, "error").otherwise("success").alias("status"),
        F.col("value").alias("execution_time_ms"),
        F.col("ts").alias("created_at"),
        "user_id",
    )


def _quote(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _sql_pick(options) -> str:
    listed = ", ".join(_quote(o) for o in options)
    return f"replace(([{listed}])[event_id % {len(options)} + 1], '{{n}}', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR))"


QUERIES_SQL = f"""queries AS (
  SELECT event_id AS query_id, event_type AS agent_type,
         {_sql_pick([q for q, _, _ in CORPUS])} AS query_text,
         CASE WHEN event_type <> 'error' THEN {_sql_pick([s for _, s, _ in CORPUS])} END AS generated_sql,
         {_sql_pick([g for _, _, g in CORPUS])} AS ground_truth_sql,
         CASE WHEN event_type = 'error' THEN {_sql_pick(MESSAGES)} END AS error,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
         value AS execution_time_ms, ts AS created_at, user_id
  FROM events)"""


def evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluations of the successful queries slower than 5 ms, with their JSON."""
    q = queries(spark, folder).filter((F.col("status") == "success") & (F.col("execution_time_ms") >= 5.0))
    scored = q.select(
        "query_id", "agent_type", "query_text", "generated_sql", "ground_truth_sql", "created_at",
        F.when(F.col("query_id") % 10 == 0, 0.0).when(F.col("query_id") % 10 == 1, 0.5)
        .otherwise(1.0).alias("structural_score"),
        ((F.col("query_id") * 37 % 101) / 100.0).alias("semantic_score"),
        F.when(F.col("query_id") % 3 == 0, 0.0).otherwise(1.0).alias("llm_score"),
        F.when(F.col("query_id") % 7 != 0, (F.col("query_id") * 53 % 101) / 100.0).alias("result_score"),
        F.when(F.col("execution_time_ms") < 20, "simple").when(F.col("execution_time_ms") < 60, "medium")
        .otherwise("complex").alias("complexity"),
    )
    final = scored.withColumn(
        "final_score",
        G.ground_truth_score(
            F.col("structural_score"), F.col("semantic_score"), F.col("llm_score"), F.col("result_score")
        ),
    ).withColumns(
        {
            "result": G.verdict(F.col("final_score")),
            "confidence": G.ground_truth_confidence(F.lit(0.5), F.col("final_score")),
            "reasoning": F.concat(F.lit("compared with reference "), F.col("complexity")),
        }
    )
    return final.withColumn(
        "evaluation_data",
        F.when(
            F.col("result_score").isNull(), F.lit('{"scores": {"structural": 1.0}, "steps": {}}')
        ).otherwise(
            F.concat(
                F.lit('{"scores": {"result_validation": '), F.col("result_score").cast("string"),
                F.lit('}, "steps": {"result_validation": {"score": '),
                F.col("result_score").cast("string"), F.lit("}}}"),
            )
        ),
    )


EVALUATIONS_SQL = """scored AS (
  SELECT query_id, agent_type, query_text, generated_sql, ground_truth_sql, created_at,
         CASE WHEN query_id % 10 = 0 THEN 0.0 WHEN query_id % 10 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS structural_score,
         (query_id * 37 % 101)::DOUBLE / 100.0::DOUBLE AS semantic_score,
         CASE WHEN query_id % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS llm_score,
         CASE WHEN query_id % 7 <> 0 THEN (query_id * 53 % 101)::DOUBLE / 100.0::DOUBLE END AS result_score,
         CASE WHEN execution_time_ms < 20 THEN 'simple' WHEN execution_time_ms < 60 THEN 'medium' ELSE 'complex' END AS complexity
  FROM queries WHERE status = 'success' AND execution_time_ms >= 5.0),
weighed AS (
  SELECT *, CASE WHEN result_score IS NULL OR result_score = 0
    THEN 0.60::DOUBLE * structural_score + 0.10::DOUBLE * semantic_score + 0.30::DOUBLE * llm_score
    ELSE 0.40::DOUBLE * structural_score + 0.15::DOUBLE * semantic_score + 0.15::DOUBLE * llm_score + 0.30::DOUBLE * result_score END AS final_score
  FROM scored),
evaluations AS (
  SELECT *, CASE WHEN final_score >= 0.60::DOUBLE THEN 'PASS' ELSE 'FAIL' END AS result,
         (0.5::DOUBLE + final_score) / 2.0::DOUBLE AS confidence,
         'compared with reference ' || complexity AS reasoning
  FROM weighed)"""


def drift(spark: SparkSession, folder: str) -> DataFrame:
    """Drift of the successful queries: the further the latency from 0, the further from the centroid."""
    q = queries(spark, folder).filter(F.col("status") == "success")
    similarity = F.greatest(F.lit(0.0), 1.0 - F.col("execution_time_ms") / 100.0)
    return q.select("query_id", "agent_type", "created_at", similarity.alias("similarity_to_baseline")).withColumns(
        {
            "drift_score": 1.0 - F.col("similarity_to_baseline"),
            "drift_classification": drift_class(F.col("similarity_to_baseline")),
            "is_anomaly": F.col("similarity_to_baseline") < 0.5,
        }
    )


DRIFT_SQL = """drift AS (
  SELECT query_id, agent_type, created_at, s AS similarity_to_baseline, 1.0::DOUBLE - s AS drift_score,
         CASE WHEN s >= 0.7::DOUBLE THEN 'normal' WHEN s >= 0.5::DOUBLE THEN 'medium' ELSE 'high' END AS drift_classification,
         s < 0.5::DOUBLE AS is_anomaly
  FROM (SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE - execution_time_ms / 100.0::DOUBLE) AS s FROM queries WHERE status = 'success'))"""


def errors(spark: SparkSession, folder: str) -> DataFrame:
    from veriscope.operators.errors import classify_errors

    failed = queries(spark, folder).filter(F.col("status") == "error")
    return classify_errors(
        failed.select("query_id", "agent_type", F.col("error").alias("error_message"), "created_at")
    ).withColumn("first_seen", F.col("created_at"))


def _category_sql(message: str) -> str:
    from veriscope.constants import ERROR_PATTERNS

    arms = " ".join(
        "WHEN regexp_matches(lower({m}), '{p}') THEN '{c}'".format(
            m=message, p="|".join(f"({x})" for x in patterns), c=category
        )
        for category, patterns in ERROR_PATTERNS.items()
    )
    return f"CASE WHEN {message} IS NULL OR {message} = '' THEN 'UNKNOWN' {arms} ELSE 'DEFAULT' END"


def _errors_sql() -> str:
    from veriscope.constants import ERROR_ADVICE, ERROR_SEVERITY

    severity = " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in ERROR_SEVERITY.items())
    advice = " ".join(f"WHEN '{c}' THEN {_quote(a)}" for c, a in ERROR_ADVICE.items())
    return f"""errors AS (
  SELECT query_id, agent_type, error_message, created_at, created_at AS first_seen,
         CASE c WHEN 'DEFAULT' THEN 'AGENT_LOGIC' ELSE c END AS error_category,
         CASE c {severity} ELSE 'low' END AS severity,
         CASE (CASE c WHEN 'DEFAULT' THEN 'AGENT_LOGIC' ELSE c END) {advice} END AS suggested_fix
  FROM (SELECT query_id, agent_type, error AS error_message, created_at, {_category_sql('error')} AS c
        FROM queries WHERE status = 'error'))"""


ERRORS_SQL = _errors_sql()


def agents(spark: SparkSession, folder: str) -> DataFrame:
    """Registry with an agent per event type; addresses and states follow from its figures."""
    e = read_table(spark, folder, "events").groupBy("event_type").agg(
        F.min("event_id").alias("agent_id"), F.min("ts").alias("created_at")
    )
    name = F.col("event_type")
    return e.select(
        "agent_id", name.alias("agent_name"), F.concat(F.initcap(name), F.lit(" GPT")).alias("display_name"),
        "created_at",
        F.lit("active").alias("status"),
        F.when(name != "view", F.concat(F.lit("http://"), name)).alias("agent_url"),
        name.isin("click", "error").alias("is_up"),
        F.when(name == "view", "unknown").when(name == "error", "unhealthy").otherwise("healthy")
        .alias("health_status"),
    )


AGENTS_SQL = """agents AS (
  SELECT min(event_id) AS agent_id, event_type AS agent_name,
         upper(event_type[1]) || event_type[2:] || ' GPT' AS display_name, min(ts) AS created_at,
         'active' AS status,
         CASE WHEN event_type <> 'view' THEN 'http://' || event_type END AS agent_url,
         event_type IN ('click', 'error') AS is_up,
         CASE event_type WHEN 'view' THEN 'unknown' WHEN 'error' THEN 'unhealthy' ELSE 'healthy' END AS health_status
  FROM events GROUP BY event_type)"""

_PARTS = {
    "queries": QUERIES_SQL,
    "evaluations": EVALUATIONS_SQL,
    "drift": DRIFT_SQL,
    "errors": ERRORS_SQL,
    "agents": AGENTS_SQL,
}
_NEEDS_QUERIES = ("evaluations", "drift", "errors")


def with_tables(body: str, *names: str, extra: str = "") -> str:
    """SELECT text with the named stand-in tables in front."""
    wanted = list(names)
    if any(n in _NEEDS_QUERIES for n in wanted) and "queries" not in wanted:
        wanted.insert(0, "queries")
    ordered = [n for n in _PARTS if n in wanted]
    parts = [_PARTS[n] for n in ordered] + ([extra] if extra else [])
    return "WITH " + ",\n".join(parts) + "\n" + body
