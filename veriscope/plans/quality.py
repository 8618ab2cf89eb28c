"""Data-quality and schema queries over the driver tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from veriscope.functions import psi as P
from veriscope.operators import catalog as C
from veriscope.operators import quality as Q
from veriscope.operators import reports as R
from veriscope.operators.relationships import declared_and_checked, relationships
from veriscope.operators.scoring import column_roles
from veriscope.plans.registry import query
from veriscope.sources.files import folder_tables, read_table, read_tables

_AT = datetime(2024, 1, 31)
# columns of the tables and their catalog types, for the SQL alone; queries take tables and columns from the folder
COLUMNS = {
    "region": {"r_regionkey": "integer", "r_name": "text"},
    "nation": {"n_nationkey": "integer", "n_name": "text", "n_regionkey": "integer"},
    "customer": {"c_custkey": "bigint", "c_name": "text", "c_nationkey": "integer", "c_acctbal": "double precision", "c_mktsegment": "text"},
    "supplier": {"s_suppkey": "bigint", "s_name": "text", "s_nationkey": "integer", "s_acctbal": "double precision"},
    "part": {"p_partkey": "bigint", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "integer", "p_retailprice": "double precision"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "text", "o_totalprice": "double precision", "o_orderdate": "timestamp",
               "o_orderpriority": "text"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "integer", "l_quantity": "double precision",
                 "l_extendedprice": "double precision", "l_discount": "double precision", "l_tax": "double precision", "l_returnflag": "text",
                 "l_linestatus": "text", "l_shipdate": "timestamp"},
    "events": {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "text", "value": "double precision", "props": "text"},
    "documents": {"doc_id": "bigint", "text": "text", "lang": "text", "source": "text", "n_chars": "bigint"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "integer"},
    "pages": {"page_id": "bigint", "url": "text", "html": "text"},
    "benchmark": {"item_id": "bigint", "text": "text"},
    "labels": {"doc_id": "bigint", "quality": "integer", "toxic": "integer"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "text", "text": "text"},
}
_TABLES = sorted(COLUMNS)
# declared keys
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"],
    "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "events": ["event_id"], "documents": ["doc_id"],
    "labels": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"],
}


def _all_tables(spark, d):
    return read_tables(spark, d, folder_tables(spark, d))


def _of_all(spark, d, part):
    """`part(name, table)` of every table of the folder, in one frame."""
    out = None
    for name, table in _all_tables(spark, d).items():
        found = part(name, table)
        out = found if out is None else out.unionByName(found)
    return out


def _sparse_events(spark, d):
    """Events with values missing in some columns."""
    e = read_table(spark, d, "events")
    return e.select(
        "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"),
        F.when(F.col("value") > 20, F.col("value")).alias("value"),
        F.when(F.col("value") > 1000, F.col("props")).alias("props"), "ts",
    )


_SPARSE_SQL = """sparse AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
  CASE WHEN value > 20 THEN value END AS value, CASE WHEN value > 1000 THEN props END AS props, ts FROM events)"""


def _nulls_sql(columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count, "
        f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS percentage FROM sparse" for c in columns)


@query("D1_key_checks", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS total_rows, count(DISTINCT ({', '.join(k)})) AS distinct_keys, "
    f"count(*) = count(DISTINCT ({', '.join(k)})) AS is_key FROM {t}" for t, k in KEYS.items()))
def key_checks(spark, d):
    return _of_all(spark, d, lambda t, df: Q.key_check(df, KEYS[t]).select(
        F.lit(t).alias("table_name"), "total_rows", "distinct_keys", "is_key"))


@query("D2_null_shares", f"WITH {_SPARSE_SQL} {_nulls_sql(['event_id', 'event_type', 'value', 'props', 'ts'])}")
def null_shares(spark, d):
    return Q.null_shares(_sparse_events(spark, d))


@query("D3_null_or_missing_fields", """
SELECT field AS column_name, count(*) AS total_rows, count(*) - count(v) AS null_count, round((count(*) - count(v)) * 100.0::DOUBLE / count(*), 2) AS percentage
FROM (SELECT 'k' AS field, json_extract_string(props, '$.k') AS v FROM events
      UNION ALL SELECT 'z', CASE WHEN event_type = 'click' THEN event_id::VARCHAR END FROM events) GROUP BY 1""")
def missing_fields(spark, d):
    e = read_table(spark, d, "events")
    doc = F.when(
        F.col("event_type") == "click",
        F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "z": '), F.col("event_id").cast("string"), F.lit("}")),
    ).otherwise(F.col("props"))
    parsed = e.select(F.from_json(doc, "k int, z long").alias("j")).select("j.*")
    return Q.null_shares(parsed)


@query("D4_duplicate_groups", """
SELECT 'lineitem' AS table_name, count(*) FILTER (WHERE n > 1) AS duplicate_groups, sum(n)::BIGINT AS total_rows FROM
  (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
UNION ALL SELECT 'order lines', count(*) FILTER (WHERE n > 1), sum(n)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
UNION ALL SELECT 'documents', count(*) FILTER (WHERE n > 1), sum(n)::BIGINT FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars)""")
def duplicates(spark, d):
    li = read_table(spark, d, "lineitem")
    docs = read_table(spark, d, "documents").withColumnRenamed("doc_id", "_id")
    parts = {
        "lineitem": Q.duplicate_groups(li),
        "order lines": Q.duplicate_groups(li, ["l_orderkey", "l_linenumber"]),
        "documents": Q.document_duplicates(docs),
    }
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("table_name"), "duplicate_groups", "total_rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("D5_table_sizes", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _TABLES))
def sizes(spark, d):
    return _of_all(spark, d, lambda t, df: Q.table_size(df).select(F.lit(t).alias("table_name"), "row_count"))


@query("D6_large_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, 'large_table_no_index' AS issue_type, count(*) AS affected_rows FROM {t} HAVING count(*) > 9999" for t in _TABLES))
def large_tables(spark, d):
    return _of_all(spark, d, lambda t, df: Q.large_table_issues(df, "public", t, limit=9999).select("table_name", "issue_type", "affected_rows"))


def _report(spark, d):
    """Issues of every table of the folder, and of events with values missing."""
    return Q.issue_report({**_all_tables(spark, d), "sparse": _sparse_events(spark, d)}, {**KEYS, "sparse": ["event_id"]})


_SPARSE_COLUMNS = ("event_id", "event_type", "value", "props", "ts")
_SIZES_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS t, count(*) AS n, count(*) <> count(DISTINCT ({', '.join(k)})) OR count(*) FILTER (WHERE {' OR '.join(f'{c} IS NULL' for c in k)}) > 0 AS no_key, "
    f"(SELECT count(*) FROM (SELECT *, count(*) AS many FROM {t} GROUP BY ALL HAVING count(*) > 1)) AS again FROM {t}"
    for t, k in {**KEYS, "sparse": ["event_id"]}.items())
_SHARES_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS percentage FROM {t}"
    for t, columns in {**COLUMNS, "sparse": _SPARSE_COLUMNS}.items() for c in columns)
_ISSUES_SQL = f"""WITH {_SPARSE_SQL},
sizes AS ({_SIZES_SQL}),
shares AS ({_SHARES_SQL}),
issues AS (
SELECT t AS table_name, NULL AS column_name, 'missing_primary_key' AS issue_type, 'warning' AS severity,
  'Table public.' || t || ' has no primary key' AS message, NULL::BIGINT AS affected_rows, NULL::DOUBLE AS percentage FROM sizes WHERE no_key
UNION ALL SELECT t, c, 'high_null_percentage', 'warning', 'Column ' || chr(39) || c || chr(39) || ' has ' || printf('%.1f', percentage) || '% NULL values', nulls, percentage
  FROM shares WHERE percentage > 20
UNION ALL SELECT t, NULL, 'duplicate_rows', 'info', again || ' duplicate row groups found', again, NULL FROM sizes WHERE again > 0
UNION ALL SELECT t, NULL, 'large_table_no_index', 'warning', 'Large table (' || format('{{:,}}', n) || ' rows) with no indexes', n, NULL FROM sizes WHERE n > 100000)"""


@query("D7_issue_report", f"{_ISSUES_SQL} SELECT * FROM issues")
def issue_report(spark, d):
    return _report(spark, d).select("table_name", "column_name", "issue_type", "severity", "message", "affected_rows", "percentage")


@query("A23_issue_counts", f"{_ISSUES_SQL} SELECT count(*) AS total, 0::BIGINT AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM issues")
def issue_counts(spark, d):
    return R.issues_by_severity(_report(spark, d))


@query("K6_issues_by_severity", f"{_ISSUES_SQL} SELECT issue_type, column_name, CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS place FROM issues")
def ordered_issues(spark, d):
    place = R.severity_rank(F.col("severity"))
    return _report(spark, d).select("issue_type", "column_name", place.alias("place")).orderBy("place", "issue_type", "column_name")


# --- catalog --------------------------------------------------------------
def _with_counts(spark, d, catalog):
    """Catalog rows with the number of filled values of their column."""
    filled = _of_all(spark, d, lambda t, df: Q.null_shares(df).select(
        F.lit(t).alias("table_name"), "column_name", (F.col("total_rows") - F.col("null_count")).alias("filled")))
    return catalog.join(filled, ["table_name", "column_name"])


_CATALOG_SQL = "catalog AS (" + " UNION ALL ".join(
    f"SELECT 'public' AS schema_name, '{t}' AS table_name, '{c}' AS column_name, '{k}' AS data_type, count({c}) AS filled FROM {t}"
    for t, columns in COLUMNS.items() for c, k in columns.items()) + ")"


def _catalog(spark, d):
    return C.catalog_rows(spark, _all_tables(spark, d))


@query("R1_catalog", f"WITH {_CATALOG_SQL} SELECT * FROM catalog")
def catalog(spark, d):
    return _with_counts(spark, d, _catalog(spark, d)).select("schema_name", "table_name", "column_name", "data_type", "filled")


@query("R2_json_fields", """
SELECT 'k' AS field, 'int' AS data_type, count(*) AS documents, 0::BIGINT AS nulls FROM events
UNION ALL SELECT 'v', 'float|str', count(*), count(*) FILTER (WHERE event_type = 'view') FROM events""")
def json_fields(spark, d):
    e = read_table(spark, d, "events")
    v = F.when(F.col("event_type") == "view", "null").when(F.col("event_type") == "click", '"many"').otherwise("1.5")
    doc = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "v": '), v, F.lit("}"))
    return C.json_fields(e.select(doc.alias("doc")), "doc")


@query("R3_relationship_containment", """
SELECT 'lineitem.l_orderkey' AS child, count(*) AS child_values, count(*) FILTER (WHERE o_orderkey IS NULL) AS missing, count(*) FILTER (WHERE o_orderkey IS NULL) = 0 AS contained
  FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT 'orders.o_custkey', count(*), count(*) FILTER (WHERE c_custkey IS NULL), count(*) FILTER (WHERE c_custkey IS NULL) = 0
  FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'documents.doc_id', count(*), count(*) FILTER (WHERE l IS NULL), count(*) FILTER (WHERE l IS NULL) = 0
  FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id AS l FROM labels) ON l = d.doc_id""")
def relationship_containment(spark, d):
    checks = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"),
              ("documents", "doc_id", "labels", "doc_id")]
    out = None
    for child, c, parent, p in checks:
        part = C.containment(read_table(spark, d, child), c, read_table(spark, d, parent), p).select(
            F.lit(f"{child}.{c}").alias("child"), "child_values", "missing", "contained")
        out = part if out is None else out.unionByName(part)
    return out


@query("R3_inferred_relationships", " UNION ALL ".join(
    f"SELECT '{t}' AS source_table, '{c}' AS source_column, '{c[:-3]}s' AS target_table, '_id' AS target_column, count({c}) AS filled FROM {t}"
    for t, columns in COLUMNS.items() for c in columns if c.endswith("_id") and c != "_id"))
def inferred(spark, d):
    found = C.inferred_relationships(_catalog(spark, d))
    counted = _with_counts(spark, d, found.select(F.col("source_table").alias("table_name"), F.col("source_column").alias("column_name"), "target_table", "target_column"))
    return counted.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), "target_table", "target_column", "filled")


_KINDS_SQL = {"integer": "integer", "bigint": "integer", "text": "text", "double precision": "number", "timestamp": "time"}
_CELLS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, '{_KINDS_SQL[k]}' AS kind, {c}::VARCHAR AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"
    for t, columns in COLUMNS.items() for c, k in columns.items() if k in _KINDS_SQL)
_STEM_SQL = "CASE WHEN strpos({0}, '_') BETWEEN 1 AND 3 AND length({0}) > strpos({0}, '_') THEN substr({0}, strpos({0}, '_') + 1) ELSE {0} END"


@query("R3_all_relationships", f"""
WITH cell AS MATERIALIZED ({_CELLS_SQL}),
col AS (SELECT t, c, kind, count(*) AS vals, max(n) = 1 AS is_key, {_STEM_SQL.format("c")} AS stem FROM cell GROUP BY t, c, kind),
met AS (SELECT a.t, a.c, b.t AS target, b.c AS key, count(*) AS n FROM cell a JOIN cell b ON a.kind = b.kind AND a.v = b.v AND a.t <> b.t GROUP BY ALL),
pair AS (SELECT a.t, a.c, b.t AS target, b.c AS key, a.stem = b.stem AS by_name, a.vals, a.vals - coalesce(m.n, 0) AS missing
  FROM col a JOIN col b ON a.kind = b.kind AND a.t <> b.t AND b.is_key
  LEFT JOIN met m ON m.t = a.t AND m.c = a.c AND m.target = b.t AND m.key = b.c)
SELECT 'public' AS source_schema, t AS source_table, c AS source_column, 'public' AS target_schema, target AS target_table, key AS target_column,
  CASE WHEN by_name THEN 'inferred' ELSE 'contained' END AS relationship_type, NULL::VARCHAR AS constraint_name, by_name, vals AS "values", missing, missing = 0 AS contained
FROM pair WHERE by_name OR missing = 0
UNION ALL SELECT 'public', t, c, 'public', substr(c, 1, length(c) - 3) || 's', '_id', 'inferred', NULL, true, NULL, NULL, false
FROM (SELECT DISTINCT t, c FROM cell) WHERE c LIKE '%\\_id' ESCAPE '\\' AND c <> '_id'""")
def all_relationships(spark, d):
    """Relationships over every column of every table of the folder."""
    return relationships(spark, read_tables(spark, d, folder_tables(spark, d)))


# foreign keys as a catalog would declare them; the last ones do not hold or name a column that is not there
_FOREIGN_KEYS = (
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey"),
    ("documents", "doc_id", "labels", "doc_id"), ("pages", "host_id", "hosts", "host_id"),
)


@query("R4_declared_relationships", " UNION ALL ".join(
    f"SELECT 'public' AS source_schema, '{t}' AS source_table, '{c}' AS source_column, 'public' AS target_schema, '{u}' AS target_table, '{k}' AS target_column, "
    f"'foreign_key' AS relationship_type, 'fk_{t}_{c}' AS constraint_name, "
    + (f"count(DISTINCT {c}) AS child_values, count(DISTINCT {c}) FILTER (WHERE {c} NOT IN (SELECT {k} FROM {u} WHERE {k} IS NOT NULL)) AS missing FROM {t}"
       if u in COLUMNS else "NULL::BIGINT AS child_values, NULL::BIGINT AS missing") for t, c, u, k in _FOREIGN_KEYS))
def declared(spark, d):
    """Declared foreign keys, checked against every table of the folder."""
    rows = [("public", t, c, "public", u, k, f"fk_{t}_{c}") for t, c, u, k in _FOREIGN_KEYS]
    names = "source_schema string, source_table string, source_column string, target_schema string, target_table string, target_column string, constraint_name string"
    checked = declared_and_checked(spark, _all_tables(spark, d), spark.createDataFrame(rows, names))
    return checked.withColumnRenamed("values", "child_values").drop("by_name", "contained")


def _versions(spark, d):
    """Catalogs per agent before and after: each event type and property is a column of its user's schema."""
    e = read_table(spark, d, "events")
    def rows(df):
        return df.select(
            F.col("user_id").alias("agent_id"), F.lit("public").alias("schema_name"), F.col("event_type").alias("table_name"),
            F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("column_name"), F.lit("bigint").alias("data_type"),
            F.lit(True).alias("is_nullable")).distinct()
    half = F.lit(datetime(2024, 1, 16)).cast("timestamp_ntz")
    return rows(e), rows(e.filter(F.col("ts") < half)), rows(e.filter(F.col("ts") >= half))


_VERSIONS_SQL = """v AS (SELECT DISTINCT user_id AS agent_id, event_type AS table_name, 'k' || json_extract_string(props, '$.k') AS column_name, ts < TIMESTAMP '2024-01-16' AS early FROM events),
stored AS (SELECT DISTINCT agent_id, table_name, column_name FROM v WHERE early),
recent AS (SELECT DISTINCT agent_id, table_name, column_name FROM v WHERE NOT early),
added AS (SELECT * FROM recent EXCEPT SELECT * FROM stored),
removed AS (SELECT * FROM stored EXCEPT SELECT * FROM recent),
added_tables AS (SELECT DISTINCT agent_id, table_name FROM recent EXCEPT SELECT DISTINCT agent_id, table_name FROM stored)"""


@query("R5_schema_changes", f"""WITH {_VERSIONS_SQL}
SELECT agent_id, 'column_added' AS change_type, table_name, column_name FROM added
UNION ALL SELECT agent_id, 'table_added', table_name, NULL FROM added_tables
UNION ALL SELECT agent_id, 'column_removed', table_name, column_name FROM removed""")
def schema_changes(spark, d):
    _, stored, current = _versions(spark, d)
    return C.schema_changes(current, stored, include_removed=True, include_types=True).select(
        "agent_id", "change_type", "table_name", "column_name")


@query("U1_catalog_difference", f"WITH {_VERSIONS_SQL} SELECT agent_id, count(*) AS new_columns FROM added GROUP BY 1")
def difference(spark, d):
    _, stored, current = _versions(spark, d)
    return C.catalog_difference(current, stored).groupBy("agent_id").agg(F.count("*").alias("new_columns"))


@query("R6_change_log", f"""WITH {_VERSIONS_SQL},
log AS (SELECT agent_id, 'column_added' AS change_type FROM added UNION ALL SELECT agent_id, 'table_added' FROM added_tables)
SELECT agent_id, change_type, TIMESTAMP '2024-01-31' AS detected_at, agent_id < 50 AS gt_generated, CASE WHEN agent_id < 50 THEN 7 ELSE 0 END::BIGINT AS gt_query_count, count(*) AS n
FROM log GROUP BY ALL""")
def change_log(spark, d):
    _, stored, current = _versions(spark, d)
    log = C.change_log(C.schema_changes(current, stored), _AT)
    generated = current.filter(F.col("agent_id") < 50).select("agent_id").distinct().withColumn("query_count", F.lit(7).cast("long"))
    marked = C.mark_generated(log, generated)
    return marked.groupBy("agent_id", "change_type", "detected_at", "gt_generated", "gt_query_count").agg(F.count("*").alias("n"))


def _agents(spark, d):
    return read_table(spark, d, "events").groupBy(F.col("user_id").alias("agent_id")).agg(
        F.lit(1).alias("schema_version"), F.lit(0).cast("long").alias("schema_change_count"), F.lit(0).cast("long").alias("gt_query_count"),
        F.lit(None).cast("timestamp_ntz").alias("last_schema_scan_at"))


@query("R7_version_roll", f"""WITH {_VERSIONS_SQL},
c AS (SELECT agent_id, count(*) AS n FROM (SELECT agent_id FROM added UNION ALL SELECT agent_id FROM added_tables) GROUP BY 1)
SELECT a.agent_id AS agent_id, CASE WHEN n > 0 THEN 2 ELSE 1 END::INTEGER AS schema_version, coalesce(n, 0) AS schema_change_count, TIMESTAMP '2024-01-31' AS last_schema_scan_at
FROM (SELECT DISTINCT user_id AS agent_id FROM events) a LEFT JOIN c USING (agent_id)""")
def version_roll(spark, d):
    _, stored, current = _versions(spark, d)
    return C.roll_versions(_agents(spark, d), C.schema_changes(current, stored), _AT).drop("gt_query_count")


@query("R12_schema_scan", f"""WITH {_VERSIONS_SQL}
SELECT agent_id, count(*) AS catalog_columns, (SELECT count(*) FROM added x WHERE x.agent_id = u.agent_id) AS new_columns
FROM (SELECT * FROM stored UNION SELECT * FROM recent) u GROUP BY agent_id""")
def schema_scan(spark, d):
    _, stored, current = _versions(spark, d)
    out = C.scan(_agents(spark, d), stored, current, _AT)
    catalog_size = out["catalog"].groupBy("agent_id").agg(F.count("*").alias("catalog_columns"))
    new = out["log"].filter(F.col("change_type") == "column_added").groupBy("agent_id").agg(F.count("*").alias("new_columns"))
    return catalog_size.join(new, ["agent_id"], "left").na.fill(0, ["new_columns"])


@query("S22_append_new_catalog_rows", f"WITH {_VERSIONS_SQL} SELECT table_name, count(*) AS n FROM (SELECT * FROM stored UNION SELECT * FROM recent) GROUP BY 1")
def append_new(spark, d):
    _, stored, current = _versions(spark, d)
    return C.append_new(stored, current).groupBy("table_name").agg(F.count("*").alias("n"))


@query("K7_change_history", f"""WITH {_VERSIONS_SQL}
SELECT * FROM (SELECT 'column_added' AS change_type, table_name, column_name FROM added WHERE agent_id = 7
UNION ALL SELECT 'table_added', table_name, NULL FROM added_tables WHERE agent_id = 7) ORDER BY change_type, table_name, column_name LIMIT 50""")
def history(spark, d):
    _, stored, current = _versions(spark, d)
    log = C.change_log(C.schema_changes(current, stored), _AT)
    return C.change_history(log, 7).select("change_type", "table_name", "column_name")


@query("R8_nested_catalog", f"WITH {_CATALOG_SQL} SELECT table_name, string_agg(column_name || ' ' || data_type, ', ' ORDER BY column_name) AS columns, sum(filled)::BIGINT AS filled FROM catalog GROUP BY 1")
def nested(spark, d):
    nested_rows = C.nested_catalog(_catalog(spark, d))
    flat = C.flat_catalog(nested_rows)
    filled = _with_counts(spark, d, flat).groupBy("table_name").agg(F.sum("filled").alias("filled"))
    listed = F.concat_ws(", ", F.transform("columns", lambda c: F.concat_ws(" ", c["column_name"], c["data_type"])))
    return nested_rows.select("table_name", listed.alias("columns")).join(filled, ["table_name"])


@query("R9_unqualified_names", """
WITH t AS (SELECT lang AS schema_name, source AS table_name, count(*) AS n FROM documents GROUP BY ALL),
single AS (SELECT table_name FROM t GROUP BY 1 HAVING count(DISTINCT schema_name) = 1)
SELECT schema_name || '.' || table_name AS lookup_name, n FROM t UNION ALL SELECT table_name, n FROM t WHERE table_name IN (SELECT table_name FROM single)""")
def unqualified(spark, d):
    t = read_table(spark, d, "documents").groupBy(F.col("lang").alias("schema_name"), F.col("source").alias("table_name")).agg(F.count("*").alias("n"))
    return C.with_unqualified_names(t).select("lookup_name", "n")


@query("R10_column_roles", f"WITH {_CATALOG_SQL} SELECT table_name, column_name, CASE WHEN data_type = 'text' THEN 'dimension' WHEN data_type IN ('integer', 'bigint', 'double precision') THEN 'measure' END AS column_role, filled FROM catalog")
def roles(spark, d):
    return _with_counts(spark, d, column_roles(_catalog(spark, d))).select("table_name", "column_name", "column_role", "filled")


_VALUES_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT '{t}' AS table_name, '{c}' AS column_name, {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL"
    for t, columns in COLUMNS.items() for c, k in columns.items() if not k.startswith("array"))


@query("R11_value_profile", f"""
WITH u AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY v) AS p FROM ({_VALUES_SQL}))
SELECT table_name, column_name, max(p)::INTEGER AS distinct_values, string_agg(v, ', ' ORDER BY v) FILTER (WHERE p <= 5) AS sample_values
FROM u GROUP BY ALL HAVING max(p) BETWEEN 2 AND 10""")
def profile(spark, d):
    """Columns of every table that hold few values."""
    return _of_all(spark, d, lambda t, df: C.value_profile(df).withColumn("table_name", F.lit(t)))


@query("A17_key_columns_text", """
SELECT c_nationkey, string_agg(c_mktsegment, ', ' ORDER BY n, c_mktsegment) AS columns
FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1""")
def key_text(spark, d):
    segments = read_table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return C.key_columns_text(segments, ["c_nationkey"], "n", "c_mktsegment")


@query("J10_constraint_join", """
SELECT a.event_type AS table_name, a.k AS column_name, a.n AS columns_used, b.n AS columns_declared FROM
  (SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE value > 30 GROUP BY ALL) a
  JOIN (SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE value <= 30 GROUP BY ALL) b USING (event_type, k)""")
def constraint_join(spark, d):
    e = read_table(spark, d, "events").withColumn("column_name", F.get_json_object("props", "$.k")).withColumnRenamed("event_type", "table_name")
    key = ["table_name", "column_name"]
    used = e.filter(F.col("value") > 30).groupBy(*key).agg(F.count("*").alias("columns_used"))
    declared_rows = e.filter(F.col("value") <= 30).groupBy(*key).agg(F.count("*").alias("columns_declared"))
    return C.constraint_join(used, declared_rows, key)


@query("F8_metric_columns", """
SELECT source AS column_name, count(*) AS n, true AS is_metric FROM documents GROUP BY 1
UNION ALL SELECT source || '_id', count(*), false FROM documents GROUP BY 1
UNION ALL SELECT 'Status ', count(*), false FROM documents""")
def metric_columns(spark, d):
    docs = read_table(spark, d, "documents")
    names = F.explode(F.array("source", F.concat("source", F.lit("_id")), F.lit("Status ")))
    counted = docs.select(names.alias("column_name")).groupBy("column_name").agg(F.count("*").alias("n"))
    return counted.withColumn("is_metric", P.is_metric_column(F.col("column_name")))


@query("F9_numeric_types", f"WITH {_CATALOG_SQL} SELECT data_type, regexp_matches(data_type, 'int|double|float') AS is_numeric, sum(filled)::BIGINT AS filled FROM catalog GROUP BY ALL")
def numeric_types(spark, d):
    counted = _with_counts(spark, d, _catalog(spark, d)).groupBy("data_type").agg(F.sum("filled").alias("filled"))
    return counted.withColumn("is_numeric", C.numeric_by_type_text(F.col("data_type")))
