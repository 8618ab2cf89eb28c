"""SQL-text scoring and evaluation queries over the stand-in telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriscope import constants as K
from veriscope.functions import intents as I
from veriscope.functions import sql_shape as S
from veriscope.functions import text as X
from veriscope.operators import catalog as C
from veriscope.operators import scoring as G
from veriscope.plans import standin as T
from veriscope.plans.registry import query
from veriscope.plans.standin import with_tables
from veriscope.sources.files import read_table, read_tables

_TABLES = ["orders", "lineitem", "customer", "part", "supplier", "nation", "region"]
# numeric and text columns of orders and lineitem
_MEASURES = ["l_discount", "l_extendedprice", "l_linenumber", "l_orderkey", "l_partkey", "l_quantity",
             "l_suppkey", "l_tax", "o_custkey", "o_orderkey", "o_totalprice"]
_DIMENSIONS = ["l_linestatus", "l_returnflag", "o_orderpriority", "o_orderstatus"]


def _r(name: str, digits: int = 8):
    return F.round(name, digits).alias(name)


def _live(spark, d):
    """Queries with SQL, cleaned of code fences."""
    q = T.queries(spark, d).filter(F.col("generated_sql").isNotNull())
    return q.withColumn("cleaned_sql", X.clean_sql(F.col("generated_sql")))


def _catalog(spark, d):
    return C.catalog_rows(spark, read_tables(spark, d, _TABLES))


# --- SQL twins ------------------------------------------------------------
def _has(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def _rx(text: str, pattern: str) -> str:
    return "regexp_matches({}, '{}')".format(text, pattern.replace("'", "''"))


def _any(text: str, patterns) -> str:
    return "(" + " OR ".join(_rx(text, p) for p in patterns) + ")"


_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x=x)


_CLEAN_SQL = f"""live AS (
  SELECT *, CASE WHEN contains(generated_sql, '```') THEN
     {_strip("replace(CASE WHEN len(string_split(generated_sql, '```')) >= 3 THEN string_split(" + _strip('generated_sql') + ", '```')[2] ELSE " + _strip('generated_sql') + " END, 'sql', '')")}
     ELSE {_strip('generated_sql')} END AS cleaned_sql
  FROM queries WHERE generated_sql IS NOT NULL)"""


def _intents_sql(q: str) -> dict[str, str]:
    m, dim = "|".join(_MEASURES), "|".join(_DIMENSIONS)
    rules: dict[str, list[str]] = {i: [] for i in I.INTENTS}
    for pattern, intent in I.PHRASES:
        rules[intent].append(_rx(q, pattern.replace("{M}", m).replace("{D}", dim)))
    compares = _any(q, I.COMPARISON_PATTERNS)
    rules["filtering"] += [compares, _any(q, I.TEXT_SEARCH_PATTERNS)]
    rules["grouping"] += [_has(q, I.GROUP_PHRASES), _rx(q, rf"(^|\s)({m})\s+(per|by)\s+({dim})(\s|$)")]
    near = " OR ".join(
        f"(strpos({q}, '{x}') > 0 AND "
        + _has(f"substring({q}, greatest(strpos({q}, '{x}') - 30, 1), strpos({q}, '{x}') - greatest(strpos({q}, '{x}') - 30, 1))",
               I.AGGREGATE_WORDS) + ")"
        for x in _MEASURES
    )
    base = f"(({near}) AND NOT {compares}"
    s, a, x, n = (_has(q, w) for w in (I.SUM_WORDS, I.MEAN_WORDS, I.MAX_WORDS, I.MIN_WORDS))
    rules["summation"].append(f"{base} AND {s})")
    rules["aggregation"].append(f"{base} AND {a} AND NOT {s})")
    rules["maximization"].append(f"{base} AND {x} AND NOT {s} AND NOT {a})")
    rules["minimization"].append(f"{base} AND {n} AND NOT {s} AND NOT {a} AND NOT {x})")
    rules["sorting"].append(_has(q, I.SORT_WORDS))
    rules["limiting"].append(_rx(q, r"\b(top|first|limit)\s+\d+"))
    return {i: "(" + " OR ".join(r) + ")" for i, r in rules.items()}


def _performed_sql(u: str) -> dict[str, str]:
    ordered = f"contains({u}, 'ORDER BY')"
    desc = f"contains({u}, 'DESC')"
    return {
        "filtering": f"contains({u}, 'WHERE')",
        "summation": _rx(u, r"\b(SUM|COUNT)\s*\("),
        "aggregation": _rx(u, r"\bAVG\s*\("),
        "grouping": f"contains({u}, 'GROUP BY')",
        "maximization": f"({_rx(u, chr(92) + 'bMAX' + chr(92) + 's*' + chr(92) + '(')} OR ({ordered} AND {desc}))",
        "minimization": f"({_rx(u, chr(92) + 'bMIN' + chr(92) + 's*' + chr(92) + '(')} OR ({ordered} AND NOT {desc}))",
        "limiting": _rx(u, r"\bLIMIT\s+\d+"),
        "sorting": ordered,
    }


def _list_sql(flags: dict[str, str]) -> str:
    items = ", ".join(f"CASE WHEN {flags[i]} THEN '{i}' END" for i in I.INTENTS)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


_INTENT_SQL = f"""asked AS (SELECT *, {_list_sql(_intents_sql('lower(query_text)'))} AS requested_intents,
  {_list_sql(_performed_sql('upper(cleaned_sql)'))} AS performed_intents, upper(cleaned_sql) AS u FROM live),
tallied AS (SELECT *, len(requested_intents) AS want, len(list_intersect(requested_intents, performed_intents)) AS hit FROM asked),
intent AS (SELECT *, CASE WHEN want = 0 THEN
    CASE WHEN NOT contains(u, 'GROUP BY') AND NOT {_rx('u', r'\b(SUM|COUNT|AVG|MAX|MIN)\s*\(')} THEN 1.0 ELSE 0.8 END
  ELSE greatest(0.0, least(1.0, hit::DOUBLE / want + CASE WHEN hit >= 3 THEN 0.1 WHEN hit = 2 THEN 0.05 ELSE 0.0 END
    + CASE WHEN contains(u, 'SELECT *') THEN 0.0 ELSE 0.03 END + CASE WHEN contains(u, ' AS ') THEN 0.02 ELSE 0.0 END
    - (want - hit) * 0.2 - (len(performed_intents) - hit) * 0.05)) END::DOUBLE AS intent_score
  FROM tallied)"""

_AGG = "(contains(u, 'SUM(') OR contains(u, 'AVG(') OR contains(u, 'COUNT(') OR contains(u, 'MAX(') OR contains(u, 'MIN('))"
_STAR = _rx("u", r"SELECT\s+\*")
_PATTERN_SQL = f"""pattern AS (SELECT *, greatest(0.0, least(1.0, 0.75
  + CASE WHEN contains(u, 'SELECT') AND NOT {_STAR} THEN 0.05 ELSE 0 END
  + CASE WHEN {_rx('u', r'\bAS\s+\w+')} THEN 0.04 ELSE 0 END + CASE WHEN contains(u, 'JOIN') THEN 0.05 ELSE 0 END
  + CASE WHEN contains(u, 'WHERE') THEN 0.04 ELSE 0 END
  + CASE WHEN contains(u, 'GROUP BY') AND {_AGG} THEN 0.04 ELSE 0 END
  + CASE WHEN contains(u, 'ORDER BY') THEN 0.03 ELSE 0 END + CASE WHEN contains(u, 'LIMIT') THEN 0.02 ELSE 0 END
  + CASE WHEN len(string_split(u, 'SELECT')) > 2 THEN 0.02 ELSE 0 END + CASE WHEN contains(u, 'HAVING') THEN 0.02 ELSE 0 END
  - CASE WHEN contains(u, 'SELECT *') AND {_AGG} AND NOT contains(u, 'GROUP BY') THEN 0.3 ELSE 0 END
  - CASE WHEN contains(u, 'LIMIT') AND NOT contains(u, 'ORDER BY') THEN 0.15 ELSE 0 END
  - CASE WHEN {_STAR} AND NOT contains(u, 'LIMIT') AND NOT contains(u, 'WHERE') THEN 0.1 ELSE 0 END
  - CASE WHEN contains(string_split(string_split(string_split(u, 'FROM')[2], 'WHERE')[1], 'GROUP')[1], ',')
      AND NOT contains(u, 'JOIN') AND NOT contains(u, 'WHERE') THEN 0.2 ELSE 0 END))::DOUBLE AS pattern_score FROM intent)"""


def _norm(x: str) -> str:
    return _strip(f"rtrim(lower(regexp_replace({x}, '\\s+', ' ', 'g')), ';')")


def _clause_list(n: str, pattern: str) -> str:
    return (f"CASE WHEN regexp_matches({n}, '{pattern}') THEN "
            f"list_transform(string_split(regexp_extract({n}, '{pattern}', 1), ','), lambda x: trim(x)) ELSE [] END")


def _clause_one(n: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({n}, '{pattern}') THEN [trim(regexp_extract({n}, '{pattern}', 1))] ELSE [] END"


_P = {
    "sel": r"select\s+(.*?)\s+from", "frm": r"from\s+([\w\.]+)",
    "whr": r"where\s+(.*?)(?:\s+group\s+by|\s+order\s+by|\s+limit|$)",
    "grp": r"group\s+by\s+(.*?)(?:\s+having|\s+order\s+by|\s+limit|$)", "ord": r"order\s+by\s+(.*?)(?:\s+limit|$)",
}


def _bare(x: str) -> str:
    steps = [(r"\s+as\s+\w+", ""), (r"^([\w\.]+)\s+\w+$", r"\1"), (r"^\w+\.(\w+)$", r"\1"),
             (r"(\w+)\((\w+)\.(\w+)\)", r"\1(\3)")]
    out = f"lower(trim({x}))"
    for a, b in steps:
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return f"trim(CASE WHEN contains({out}, '(') THEN {out} ELSE regexp_replace({out}, '^[^.]*\\.([^.]*)$', '\\1') END)"


def _clauses_sql(prefix: str, n: str) -> str:
    return ", ".join([
        f"{_clause_list(n, _P['sel'])} AS {prefix}_sel", f"{_clause_one(n, _P['frm'])} AS {prefix}_frm",
        f"{_clause_one(n, _P['whr'])} AS {prefix}_whr", f"{_clause_list(n, _P['grp'])} AS {prefix}_grp",
        f"{_clause_list(n, _P['ord'])} AS {prefix}_ord",
        f"regexp_extract_all({n}, '(inner|left|right|full)?\\s*join\\s+([\\w\\.]+)', 2) AS {prefix}_jns",
    ])


def _pairs_sql(w: str) -> str:
    c = f"regexp_replace({w}, '\\b\\w+\\.(\\w+)', '\\1', 'g')"
    skip = ", ".join(f"'{s}'" for s in K.WHERE_SKIP_WORDS)
    comparison = r"(\w+)\s*(>=|<=|<>|!=|>|<|=)\s*[\d''\"]"

    def named(p, op):
        return f"list_transform(regexp_extract_all({c}, '{p}', 1), lambda x: x || ' {op}')"

    joined = (f"list_transform(list_zip(regexp_extract_all({c}, '{comparison}', 1), regexp_extract_all({c}, '{comparison}', 2)), "
              "lambda x: x[1] || ' ' || x[2])")
    parts = " || ".join([named(r"(\w+)\s+between\b", "between"), joined, named(r"(\w+)\s+like\b", "like"), named(r"(\w+)\s+in\s*\(", "in")])
    nulls = named(r"(\w+)\s+is\s+(?:not\s+)?null", "is_null")
    return f"list_distinct(list_filter({parts}, lambda x: string_split(x, ' ')[1] NOT IN ({skip})) || {nulls})"


def _overlap_sql(a: str, b: str) -> str:
    da, db = (f"list_distinct(list_transform({x}, lambda v: {_bare('v')}))" for x in (a, b))
    return (f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 "
            f"ELSE len(list_intersect({da}, {db}))::DOUBLE / least(len({da}), len({db})) END")


_SIM_SQL = f"""normal AS (SELECT query_id, cleaned_sql, ground_truth_sql, {_norm('cleaned_sql')} AS na, {_norm('ground_truth_sql')} AS nb
  FROM live WHERE ground_truth_sql IS NOT NULL),
parts AS (SELECT query_id, na, nb, {_clauses_sql('a', 'na')}, {_clauses_sql('b', 'nb')} FROM normal),
wheres AS (SELECT *, {_pairs_sql("coalesce(a_whr[1], '')")} AS pa, {_pairs_sql("coalesce(b_whr[1], '')")} AS pb FROM parts),
cols AS (SELECT *, list_distinct(list_transform(pa, lambda x: string_split(x, ' ')[1])) AS ca,
  list_distinct(list_transform(pb, lambda x: string_split(x, ' ')[1])) AS cb FROM wheres),
wsim AS (SELECT *, CASE WHEN len(a_whr) = 0 AND len(b_whr) = 0 THEN 1.0 WHEN len(a_whr) = 0 OR len(b_whr) = 0 THEN 0.0
   WHEN a_whr[1] = b_whr[1] THEN 1.0 WHEN len(pa) = 0 AND len(pb) = 0 THEN 1.0 WHEN len(pa) = 0 OR len(pb) = 0 THEN 0.0
   WHEN list_sort(pa) = list_sort(pb) THEN 0.7
   ELSE least(0.65, len(list_intersect(pa, pb))::DOUBLE / len(list_distinct(pa || pb)) * 0.6
              + len(list_intersect(ca, cb))::DOUBLE / greatest(len(ca), len(cb)) * 0.35) END::DOUBLE AS where_similarity FROM cols),
sims AS (SELECT *, CASE WHEN na = nb THEN 1.0 ELSE {_overlap_sql('a_sel', 'b_sel')} * 0.4 + {_overlap_sql('a_frm', 'b_frm')} * 0.15
   + where_similarity * 0.2 + {_overlap_sql('a_grp', 'b_grp')} * 0.1 + {_overlap_sql('a_ord', 'b_ord')} * 0.1
   + {_overlap_sql('a_jns', 'b_jns')} * 0.05 END::DOUBLE AS similarity FROM wsim)"""


def _live_sql(body: str, *parts: str) -> str:
    return with_tables(body, "queries", extra=",\n".join((_CLEAN_SQL, *parts)))


# --- text filters ---------------------------------------------------------
@query("F4_non_data_replies", with_tables(
    f"SELECT query_id, coalesce({_has('lower(generated_sql)', K.NON_DATA_REPLIES)}, false) AS non_data FROM queries", "queries"))
def non_data(spark, d):
    return T.queries(spark, d).select("query_id", X.is_non_data_reply(F.col("generated_sql")).alias("non_data"))


@query("F5_business_questions", with_tables(
    f"SELECT query_id, NOT {_any('trim(lower(query_text))', K.NON_BUSINESS_PATTERNS)} AS business FROM queries", "queries"))
def business(spark, d):
    return T.queries(spark, d).select("query_id", X.is_business_question(F.col("query_text")).alias("business"))


@query("F6_read_only_statements", _live_sql(
    "SELECT query_id, (starts_with(upper(cleaned_sql), 'SELECT') OR starts_with(upper(cleaned_sql), 'WITH')) AND NOT "
    f"regexp_matches(upper(cleaned_sql), '{'|'.join(K.WRITE_KEYWORDS)}') AS read_only FROM live"))
def read_only(spark, d):
    return _live(spark, d).select("query_id", X.is_read_only(F.col("cleaned_sql")).alias("read_only"))


@query("F7_aggregate_queries", _live_sql(
    r"SELECT query_id, regexp_matches(upper(cleaned_sql), '\bGROUP\s+BY\b|\b(SUM|AVG|COUNT|MAX|MIN)\s*\(') AS is_aggregate FROM live"))
def aggregate(spark, d):
    return _live(spark, d).select("query_id", X.is_aggregate_query(F.col("cleaned_sql")).alias("is_aggregate"))


@query("F13_cleaned_sql", _live_sql("SELECT query_id, cleaned_sql FROM live"))
def cleaned(spark, d):
    return _live(spark, d).select("query_id", "cleaned_sql")


@query("F14_normalised_sql", _live_sql(f"SELECT query_id, {_norm('cleaned_sql')} AS normal FROM live"))
def normalised(spark, d):
    return _live(spark, d).select("query_id", X.normalise_sql(F.col("cleaned_sql")).alias("normal"))


@query("F15_sql_in_payloads", r"""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'SELECT k FROM t WHERE k = ' || json_extract_string(props, '$.k')
  WHEN event_type = 'click' THEN 'DELETE FROM t' END AS found FROM events""")
def payload_sql(spark, d):
    e = read_table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    payload = F.when(
        F.col("event_id") % 2 == 0,
        F.create_map(F.lit("note"), k, F.lit("sql_query"), F.concat(F.lit("SELECT k FROM t WHERE k = "), k)),
    ).otherwise(F.create_map(F.lit("note"), k, F.lit("body"), F.when(F.col("event_type") == "click", "DELETE FROM t").otherwise("none")))
    return e.select("event_id", X.sql_from_payload(payload).alias("found"))


@query("F15_sql_in_conversations", r"""
SELECT role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text,
  '(?i)\b(SELECT\s.+\sFROM|INSERT\s+INTO|UPDATE\s.+\sSET|DELETE\s+FROM|WITH\s.+\sAS)\b')) AS with_sql FROM conversations GROUP BY 1""")
def conversation_sql(spark, d):
    c = read_table(spark, d, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("n"), F.count(X.sql_from_text(F.col("text"))).alias("with_sql"))


# --- scores ---------------------------------------------------------------
_KNOWN_SQL = f"""known AS (SELECT DISTINCT table_name, column_name FROM information_schema.columns
  WHERE table_name IN ({', '.join(f"'{t}'" for t in _TABLES)})),
names AS (SELECT DISTINCT table_name AS name FROM known UNION SELECT DISTINCT 'public.' || table_name FROM known),
refs AS (SELECT query_id, unnest(regexp_extract_all(cleaned_sql, '(?i)\\b(?:FROM|JOIN)\\s+([\\w\\.]+)(?:\\s+\\w+)?', 1)) AS name FROM live),
pairs AS (SELECT query_id, unnest(regexp_extract_all(cleaned_sql, '(\\w+)\\.(\\w+)', 1)) AS t,
  unnest(regexp_extract_all(cleaned_sql, '(\\w+)\\.(\\w+)', 2)) AS c FROM live),
errs AS (
  SELECT query_id, 'Table ''' || name || ''' does not exist in discovered schema' AS error FROM refs WHERE name NOT IN (SELECT name FROM names)
  UNION ALL
  SELECT query_id, 'Column ''' || c || ''' does not exist in table ''' || t || '''' FROM pairs
  WHERE t || '.' || c NOT IN (SELECT name FROM names) AND t IN (SELECT name FROM names)
    AND NOT EXISTS (SELECT 1 FROM known k WHERE k.table_name = t AND k.column_name = c))"""


@query("Q1_schema_references", _live_sql("SELECT query_id, error FROM errs", _KNOWN_SQL))
def schema_refs(spark, d):
    return G.schema_errors(_live(spark, d), _catalog(spark, d), "cleaned_sql")


_ENGINE_SQL = """CASE WHEN contains(generated_sql, 'unlisted_table') THEN 'UNDEFINED_TABLE' WHEN contains(generated_sql, 'unlisted_column') THEN 'UNDEFINED_COLUMN'
   WHEN contains(generated_sql, 'not a database') THEN 'SYNTAX_ERROR' END"""
_STRUCT_SQL = f"""structural AS (SELECT l.*, coalesce(n, 0) AS schema_error_count, {_ENGINE_SQL} AS engine_error_type,
   CASE WHEN {_ENGINE_SQL} IS NOT NULL OR execution_time_ms > 200 THEN 0.0 WHEN coalesce(n, 0) > 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS structural_score
   FROM live l LEFT JOIN (SELECT query_id, count(*) AS n FROM errs GROUP BY 1) USING (query_id))"""


def reported_by_engine(live):
    """Adds what the engine said of a statement: engine_error_type and engine_failed."""
    sql = F.col("generated_sql")
    kind = (
        F.when(F.contains(sql, F.lit("unlisted_table")), "UNDEFINED_TABLE")
        .when(F.contains(sql, F.lit("unlisted_column")), "UNDEFINED_COLUMN")
        .when(F.contains(sql, F.lit("not a database")), "SYNTAX_ERROR")
    )
    return live.withColumn("engine_error_type", kind).withColumn(
        "engine_failed", F.col("engine_error_type").isNotNull() | (F.col("execution_time_ms") > 200)
    )


def _structural(spark, d, live=None):
    live = _live(spark, d) if live is None else live
    return G.structural(reported_by_engine(live), _catalog(spark, d), "cleaned_sql")


@query("Q2_structural_scores", _live_sql(
    "SELECT query_id, structural_score, schema_error_count, engine_error_type IS NOT NULL AS requires_classification, "
    "contains(upper(cleaned_sql), 'FROM') AS queries_a_table FROM structural", _KNOWN_SQL, _STRUCT_SQL))
def structural(spark, d):
    return _structural(spark, d).select(
        "query_id", "structural_score", "schema_error_count", "requires_classification",
        G.queries_a_table(F.col("cleaned_sql")).alias("queries_a_table"))


def _intents(spark, d, live=None):
    measures, dimensions = C.measures_and_dimensions(read_tables(spark, d, ["orders", "lineitem"]))
    return G.text_scores(_live(spark, d) if live is None else live, measures, dimensions, sql="cleaned_sql")


@query("Q3_requested_intents", _live_sql(
    "SELECT query_id, array_to_string(requested_intents, ',') AS intents FROM intent", _INTENT_SQL))
def requested(spark, d):
    return _intents(spark, d).select("query_id", F.concat_ws(",", "requested_intents").alias("intents"))


@query("Q4_performed_operations", _live_sql(
    "SELECT query_id, array_to_string(performed_intents, ',') AS operations FROM intent", _INTENT_SQL))
def performed(spark, d):
    return _intents(spark, d).select("query_id", F.concat_ws(",", "performed_intents").alias("operations"))


@query("Q5_intent_scores", _live_sql("SELECT query_id, round(intent_score, 8) AS intent_score FROM intent", _INTENT_SQL))
def intent_scores(spark, d):
    return _intents(spark, d).select("query_id", _r("intent_score"))


@query("Q6_pattern_scores", _live_sql("SELECT query_id, round(pattern_score, 8) AS pattern_score FROM pattern", _INTENT_SQL, _PATTERN_SQL))
def pattern_scores(spark, d):
    return _intents(spark, d).select("query_id", _r("pattern_score"))


@query("Q7_clauses", _live_sql("""
SELECT query_id, array_to_string(a_sel, '|') AS selected, array_to_string(a_frm, '|') AS sources, array_to_string(a_whr, '|') AS conditions,
  array_to_string(a_grp, '|') AS grouped, array_to_string(a_ord, '|') AS ordered, array_to_string(a_jns, '|') AS joined FROM parts""", _SIM_SQL))
def clauses(spark, d):
    live = S.with_clauses(_live(spark, d).filter(F.col("ground_truth_sql").isNotNull()), "cleaned_sql", "c")
    names = {"select": "selected", "from": "sources", "where": "conditions", "group_by": "grouped", "order_by": "ordered", "joins": "joined"}
    return live.select("query_id", *[F.concat_ws("|", F.col("c")[c]).alias(n) for c, n in names.items()])


@query("Q8_bare_references", _live_sql(
    f"SELECT query_id, array_to_string(list_transform(b_sel, lambda v: {_bare('v')}), '|') AS selected, "
    f"array_to_string(list_transform(b_frm, lambda v: {_bare('v')}), '|') AS sources FROM parts", _SIM_SQL))
def bare(spark, d):
    live = S.with_clauses(_live(spark, d).filter(F.col("ground_truth_sql").isNotNull()), "ground_truth_sql", "c")
    return live.select(
        "query_id", *[F.concat_ws("|", F.transform(F.col("c")[c], lambda v: S.bare_reference(v))).alias(n)
                      for c, n in (("select", "selected"), ("from", "sources"))])


@query("Q9_where_pairs", _live_sql("SELECT query_id, array_to_string(list_sort(pa), '|') AS pairs FROM wheres", _SIM_SQL))
def where_pairs(spark, d):
    live = S.with_clauses(_live(spark, d).filter(F.col("ground_truth_sql").isNotNull()), "cleaned_sql", "c")
    first = F.coalesce(F.get(F.col("c.where"), F.lit(0)), F.lit(""))
    return live.select("query_id", F.concat_ws("|", F.array_sort(S.where_pairs(first))).alias("pairs"))


@query("Q10_where_similarity", _live_sql("SELECT query_id, round(where_similarity, 8) AS where_similarity FROM wsim", _SIM_SQL))
def where_similarity(spark, d):
    live = _live(spark, d).filter(F.col("ground_truth_sql").isNotNull())
    both = S.with_clauses(S.with_clauses(live, "cleaned_sql", "a"), "ground_truth_sql", "b")
    lists = both.select("query_id", F.col("a.where").alias("wa"), F.col("b.where").alias("wb"))
    return S.with_where_similarity(lists, "wa", "wb", "where_similarity").select("query_id", _r("where_similarity"))


@query("Q11_sql_similarity", _live_sql(
    "SELECT query_id, round(similarity, 8) AS similarity, similarity >= 0.6 AS is_equivalent, similarity >= 0.7 AS components_match FROM sims", _SIM_SQL))
def similarity(spark, d):
    live = _live(spark, d).filter(F.col("ground_truth_sql").isNotNull())
    out = S.sql_similarity(live, "cleaned_sql", "ground_truth_sql")
    return out.select("query_id", _r("similarity"), S.is_equivalent(F.col("similarity")).alias("is_equivalent"),
                      S.components_match(F.col("similarity")).alias("components_match"))


@query("Q12_polarity_conflicts", with_tables(
    f"SELECT query_id, ({_has('lower(query_text)', K.LESS_PHRASES)} AND {_has('lower(other)', K.MORE_PHRASES)}) OR "
    f"({_has('lower(query_text)', K.MORE_PHRASES)} AND {_has('lower(other)', K.LESS_PHRASES)}) AS conflict "
    "FROM (SELECT *, CASE WHEN execution_time_ms < 30 THEN 'orders above 10' ELSE 'orders under 10' END AS other FROM queries)", "queries"))
def polarity(spark, d):
    other = F.when(F.col("execution_time_ms") < 30, "orders above 10").otherwise("orders under 10")
    return T.queries(spark, d).select("query_id", X.polarity_conflict(F.col("query_text"), other).alias("conflict"))


@query("Q13_judgements", """
SELECT event_id AS query_id, CASE WHEN event_type = 'click' THEN 'FAIL' WHEN value > 50 THEN 'PASS' ELSE 'FAIL' END AS verdict,
  CASE WHEN event_type = 'view' THEN 0.5 ELSE round(value / 1000.0::DOUBLE, 6) END::DOUBLE AS confidence,
  CASE WHEN value > 20 THEN 'took ' || CAST(floor(value)::BIGINT AS VARCHAR) || ' ms' END AS reasoning FROM events""")
def judgements(spark, d):
    e = read_table(spark, d, "events")
    said = F.when(F.col("event_type") == "click", "MAYBE").when(F.col("value") > 50, "pass").otherwise("FAIL")
    sure = F.when(F.col("event_type") == "view", "unsure").otherwise((F.col("value") / 1000.0).cast("string"))
    why = F.concat(F.lit("took "), F.floor("value").cast("string"), F.lit(" ms"))
    text = F.concat(F.lit("VERDICT: FAIL\n  VERDICT: "), said, F.lit("\nCONFIDENCE: "), sure, F.lit("\nREASONING: "),
                    F.when(F.col("value") > 20, why).otherwise(""))
    parsed = e.select(F.col("event_id").alias("query_id"), F.col("value"), text.alias("t")).withColumn("j", G.parse_judgement(F.col("t")))
    return parsed.select("query_id", "j.verdict", F.round("j.confidence", 6).alias("confidence"),
                         F.when(F.col("j.reasoning") != F.col("t"), F.col("j.reasoning")).alias("reasoning"))


@query("Q14_query_lists", """
SELECT event_id AS query_id, 0 AS position, 'how many ' || event_type AS natural_language, 'SELECT count(*) FROM ' || event_type AS sql,
  CAST(NULL AS VARCHAR) AS complexity FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, 2, 'worst', 'SELECT max(v) FROM t', 'simple' FROM events WHERE event_type <> 'error'""")
def query_lists(spark, d):
    e = read_table(spark, d, "events")
    first = F.concat(F.lit('{"natural_language": "how many '), "event_type", F.lit('", "sql": "SELECT count(*) FROM '), "event_type", F.lit('"}'))
    body = F.concat(F.lit("Here you are:\n```json\n["), first,
                    F.lit(',\n {"natural_language": "", "sql": "SELECT 1"},\n {"natural_language": "worst", "sql": "SELECT max(v) FROM t", "complexity": "simple"}]\n```'))
    text = F.when(F.col("event_type") == "error", "[{broken").otherwise(body)
    return G.parse_query_list(e.select(F.col("event_id").alias("query_id"), text.alias("response")), "response", "query_id")


# --- evaluation -----------------------------------------------------------
_EVAL_INPUT_SQL = f"""inputs AS (
  SELECT s.query_id, s.query_text, s.generated_sql, s.cleaned_sql, s.agent_type, s.ground_truth_sql, s.engine_error_type, s.structural_score,
    p.intent_score, p.pattern_score, m.similarity AS semantic_score,
    CASE WHEN s.ground_truth_sql IS NOT NULL THEN CASE WHEN s.execution_time_ms < 60 THEN 1.0 ELSE 0.0 END::DOUBLE END AS judge_score,
    greatest(0.0::DOUBLE, 1.0::DOUBLE - s.execution_time_ms / 100.0::DOUBLE) AS drift_quality,
    CASE WHEN s.execution_time_ms > 8 THEN (s.query_id * 53 % 101)::DOUBLE / 100.0::DOUBLE END AS result_score
  FROM structural s JOIN (SELECT query_id, intent_score, pattern_score FROM pattern) p USING (query_id)
  LEFT JOIN (SELECT query_id, similarity FROM sims) m USING (query_id)),
pathed AS (SELECT *, CASE WHEN {_has('lower(generated_sql)', K.NON_DATA_REPLIES)} THEN 'non_data_reply'
   WHEN {_any('trim(lower(query_text))', K.NON_BUSINESS_PATTERNS)} THEN 'non_business'
   WHEN structural_score > 0 AND NOT contains(upper(cleaned_sql), 'FROM') THEN 'no_from'
   WHEN engine_error_type IS NOT NULL THEN 'classified_error' WHEN structural_score = 0 THEN 'structural_fail'
   WHEN ground_truth_sql IS NOT NULL THEN CASE WHEN (coalesce(result_score, 0) < 0.25 AND judge_score = 1) OR (judge_score = 0 AND coalesce(result_score, 0) < 0.3)
      THEN 'heuristic_fallback' ELSE 'ground_truth' END
   ELSE 'heuristic' END AS eval_path FROM inputs),
finals AS (SELECT *, CASE WHEN eval_path IN ('heuristic', 'heuristic_fallback') THEN
     CASE WHEN drift_quality < 0.1 AND structural_score < 0.5 AND intent_score < 0.3 THEN 0.0
          ELSE structural_score * 0.45::DOUBLE + intent_score * 0.3::DOUBLE + pattern_score * 0.25::DOUBLE END
   WHEN eval_path = 'ground_truth' THEN CASE WHEN coalesce(result_score, 0) = 0
      THEN 0.6::DOUBLE * structural_score + 0.1::DOUBLE * semantic_score + 0.3::DOUBLE * judge_score
      ELSE 0.4::DOUBLE * structural_score + 0.15::DOUBLE * semantic_score + 0.15::DOUBLE * judge_score + 0.3::DOUBLE * result_score END
   ELSE 0.0 END::DOUBLE AS final_score FROM pathed)"""
_EVAL_PARTS = (_KNOWN_SQL, _STRUCT_SQL, _INTENT_SQL, _PATTERN_SQL, _SIM_SQL, _EVAL_INPUT_SQL)


def evaluated(spark, d):
    ms = F.col("execution_time_ms")
    live = S.sql_similarity(_live(spark, d), "cleaned_sql", "ground_truth_sql", "semantic_score")
    has_gt = F.col("ground_truth_sql").isNotNull()
    scored = _intents(spark, d, _structural(spark, d, live)).withColumns(
        {
            "has_ground_truth": has_gt,
            "judge_score": F.when(has_gt, F.when(ms < 60, 1.0).otherwise(0.0)),
            "judge_confidence": F.lit(0.8),
            "drift_quality": F.greatest(F.lit(0.0), 1.0 - ms / 100.0),
            "result_score": F.when(ms > 8, (F.col("query_id") * 53 % 101) / 100.0),
        }
    )
    return G.evaluate(scored)


@query("G8_evaluation", _live_sql("""
SELECT query_id, eval_path, round(final_score, 8) AS final_score, CASE WHEN final_score >= 0.6 THEN 'PASS' ELSE 'FAIL' END AS result,
  round(CASE WHEN eval_path IN ('heuristic', 'heuristic_fallback') THEN final_score WHEN eval_path = 'ground_truth' THEN (0.8::DOUBLE + final_score) / 2
    WHEN eval_path IN ('non_business', 'no_from') THEN 1.0 ELSE 0.0 END, 8)::DOUBLE AS confidence FROM finals""", *_EVAL_PARTS))
def evaluation(spark, d):
    return evaluated(spark, d).select("query_id", "eval_path", _r("final_score"), "result", _r("confidence"))


@query("G2_heuristic_scores", _live_sql(
    "SELECT query_id, round(structural_score * 0.45::DOUBLE + intent_score * 0.3::DOUBLE + pattern_score * 0.25::DOUBLE, 8) AS heuristic FROM inputs", *_EVAL_PARTS))
def heuristic(spark, d):
    scored = _intents(spark, d, _structural(spark, d))
    return scored.select("query_id", F.round(G.heuristic_score(F.col("structural_score"), F.col("intent_score"), F.col("pattern_score")), 8).alias("heuristic"))


@query("G3_drift_vetoes", _live_sql(
    "SELECT query_id, drift_quality < 0.1 AND structural_score < 0.5 AND intent_score < 0.3 AS vetoed FROM inputs", *_EVAL_PARTS))
def vetoes(spark, d):
    scored = _intents(spark, d, _structural(spark, d))
    quality = F.greatest(F.lit(0.0), 1.0 - F.col("execution_time_ms") / 100.0)
    return scored.select("query_id", G.drift_veto(quality, F.col("structural_score"), F.col("intent_score")).alias("vetoed"))


@query("G4_ground_truth_scores", with_tables(
    "SELECT query_id, round(final_score, 8) AS final_score, result, round(confidence, 8) AS confidence FROM evaluations", "evaluations"))
def gt_scores(spark, d):
    return T.evaluations(spark, d).select("query_id", _r("final_score"), "result", _r("confidence"))


@query("G5_pass_threshold", with_tables(
    "SELECT result, count(*) AS n, round(min(final_score), 8) AS lowest, round(max(final_score), 8) AS highest FROM evaluations GROUP BY 1", "evaluations"))
def threshold(spark, d):
    return T.evaluations(spark, d).groupBy("result").agg(
        F.count("*").alias("n"), F.round(F.min("final_score"), 8).alias("lowest"), F.round(F.max("final_score"), 8).alias("highest"))


@query("G6_wrong_ground_truth", with_tables(
    "SELECT query_id, (coalesce(result_score, 0) < 0.25 AND llm_score = 1) OR (llm_score = 0 AND coalesce(result_score, 0) < 0.3) AS wrong FROM evaluations", "evaluations"))
def wrong(spark, d):
    return T.evaluations(spark, d).select("query_id", G.wrong_ground_truth(F.col("result_score"), F.col("llm_score")).alias("wrong"))


@query("G7_result_paths", with_tables("""
SELECT query_id, CASE WHEN complexity = 'simple' AND semantic_score >= 0.65 THEN 'expected_output' WHEN complexity = 'simple' THEN 'judge_only' ELSE 'compare_results' END AS path,
  CASE WHEN semantic_score >= 0.9 THEN 'HIGH' WHEN semantic_score >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM evaluations""", "evaluations"))
def paths(spark, d):
    from veriscope.operators.compare import match_confidence
    return T.evaluations(spark, d).select(
        "query_id", G.result_path(F.col("complexity") == "simple", F.col("semantic_score")).alias("path"),
        match_confidence(F.col("semantic_score")).alias("confidence"))


@query("G9_evaluation_record", with_tables(
    "SELECT query_id, round(result_score, 6) AS result_score, round(structural_score, 6) AS structural_score, complexity FROM evaluations", "evaluations"))
def record(spark, d):
    e = G.evaluation_data(T.evaluations(spark, d).drop("evaluation_data"), ["complexity"], ["structural_score", "result_score"])
    def at(path):
        return F.get_json_object("evaluation_data", path)
    return e.select("query_id", F.round(at("$.scores.result_score").cast("double"), 6).alias("result_score"),
                    F.round(at("$.scores.structural_score").cast("double"), 6).alias("structural_score"), at("$.complexity").alias("complexity"))


@query("G10_work_list", with_tables(
    "SELECT query_id, created_at FROM evaluations WHERE ground_truth_sql IS NOT NULL AND result_score IS NULL ORDER BY created_at DESC, query_id LIMIT 10", "evaluations"))
def work_list(spark, d):
    return G.lacking_result_check(T.evaluations(spark, d)).select("query_id", "created_at")
