"""Loads, stores and registry queries. Files are first written from the driver tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from veriscope.operators.drift import baseline_questions
from veriscope.plans import standin as T
from veriscope.plans.quality import COLUMNS, KEYS
from veriscope.plans.registry import query
from veriscope.plans.standin import with_tables
from veriscope.sources import files as I
from veriscope.sources import loads as L
from veriscope.sources import stores as S
from veriscope.sources.files import read_table
from veriscope.streaming.runs import fresh_path

_AT = datetime(2024, 1, 31)


def _written(df, spark, name: str) -> str:
    path = fresh_path(spark, name)
    df.write.option("header", True).option("compression", "gzip").csv(path)
    return path


def _spend_file(spark, d) -> str:
    """Line items with their orders as a wide text file: thousands commas, two date layouts."""
    li, o = read_table(spark, d, "lineitem"), read_table(spark, d, "orders")
    c, p = read_table(spark, d, "customer"), read_table(spark, d, "part")
    # the file holds days: times would be the widest values of the shuffled rows
    li, o = (t.withColumn(day, F.col(day).cast("date")) for t, day in ((li, "l_shipdate"), (o, "o_orderdate")))
    # line items are shuffled for two joins, not three: customers are joined to the orders before
    sold = li.join(p, li["l_partkey"] == p["p_partkey"])
    wide = sold.join(o.join(c, o["o_custkey"] == c["c_custkey"]), li["l_orderkey"] == o["o_orderkey"])
    us = F.date_format("o_orderdate", "M/d/yyyy")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    cents = F.col("l_extendedprice").cast("decimal(12,2)")
    rows = wide.orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    ).select(
        F.col("l_orderkey").alias("order_id"), F.when(F.col("l_orderkey") % 2 == 0, us).otherwise(iso).alias("order_date"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_date"), F.col("l_linestatus").alias("ship_mode"),
        F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("segment"), F.col("l_returnflag").alias("state"),
        F.lit("x").alias("country"), F.lit("y").alias("market"), F.col("o_orderpriority").alias("region"),
        F.col("l_partkey").alias("product_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("sub_category"), F.col("p_name").alias("product_name"),
        F.format_number(cents, 2).alias("sales"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_discount").alias("discount"),
        F.lit("bad").alias("profit"), F.col("l_tax").alias("shipping_cost"), F.col("o_orderpriority").alias("order_priority"),
    )
    return _written(rows, spark, "spend")


_WIDE_SQL = """wide AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS p
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""


@query("S1_spend_file_cleaning", f"""WITH {_WIDE_SQL}
SELECT l_orderkey::VARCHAR AS order_id, o_orderdate::DATE AS order_date, l_shipdate::DATE AS ship_date, year(o_orderdate)::INTEGER AS year,
  round(l_extendedprice, 2) AS sales, l_quantity AS quantity, NULL::DOUBLE AS profit FROM wide""")
def spend_rows(spark, d):
    rows = I.read_spend(spark, _spend_file(spark, d))
    return rows.select("order_id", "order_date", "ship_date", "year", F.round("sales", 2).alias("sales"), "quantity", "profit")


@query("S3_file_with_byte_order_mark", f"""WITH {_WIDE_SQL}
SELECT l_orderkey::VARCHAR AS order_id, count(*) AS lines, round(sum(round(l_extendedprice, 2)), 2) AS sales FROM wide GROUP BY 1""")
def marked_file(spark, d):
    """A file whose first header name begins with a byte-order mark, read as Latin-1."""
    path = fresh_path(spark, "marked")
    columns = [F.col("l_orderkey").cast("string").alias("\ufefforder_id"), F.round("l_extendedprice", 2).cast("string").alias("sales"),
               F.lit("2024-01-01").alias("order_date"), F.lit("").alias("ship_date")]
    read_table(spark, d, "lineitem").select(*columns).write.option("header", True).csv(path)
    rows = I.read_spend(spark, path)
    return rows.groupBy("order_id").agg(F.count("*").alias("lines"), F.round(F.sum("sales"), 2).alias("sales"))


@query("S4_rejected_numbers", f"WITH {_WIDE_SQL} SELECT 0::BIGINT AS sales, count(*) AS profit, 0::BIGINT AS order_date FROM wide")
def rejects(spark, d):
    raw = I.read_csv(spark, _spend_file(spark, d), "ISO-8859-1")
    return I.rejected(raw, {"sales": I.number, "profit": I.number, "order_date": I.mixed_date})


@query("S7_customer_dimension", f"""WITH {_WIDE_SQL}
SELECT c_name AS customer_name, arg_min(c_mktsegment, p) AS segment, arg_min(l_returnflag, p) AS state, arg_min(o_orderpriority, p) AS region FROM wide GROUP BY 1""")
def customers(spark, d):
    loaded = L.load_spend(I.read_spend(spark, _spend_file(spark, d)))
    return loaded["customers"].select("customer_name", "segment", "state", "region")


@query("S8_first_order_wins", f"""WITH {_WIDE_SQL}
SELECT l_orderkey::VARCHAR AS order_id, arg_min(l_partkey, p)::VARCHAR AS product_id, arg_min(l_quantity, p) AS quantity, count(*) > 1 AS had_more FROM wide GROUP BY 1""")
def first_orders(spark, d):
    rows = I.read_spend(spark, _spend_file(spark, d))
    orders = L.first_wins(rows, "order_id", ["product_id", "quantity"])
    more = rows.groupBy("order_id").agg((F.count("*") > 1).alias("had_more"))
    return orders.join(more, ["order_id"])


@query("S9_fact_key_lookup", f"""WITH {_WIDE_SQL}, first AS (SELECT l_orderkey, arg_min(c_name, p) AS c_name, arg_min(l_quantity, p) AS q FROM wide GROUP BY 1)
SELECT c_name AS customer_name, count(*) AS orders, sum(q)::DOUBLE AS quantity FROM first GROUP BY 1""")
def fact_lookup(spark, d):
    loaded = L.load_spend(I.read_spend(spark, _spend_file(spark, d)))
    joined = loaded["orders"].join(loaded["customers"].select("customer_id", "customer_name"), ["customer_id"])
    return joined.groupBy("customer_name").agg(F.count("*").alias("orders"), F.sum("quantity").alias("quantity"))


def _supply_rows(spark, d):
    """Parts with the figures of their line items as a supply-chain file (headers with spaces)."""
    li, p, s = (read_table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    figures = li.groupBy("l_partkey").agg(
        F.min("l_suppkey").alias("supp"), F.sum("l_quantity").cast("long").alias("sold"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("revenue"),
        F.count("*").alias("n"))
    wide = p.join(figures, F.col("p_partkey") == F.col("l_partkey")).join(s, F.col("supp") == F.col("s_suppkey"))
    rows = wide.orderBy("p_partkey").select(
        F.col("p_type").alias("Product type"), F.col("p_partkey").alias("SKU"), F.col("p_retailprice").alias("Price"), F.col("p_size").alias("Availability"),
        F.col("sold").alias("Number of products sold"), F.col("revenue").alias("Revenue generated"), F.lit("all").alias("Customer demographics"),
        (F.col("p_size") * 2).alias("Stock levels"), (F.col("p_size") % 7).alias("Lead times"), F.col("n").alias("Order quantities"), F.lit(3).alias("Shipping times"),
        F.lit("air line").alias("Shipping carriers"), F.lit(1.5).alias("Shipping costs"), F.col("s_name").alias("Supplier name"), F.col("s_nationkey").alias("Location"),
        (F.col("p_size") % 5).alias("Lead time"), F.lit(10).alias("Production volumes"), F.lit(4).alias("Manufacturing lead time"), F.lit(2.5).alias("Manufacturing costs"),
        F.lit("Pass").alias("Inspection results"), F.lit(0.1).alias("Defect rates"), F.lit("Road").alias("Transportation modes"), F.lit("Route A").alias("Routes"),
        (F.col("p_retailprice") / 2).alias("Costs"))
    return I.read_supply(spark, _written(rows, spark, "supply"))


_SUPPLY_SQL = """figures AS (SELECT l_partkey, min(l_suppkey) AS supp, sum(l_quantity)::BIGINT AS sold, count(*) AS n FROM lineitem GROUP BY 1),
wide AS (SELECT * FROM part JOIN figures ON p_partkey = l_partkey JOIN supplier ON supp = s_suppkey)"""


@query("S2_supply_file", f"WITH {_SUPPLY_SQL} SELECT p_partkey::VARCHAR AS sku, p_type AS product_type, p_retailprice AS price, sold::INTEGER AS number_of_products_sold, (p_size % 7)::INTEGER AS lead_times, (p_size % 5)::INTEGER AS lead_time FROM wide")
def supply_file(spark, d):
    return _supply_rows(spark, d).select("sku", "product_type", "price", "number_of_products_sold", "lead_times", "lead_time")


@query("S10_four_tables", f"""WITH {_SUPPLY_SQL}
SELECT 'products' AS table_name, count(*) AS n FROM wide UNION ALL SELECT 'suppliers', count(DISTINCT s_name) FROM wide
UNION ALL SELECT 'sales', count(*) FROM wide UNION ALL SELECT 'supply_chain', count(*) FROM wide""")
def four_tables(spark, d):
    out = None
    for name, df in L.load_supply(_supply_rows(spark, d)).items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("S7_supplier_dimension", f"WITH {_SUPPLY_SQL} SELECT s_name AS supplier_name, arg_min(p_size % 5, p_partkey)::INTEGER AS lead_time, any_value(s_nationkey)::VARCHAR AS location FROM wide GROUP BY 1")
def suppliers(spark, d):
    return L.load_supply(_supply_rows(spark, d))["suppliers"].select("supplier_name", "lead_time", "location")


@query("A19_product_profitability", f"WITH {_SUPPLY_SQL} SELECT p_partkey::VARCHAR AS sku, p_type AS product_type, round(p_retailprice - p_retailprice / 2, 6) AS avg_profit, 0.5::DOUBLE AS profit_margin, (p_size * 2)::INTEGER AS stock_levels FROM wide")
def profitability(spark, d):
    t = L.load_supply(_supply_rows(spark, d))
    out = L.product_profitability(t["products"], t["supply_chain"])
    return out.select("sku", "product_type", F.round("avg_profit", 6).alias("avg_profit"), F.round("profit_margin", 6).alias("profit_margin"), "stock_levels")


@query("J13_product_costs", f"WITH {_SUPPLY_SQL} SELECT p_type AS product_type, count(*) AS n, round(avg(p_retailprice / 2), 6) AS avg_cost FROM wide GROUP BY 1")
def product_costs(spark, d):
    t = L.load_supply(_supply_rows(spark, d))
    both = t["products"].join(t["supply_chain"].select("sku", "total_cost"), ["sku"])
    return both.groupBy("product_type").agg(F.count("*").alias("n"), F.round(F.avg("total_cost"), 6).alias("avg_cost"))


# --- ground truth ---------------------------------------------------------
def _entries(spark, d):
    """Conversation turns as ground-truth entries with their alias fields."""
    c = read_table(spark, d, "conversations")
    text = F.col("text")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("position"),
        F.when(F.col("role") == "user", text).alias("query_text"),
        F.when(F.col("role") == "assistant", text).alias("natural_language"),
        F.when(F.col("role") == "system", F.concat(F.lit(" "), text, F.lit("?!"))).alias("query"),
        F.concat(F.lit("SELECT "), F.col("turn").cast("string")).alias("sql"),
        F.when(F.col("turn") > 2, "complex").alias("complexity"), F.col("role").alias("agent_type"),
    )


_ENTRIES_SQL = r"""entries AS (SELECT conv_id * 1000 + turn AS position, role AS agent_type,
  CASE WHEN role = 'system' THEN ' ' || text || '?!' ELSE text END AS question, 'SELECT ' || turn AS sql, CASE WHEN turn > 2 THEN 'complex' ELSE 'simple' END AS complexity
  FROM conversations WHERE text <> ''),
keyed AS (SELECT *, rtrim(lower(regexp_replace(question, '^\s+|\s+$', '', 'g')), '?.!') AS question_key FROM entries),
indexed AS (SELECT question_key, max(position) AS position, arg_max(sql, position) AS sql, arg_max(complexity, position) AS complexity FROM keyed GROUP BY 1)"""


@query("S11_ground_truth_index", f"WITH {_ENTRIES_SQL} SELECT question_key, position, sql, complexity FROM indexed")
def gt_index(spark, d):
    return I.ground_truth_index(_entries(spark, d)).select("question_key", "position", "sql", "complexity")


@query("S11_ground_truth_files", """
WITH e AS (SELECT conv_id * 1000 + turn AS p, conv_id % 3 AS part, text, 'SELECT ' || turn AS sql, CASE WHEN turn > 2 THEN 'complex' ELSE 'simple' END AS complexity
  FROM conversations WHERE text <> ''),
k AS (SELECT *, rtrim(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '?.!') AS question_key FROM e)
SELECT question_key, arg_max(sql, part * 1000000000000 + p) AS sql, arg_max(complexity, part * 1000000000000 + p) AS complexity, arg_max(part, part * 1000000000000 + p)::INTEGER AS file
FROM k GROUP BY 1""")
def gt_files(spark, d):
    """Index over ground-truth documents written from the conversations, one per third of them; of repeated questions the last of the last file counts."""
    path = fresh_path(spark, "ground-truth")
    text = F.col("text")
    entry = F.to_json(F.struct(
        text.alias("query_text"), F.concat(F.lit("SELECT "), F.col("turn").cast("string")).alias("sql"),
        F.when(F.col("turn") > 2, "complex").alias("complexity")))
    rows = read_table(spark, d, "conversations").filter("text <> ''").withColumn("entry", entry)
    for part in range(3):
        mine = rows.filter(F.col("conv_id") % 3 == part).coalesce(1).sortWithinPartitions("conv_id", "turn")
        numbered = mine.withColumn("n", F.monotonically_increasing_id())
        # a bare list, or an object with other keys around its list; entries follow each other without line ends
        head, tail = (("[", "]"), ('{"agent_id": "a}", "metadata": {"tags": [{"x": 1}]}, "queries": [', '], "notes": [{"y": 2}]}'))[part % 2]
        line = F.concat(F.when(F.col("n") == 0, F.lit(head)).otherwise(F.lit(",")), "entry")
        body = numbered.select(line.alias("value"))
        end = spark.createDataFrame([(tail,)], "value string")
        body.unionByName(end).coalesce(1).write.option("lineSep", " ").text(f"{path}/{part}")
    found = I.ground_truth_index(I.read_ground_truth(spark, [f"{path}/{part}" for part in range(3)]))
    return found.select("question_key", "sql", "complexity", F.regexp_extract("position.file", r"/(\d)/[^/]*$", 1).cast("int").alias("file"))


@query("S12_ground_truth_lookup", f"WITH {_ENTRIES_SQL} SELECT k.position AS position, i.sql AS sql FROM keyed k JOIN indexed i USING (question_key)")
def gt_lookup(spark, d):
    from veriscope.functions.text import question_key
    asked = _entries(spark, d).select("position", question_key(F.coalesce("query_text", "natural_language", "query")).alias("question_key"))
    index = I.ground_truth_index(_entries(spark, d)).select("question_key", "sql")
    return asked.join(index, ["question_key"]).select("position", "sql")


@query("S13_ground_truth_fallback", """
WITH a AS (SELECT 'src' || (n_chars % 3) AS agent_type, doc_id AS position, 0 AS priority FROM documents WHERE n_chars < 400),
b AS (SELECT source AS agent_type, doc_id AS position, 1 AS priority FROM documents),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b), best AS (SELECT agent_type, min(priority) AS priority FROM u GROUP BY 1)
SELECT agent_type, position, row_number() OVER (PARTITION BY agent_type ORDER BY position)::INTEGER AS rank FROM u JOIN best USING (agent_type, priority)
QUALIFY row_number() OVER (PARTITION BY agent_type ORDER BY position) <= 50""")
def gt_fallback(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "n_chars", "source")
    own = docs.filter(F.col("n_chars") < 400).select(
        F.concat(F.lit("SRC"), (F.col("n_chars") % 3).cast("string"), F.lit("_agent")).alias("agent_type"), F.col("doc_id").alias("position"))
    every = docs.select(F.col("source").alias("agent_type"), F.col("doc_id").alias("position"))
    return baseline_questions([own, every])


@query("S14_ground_truth_store", "SELECT item_id, text FROM benchmark")
def gt_store(spark, d):
    store = S.GroundTruthStore(spark, fresh_path(spark, "ground-truth"))
    table = read_table(spark, d, "benchmark")
    store.save("Spend Agent", table)
    return store.load("spend", table.schema)


# a sampled row is told by its key and its first column of text that is no part of it
_SAMPLED = {t: (KEYS[t], next((c for c, kind in columns.items() if c not in KEYS[t] and kind == "text"), KEYS[t][0])) for t, columns in COLUMNS.items()}


@query("S15_table_samples", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, concat_ws('|', {', '.join(f'{c}::VARCHAR' for c in k)}) AS row_key, {c}::VARCHAR AS value "
    f"FROM (SELECT * FROM {t} ORDER BY {', '.join((*k, *COLUMNS[t]))} LIMIT 5)" for t, (k, c) in _SAMPLED.items()))
def samples(spark, d):
    """Five rows of every table, the first by its key."""
    out = None
    for t in I.folder_tables(spark, d):
        key, column = _SAMPLED[t]
        rows = I.sample_rows(read_table(spark, d, t), key=key)
        part = rows.select(F.lit(t).alias("table_name"), F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("row_key"),
                           F.col(column).cast("string").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("S17_bounded_fetch", "SELECT least(count(*), 10000) AS row_count FROM lineitem")
def bounded(spark, d):
    return I.bounded(read_table(spark, d, "lineitem").select("l_orderkey")).agg(F.count("*").alias("row_count"))


@query("S19_upsert", """
SELECT event_id AS query_id, CASE WHEN value > 50 THEN value * 2 ELSE value END AS score FROM events WHERE value < 80 OR value > 50""")
def upsert(spark, d):
    e = read_table(spark, d, "events").select(F.col("event_id").alias("query_id"), F.col("value").alias("score"))
    new = e.filter(F.col("score") > 50).withColumn("score", F.col("score") * 2)
    return S.upsert(e.filter(F.col("score") < 80), new, ["query_id"])


@query("S20_replace_agents", """
SELECT event_type AS agent_type, event_id AS query_id FROM events WHERE event_type NOT IN ('click', 'view') UNION ALL SELECT event_type, event_id FROM events WHERE event_type = 'click' AND value > 100""")
def replace(spark, d):
    e = read_table(spark, d, "events").select(F.col("event_type").alias("agent_type"), F.col("event_id").alias("query_id"), "value")
    scanned = e.filter(F.col("agent_type").isin("click", "view")).select("agent_type")
    new = e.filter((F.col("agent_type") == "click") & (F.col("value") > 100))
    path = fresh_path(spark, "issues")
    S.write_agents(e.repartition("agent_type"), path, "agent_type")
    stored = spark.read.schema(e.schema).parquet(path)
    return S.replace_agents(stored, new.select(*stored.columns), scanned, "agent_type").select("agent_type", "query_id")


@query("S21_delete_agents", with_tables("""
SELECT 'agents' AS table_name, count(*) AS n FROM agents WHERE agent_name NOT IN ('click', 'error')
UNION ALL SELECT 'queries', count(*) FROM queries WHERE agent_type NOT IN ('click', 'error')
UNION ALL SELECT 'evaluations', count(*) FROM evaluations WHERE agent_type NOT IN ('click', 'error')
UNION ALL SELECT 'errors', count(*) FROM errors WHERE agent_type NOT IN ('click', 'error')
UNION ALL SELECT 'drift', count(*) FROM drift WHERE agent_type NOT IN ('click', 'error')""", "evaluations", "errors", "drift", "agents"))
def delete(spark, d):
    agents = T.agents(spark, d)
    tables = {"queries": T.queries(spark, d), "evaluations": T.evaluations(spark, d),
              "errors": T.errors(spark, d).drop("agent_type"), "drift": T.drift(spark, d).drop("agent_type")}
    dead = agents.filter(F.col("agent_name").isin("click", "error")).select("agent_id")
    out = None
    for name, df in S.delete_agents(tables, agents.select("agent_id", "agent_name"), dead).items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


_RULES = [("top", "SELECT * FROM orders ORDER BY o_totalprice DESC LIMIT 10"), ("SEGMENTS", "SELECT DISTINCT c_mktsegment FROM customer"),
          ("show me", "SELECT * FROM orders LIMIT 5")]


@query("S23_rule_updates", with_tables("""
SELECT query_id, CASE WHEN execution_time_ms > 40 THEN CASE WHEN contains(lower(query_text), 'top') THEN 'SELECT * FROM orders ORDER BY o_totalprice DESC LIMIT 10'
  WHEN contains(lower(query_text), 'segments') THEN 'SELECT DISTINCT c_mktsegment FROM customer' WHEN contains(lower(query_text), 'show me') THEN 'SELECT * FROM orders LIMIT 5'
  ELSE 'SELECT 1' END ELSE generated_sql END AS generated_sql FROM queries""", "queries"))
def rules(spark, d):
    q = T.queries(spark, d).withColumn("generated_sql", F.when(F.col("execution_time_ms") > 40, "SELECT 1").otherwise(F.col("generated_sql")))
    return S.apply_rules(q, _RULES).select("query_id", "generated_sql")


@query("S24_delete_entries", with_tables("SELECT query_id FROM queries WHERE query_text <> 'write a poem about part'", "queries"))
def delete_entries(spark, d):
    return S.drop_entries(T.queries(spark, d), "write a poem about part").select("query_id")


@query("S25_append_entries", """
SELECT item_id AS query_id, text FROM benchmark UNION ALL
SELECT (SELECT max(item_id) FROM benchmark) + row_number() OVER (ORDER BY conv_id, turn), text FROM conversations""")
def append_entries(spark, d):
    old = read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    new = read_table(spark, d, "conversations").select("conv_id", "turn", "text")
    return S.append_entries(old, new, [F.col("conv_id"), F.col("turn")])


@query("S25_update_log", "SELECT 'spend' AS agent_name, TIMESTAMP '2024-01-31' AS updated_at, count(*) AS queries_added FROM conversations")
def update_log(spark, d):
    return S.update_log(1, "spend", read_table(spark, d, "conversations"), _AT).drop("agent_id")


@query("S26_dataset_split", """
SELECT 'train' AS split, floor(count(*) * 0.6)::BIGINT AS n FROM documents UNION ALL SELECT 'test', floor(count(*) * 0.3)::BIGINT FROM documents
UNION ALL SELECT 'validation', (count(*) - floor(count(*) * 0.6) - floor(count(*) * 0.3))::BIGINT FROM documents""")
def split(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id")
    return S.split_dataset(docs, "doc_id").groupBy("split").agg(F.count("*").alias("n"))


@query("S27_agent_dimension", """
SELECT user_id AS agent_id, arg_min(event_type, ts) AS agent_name, arg_max(event_type, ts) AS status,
  CASE WHEN arg_max(value, ts) > 50 THEN 'slow' END AS error, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY 1""")
def agent_dimension(spark, d):
    log = read_table(spark, d, "events").select(
        F.col("user_id").alias("agent_id"), F.col("event_type").alias("agent_name"), F.col("event_type").alias("status"),
        F.when(F.col("value") > 50, "slow").alias("error"), F.col("ts").alias("at"))
    return S.agent_dimension(log)


@query("S28_registered_telemetry", with_tables("""
SELECT 'known' AS state, agent_id, count(*) AS n FROM queries JOIN agents ON lower(agent_type) = lower(agent_name) WHERE agent_name <> 'view' GROUP BY agent_id
UNION ALL SELECT 'rejected', NULL, count(*) FROM queries WHERE agent_type = 'view'""", "queries", "agents"))
def registered(spark, d):
    agents = T.agents(spark, d).filter(F.col("agent_name") != "view").select("agent_id", "agent_name")
    events = T.queries(spark, d).withColumn("agent_type", F.upper("agent_type"))
    known = S.register_telemetry(events, agents).groupBy("agent_id").agg(F.count("*").alias("n"))
    lost = S.rejected_telemetry(events, agents).agg(F.count("*").alias("n"))
    return known.select(F.lit("known").alias("state"), "agent_id", "n").unionByName(
        lost.select(F.lit("rejected").alias("state"), F.lit(None).cast("long").alias("agent_id"), "n"))


@query("S31_ground_truth_status", """
WITH a AS (SELECT user_id AS agent_id, ts AS seen_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'in_progress' ELSE 'success' END AS status,
  CASE WHEN value > 60 THEN event_id END AS query_count, CASE WHEN event_type = 'error' THEN event_id % 3 END AS retry_count FROM events)
SELECT agent_id, arg_max(status, seen_at) AS gt_status, arg_max(query_count, seen_at) FILTER (WHERE query_count IS NOT NULL) AS gt_query_count,
  coalesce(arg_max(retry_count, seen_at) FILTER (WHERE retry_count IS NOT NULL), 0) AS gt_retry_count,
  CASE WHEN arg_max(status, seen_at) = 'failed' THEN 'broke' END AS gt_error, arg_max(status, seen_at) = 'failed' AS can_retry FROM a GROUP BY 1""")
def gt_status(spark, d):
    e = read_table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "in_progress").otherwise("success")
    attempts = e.select(
        F.col("user_id").alias("agent_id"), F.col("ts").alias("at"), kind.alias("status"), F.lit("broke").alias("error"),
        F.when(F.col("value") > 60, F.col("event_id")).alias("query_count"),
        F.when(F.col("event_type") == "error", F.col("event_id") % 3).alias("retry_count"))
    return S.ground_truth_status(attempts)


@query("A26_entries_per_agent", """
SELECT CASE WHEN role = 'user' THEN 'spend' WHEN role = 'assistant' THEN 'demand' ELSE 'other' END AS agent_group, count(*) AS n FROM conversations GROUP BY 1""")
def per_agent(spark, d):
    c = read_table(spark, d, "conversations")
    named = F.when(F.col("role") == "user", "Spend").when(F.col("role") == "assistant", "demand").otherwise(F.col("role"))
    return S.entries_per_agent(c.select(named.alias("agent_type")))
