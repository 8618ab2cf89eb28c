"""Files, loads and stores."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from veriscope import schemas
from veriscope.sources import files as I
from veriscope.sources import loads as L
from veriscope.sources import stores as S
from veriscope.streaming.runs import fresh_path

HEADER = "order_id,order_date,ship_date,ship_mode,customer_name,segment,state,country,market,region,product_id,category,sub_category,product_name,sales,quantity,discount,profit,shipping_cost,order_priority"
LINES = [
    "o1,1/2/2011,2011-01-31,First,Zoë,Consumer,A,x,y,r1,p1,c,s,n1,\"1,234.5\",2,0,oops,1,High",
    "o1,1/3/2011,13-02-2011,First,Zoë,Home,B,x,y,r2,p1,c,s,other,5,2,0,1,1,High",
    "o2,12/31/2012,2013-01-01,Second,Bob,Home,C,x,y,r3,p2,c,s,n2,7,1,0.1,-3,2,Low",
]


@pytest.fixture(scope="module")
def spend(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("spend") / "orders.csv"
    path.write_bytes(b"\xef\xbb\xbf" + "\n".join([HEADER, *LINES]).encode("latin-1"))
    return I.read_spend(spark, str(path)).cache()


def test_spend_cleaning(spend):
    assert spend.columns[0] == "order_id"
    rows = spend.orderBy(I.POSITION).collect()
    assert [r.sales for r in rows] == [1234.5, 5.0, 7.0] and rows[0].profit is None
    assert [r.order_date for r in rows] == [dt.date(2011, 1, 2), dt.date(2011, 1, 3), dt.date(2012, 12, 31)]
    assert [r.ship_date for r in rows] == [dt.date(2011, 1, 31), dt.date(2011, 2, 13), dt.date(2013, 1, 1)]
    assert [r.year for r in rows] == [2011, 2011, 2012] and rows[0].customer_name == "Zoë"


def test_spend_star_schema(spend):
    t = L.load_spend(spend)
    zoe = t["customers"].filter("customer_name = 'Zoë'").first()
    assert (zoe.segment, zoe.state, zoe.region) == ("Consumer", "A", "r1")
    orders = {r.order_id: r for r in t["orders"].collect()}
    assert set(orders) == {"o1", "o2"} and orders["o1"].sales == 1234.5 and orders["o1"].customer_id == zoe.customer_id
    assert {r.product_id: r.product_name for r in t["products"].collect()} == {"p1": "n1", "p2": "n2"}
    counts = L.load_counts(spend, t["orders"], "order_id").first()
    assert (counts.attempted, counts.inserted) == (3, 2)


@pytest.mark.parametrize("text, day", [("1/2/2011", dt.date(2011, 1, 2)), ("2011-01-31", dt.date(2011, 1, 31)),
                                       ("31-1-2011", dt.date(2011, 1, 31)), ("x", None)])
def test_mixed_dates(spark, text, day):
    assert spark.createDataFrame([(text,)], "t string").select(I.mixed_date(F.col("t"))).first()[0] == day


def test_ground_truth_files(spark, tmp_path):
    entries = [
        {"query_text": "Top 5?", "sql": "s1"}, {"natural_language": " top 5 ", "sql": "s2", "complexity": "medium"},
        {"query": "Other", "expected_output": {"columns": ["a"], "row_count": 3, "sample_rows": [["1"]], "execution_time_ms": 1.5}},
        {"query_text": "", "sql": "dropped"},
    ]
    (tmp_path / "doc.json").write_text(json.dumps({"agent_name": "x", "queries": entries}, indent=1))
    (tmp_path / "list.json").write_text(json.dumps(entries))
    for name in ("doc.json", "list.json"):
        read = I.read_ground_truth(spark, str(tmp_path / name))
        got = {r.question_key: r for r in I.ground_truth_index(read).collect()}
        assert set(got) == {"top 5", "other"}
        assert (got["top 5"].sql, got["top 5"].complexity) == ("s2", "medium")
        assert (got["other"].sql, got["other"].complexity, got["other"].expected_output.row_count) == ("", "simple", 3)


@pytest.mark.parametrize("url, jdbc", [
    ("postgresql://h:1/db", "jdbc:postgresql://h:1/db"), ("postgresql+psycopg2://h/db", "jdbc:postgresql://h/db"),
    ("mysql+pymysql://h/db", "jdbc:mysql://h/db"), ("sqlite:////tmp/x.db", "jdbc:sqlite:/tmp/x.db"),
])
def test_jdbc_url(url, jdbc):
    assert I.jdbc_url(url) == jdbc


def test_document_stores_are_no_sql_source():
    with pytest.raises(ValueError):
        I.jdbc_url("mongodb://h/db")


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = S.upsert(old, new, ["k"])
    twice = S.upsert(once, new, ["k"])
    want = [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


def test_write_agents_replaces_only_their_partitions(spark):
    path = fresh_path(spark, "issues")
    S.write_agents(spark.createDataFrame([(1, "a"), (2, "b")], "agent_id int, v string"), path)
    S.write_agents(spark.createDataFrame([(2, "c")], "agent_id int, v string"), path)
    assert sorted((r.agent_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_first_rule_wins_and_only_placeholders_change(spark):
    df = spark.createDataFrame([("Top sales", "SELECT 1"), ("top", "x"), ("none", "SELECT 1")], "query_text string, generated_sql string")
    got = [r.generated_sql for r in S.apply_rules(df, [("sales", "A"), ("top", "B")]).collect()]
    assert got == ["A", "x", "SELECT 1"]


def test_store_round_trip(spark):
    store = S.GroundTruthStore(spark, fresh_path(spark, "gt"))
    df = spark.createDataFrame([(1, "q")], "query_id int, query_text string")
    assert store.load("Spend", df.schema) is None
    store.save("Spend Agent", df)
    assert store.exists("spend") and store.load("spend", df.schema).collect() == df.collect()
    assert store.delete("spend") and not store.exists("spend")


def test_append_continues_the_numbering(spark):
    old = spark.createDataFrame([(1, "a"), (7, "b")], "query_id long, t string")
    new = spark.createDataFrame([("z",), ("y",)], "t string")
    assert sorted(map(tuple, S.append_entries(old, new, [F.col("t")]).collect())) == [(1, "a"), (7, "b"), (8, "y"), (9, "z")]


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    a = {r.k: r.split for r in S.split_dataset(df, "k").collect()}
    b = {r.k: r.split for r in S.split_dataset(df.repartition(3), "k").collect()}
    assert a == b and [list(a.values()).count(s) for s in ("train", "test", "validation")] == [60, 30, 11]


def test_status_log(spark):
    rows = [(1, 1, "failed", "e1", None, 1), (1, 2, "in_progress", None, None, None), (1, 3, "success", None, 40, None), (2, 1, "failed", "e2", None, 2)]
    log = spark.createDataFrame(rows, "agent_id int, at int, status string, error string, query_count int, retry_count int")
    got = {r.agent_id: r for r in S.ground_truth_status(log).collect()}
    assert (got[1].gt_status, got[1].gt_error, got[1].gt_query_count, got[1].gt_retry_count, got[1].can_retry) == ("success", None, 40, 1, False)
    assert (got[2].gt_status, got[2].gt_error, got[2].gt_retry_count, got[2].can_retry) == ("failed", "e2", 2, True)


def test_delete_covers_every_table(spark):
    agents = spark.createDataFrame([(1, "a"), (2, "b")], "agent_id int, agent_name string")
    q = spark.createDataFrame([(10, "a"), (20, "b")], "query_id int, agent_type string")
    out = S.delete_agents({"queries": q, "psi": q.drop("agent_type")}, agents, agents.filter("agent_id = 1").select("agent_id"))
    assert [r.agent_name for r in out["agents"].collect()] == ["b"]
    assert [r.query_id for r in out["queries"].collect()] == [20] == [r.query_id for r in out["psi"].collect()]


def test_stored_schemas_are_well_formed(spark):
    from pyspark.sql.types import StructType

    named = {n: StructType.fromDDL(v) for n, v in vars(schemas).items() if n.isupper() and n != "GROUND_TRUTH_ENTRY"}
    assert len(named) >= 9 and "psi_scores" in named["PSI_RESULTS"].fieldNames()


def test_rejected_texts_in_one_pass(spark):
    raw = spark.createDataFrame([("1,200", "2024-01-02"), ("n/a", "02.03"), ("", None), (None, "1/2/2024")], "sales string, day string")
    assert tuple(I.rejected(raw, {"sales": I.number, "day": I.mixed_date}).first()) == (1, 1)
