"""The spend file and what is loaded from it: how much is written, shuffled and read again."""

from pathlib import Path

from veriscope.plans import sources as plans
from veriscope.sources import files as I
from veriscope.sources import loads as L


def test_the_spend_file_is_compressed(spark, folder):
    path = plans._spend_file(spark, folder)
    parts = [p for p in Path(path).iterdir() if p.name.startswith("part-")]
    assert parts and all(p.name.endswith(".csv.gz") for p in parts)
    rows = I.read_spend(spark, path)
    assert rows.count() == I.read_table(spark, folder, "lineitem").count()
    # the position still follows the order of the file
    listed = [r.order_id for r in rows.orderBy(I.POSITION).select("order_id").collect()]
    assert [int(x) for x in listed] == sorted(int(x) for x in listed)


def test_customers_are_aggregated_from_the_file_once(spark, folder):
    loaded = L.load_spend(I.read_spend(spark, plans._spend_file(spark, folder)))
    for df, scans in ((loaded["customers"], 0), (loaded["orders"], 1)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(" csv") == scans, plan


def test_days_are_shuffled_as_dates(spark, folder, monkeypatch):
    written = []
    monkeypatch.setattr(plans, "_written", lambda df, *_: written.append(df))
    plans._spend_file(spark, folder)
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Sort [", 1)[1]
    assert "cast(l_shipdate" in below and "cast(o_orderdate" in below, plan
