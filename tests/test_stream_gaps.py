from datetime import datetime, timedelta

import pytest

from veriscope.operators.assessment import ASSESSED
from veriscope.plans import streams as plans
from veriscope.schemas import EVENTS
from veriscope.sources.files import read_table
from veriscope.sources.snapshots import SnapshotTable, upsert_batches
from veriscope.streaming.lateness import through_gate
from veriscope.streaming.runs import fresh_path, run_to_end
from veriscope.streaming.silence import merged, silent_agents
from veriscope.streaming.telemetry import read_events

START = datetime(2024, 1, 1)
SIGNALS = "agent_type string, created_at timestamp"


def at(minutes):
    return START + timedelta(minutes=minutes)


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def append(spark, folder, schema, *rows):
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)


def test_stretches_merge():
    assert merged([(50, 60, 1), (0, 10, 2), (12, 20, 3), (30, 40, 4)], 10) == [(0, 20, 5), (30, 40, 4), (50, 60, 1)]
    assert merged([], 10) == []


def test_silence_is_raised_when_it_has_passed(spark):
    """The silent agent never sends again: the other agent's events move time on, and the timer raises the alert."""
    base = fresh_path(spark, "silence")
    data, out = f"{base}/in", f"{base}/out"

    def run():  # a new query each time, from the same checkpoint
        run_to_end(silent_agents(stream_of(spark, data, SIGNALS), delay="1 minute"), out)

    def alerts():
        rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows/batch_id=*").collect()
        return sorted((r.agent_type, r.last_seen, r.silent_since, r.events) for r in rows)

    append(spark, data, SIGNALS, ("quiet", at(0)), ("quiet", at(5)), ("busy", at(6)), (None, at(6)))
    run()
    assert alerts() == []
    append(spark, data, SIGNALS, ("busy", at(12)), ("busy", at(15)))
    run()
    assert alerts() == []  # 5 + 10 minutes lie ahead of the watermark at 14
    append(spark, data, SIGNALS, ("busy", at(18)), ("busy", None))
    run()
    want = [("quiet", at(5), at(15), 2)]
    assert alerts() == want
    # the agent comes back and falls silent again; nothing is raised twice, also after another restart
    append(spark, data, SIGNALS, ("quiet", at(20)), ("busy", at(25)))
    run()
    assert alerts() == want
    append(spark, data, SIGNALS, ("busy", at(33)))
    run()
    want.append(("quiet", at(20), at(30), 1))
    assert alerts() == want


def test_silences_inside_a_batch(spark):
    base = fresh_path(spark, "silence")
    append(spark, f"{base}/in", SIGNALS, *[("a", at(m)) for m in (0, 9, 18, 28, 100)], ("b", at(100)))
    out = f"{base}/out"
    run_to_end(silent_agents(stream_of(spark, f"{base}/in", SIGNALS), delay="1 minute"), out)
    rows = spark.read.parquet(f"{out}/rows/batch_id=*").collect()
    assert sorted((r.first_seen, r.last_seen, r.events) for r in rows) == [(at(0), at(18), 3), (at(28), at(28), 1)]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (0, 3, 1, 2), (3, 2, 1, 0)])
def test_nothing_is_lost_in_any_order_of_files(spark, folder, order):
    events = read_table(spark, folder, "events")
    path = fresh_path(spark, "order")
    for part in order:
        events.filter(f"floor((day(ts) - 1) / 8) = {part}").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = read_events(spark, f"{path}/in", "*.parquet", files_per_batch=1)
    gate = through_gate(stream, f"{path}/gate", "ts")
    kept, late = spark.read.schema(EVENTS).parquet(f"{path}/gate/kept/batch_id=*"), gate.late(EVENTS)
    assert kept.unionByName(late).exceptAll(events).isEmpty() and events.exceptAll(kept.unionByName(late)).isEmpty()
    report = gate.report().collect()
    assert sum(r.kept for r in report) == kept.count() and sum(r.late for r in report) == late.count()
    assert (late.count() == 0) == (order == (0, 1, 2, 3))
    # windows behind the gate drop nothing of what it kept
    total = 0
    from veriscope.streaming.runs import collect_stream
    from veriscope.streaming.telemetry import daily_accuracy
    behind = gate.kept(EVENTS).selectExpr("CAST(ts AS timestamp) created_at", "event_type agent_type", "'PASS' result")
    total = collect_stream(daily_accuracy(behind), "behind", ["day", "agent_type"], "update").agg({"total": "sum"}).first()[0]
    assert total == kept.count()


def test_a_repeated_batch_of_the_gate_replaces_itself(spark):
    schema = "t timestamp_ntz, v int"
    path = fresh_path(spark, "gate")
    from veriscope.streaming.lateness import LateGate
    gate = LateGate(spark, path, "t", "1 hour")
    gate.write(spark.createDataFrame([(at(0), 1), (at(300), 2), (None, 3)], schema), 0)
    for _ in range(2):
        gate.write(spark.createDataFrame([(at(239), 4), (at(240), 5), (None, 6)], schema), 1)
    assert [(r.kept, r.late, r.untimed) for r in gate.report().orderBy("batch_id").collect()] == [(3, 0, 1), (2, 1, 1)]
    assert [r.v for r in gate.late(schema).collect()] == [4]
    gate.write(spark.createDataFrame([], schema), 2)
    assert gate.watermark(3) == at(240)


def test_a_replayed_batch_of_assessments_changes_nothing(spark, folder):
    events = read_table(spark, folder, "events").limit(300).persist()
    table = SnapshotTable(spark, fresh_path(spark, "assessed"), ASSESSED, ["query_id"])
    write = upsert_batches(table, plans.assessed_events(spark, folder))
    first, second = events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")
    write(first, 0)
    write(second, 1)
    before = sorted(map(str, table.read().collect()))
    for batch, number in ((second, 1), (first, 0)):
        write(batch, number)
    assert sorted(map(str, table.read().collect())) == before and len(before) == events.count()
    # an event that is delivered again in a later batch is assessed again, under the same key
    write(first, 2)
    assert sorted(map(str, table.read().collect())) == before
    # an empty batch is a version as well
    write(events.limit(0), 3)
    assert table.versions() == [0, 1, 2, 3] and table.read().count() == len(before)
    events.unpersist()


@pytest.mark.parametrize("parts", [0, 1, 3])
def test_a_streamed_table_may_be_a_file_or_a_folder(spark, tmp_path, parts):
    """0 parts: a single file beside another table; else a folder of part files."""
    folder = tmp_path / "in"
    frame = spark.createDataFrame([(i, "view") for i in range(6)], "event_id long, event_type string")
    if parts:
        frame.repartition(parts).write.parquet(f"{folder}/events.parquet")
    else:
        frame.coalesce(1).write.parquet(f"{tmp_path}/one")
        folder.mkdir()
        next((tmp_path / "one").glob("part-*.parquet")).rename(folder / "events.parquet")
    spark.range(3).write.parquet(f"{folder}/other.parquet")
    out = f"{tmp_path}/out"
    run_to_end(read_events(spark, str(folder)), out)
    assert sorted(r.event_id for r in spark.read.parquet(f"{out}/rows").collect()) == [*range(6)]
