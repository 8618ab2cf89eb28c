import pytest

from veriscope.session import shared_dir
from veriscope.sources.snapshots import SnapshotTable, upsert_batches
from veriscope.streaming.runs import fresh_path

SCHEMA = "k long, name string, v double"


def table(spark, name, **options):
    return SnapshotTable(spark, fresh_path(spark, name), SCHEMA, ["k"], **{"buckets": 3, "chain": 2, **options})


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def content(df):
    return sorted(tuple(r) for r in df.collect())


def test_upserts_replace_equal_keys_over_many_versions(spark):
    t, want = table(spark, "upserts"), {}
    for version in range(7):  # longer than the chain, so buckets are merged on the way
        new = [(k, f"n{version}", float(version)) for k in range(version, 20, version + 1)]
        assert t.upsert(rows(spark, *new), version)
        want |= {k: (k, n, v) for k, n, v in new}
        assert content(t.read()) == sorted(want.values())
        assert max(map(len, t._manifest(version).values())) <= t.chain
    assert t.versions() == list(range(7))


def test_a_replayed_version_changes_nothing(spark):
    t = table(spark, "replay")
    t.upsert(rows(spark, (1, "a", 1.0)), 0)
    before = content(t.read())
    assert not t.upsert(rows(spark, (1, "b", 2.0), (2, "c", 3.0)), 0)
    assert content(t.read()) == before and t.versions() == [0]
    with pytest.raises(ValueError, match="older"):
        t.upsert(rows(spark, (1, "b", 2.0)), 3) and t.upsert(rows(spark, (1, "b", 2.0)), 2)


def test_an_unfinished_version_is_invisible_and_started_over(spark):
    t = table(spark, "crash")
    t.upsert(rows(spark, (1, "a", 1.0), (2, "b", 2.0)), 0)
    # a writer that got as far as its data, but not to the manifest
    rows(spark, (1, "half", 9.0)).selectExpr("*", "1L AS _version", "1 AS bucket").write.partitionBy("bucket").parquet(f"{t.path}/data/v=1")
    assert t.versions() == [0] and content(t.read()) == [(1, "a", 1.0), (2, "b", 2.0)]
    assert t.upsert(rows(spark, (2, "c", 3.0)), 1)
    assert content(t.read()) == [(1, "a", 1.0), (2, "c", 3.0)]


def test_readers_stay_with_their_version(spark):
    t = table(spark, "readers")
    t.replace(rows(spark, (1, "a", 1.0), (2, "b", 2.0)), 0)
    bound = t.read(0)
    t.replace(rows(spark, (3, "c", 3.0)), 1)
    assert content(bound) == [(1, "a", 1.0), (2, "b", 2.0)] and content(t.read()) == [(3, "c", 3.0)]
    assert content(t.read(0)) == content(bound)
    with pytest.raises(ValueError, match="does not exist"):
        t.read(7)


def test_empty(spark):
    t = table(spark, "empty")
    assert content(t.read()) == [] and t.read().columns == ["k", "name", "v"]
    t.upsert(rows(spark), 0)
    assert t.versions() == [0] and content(t.read()) == []
    t.upsert(rows(spark, (None, "no key", 1.0)), 1)
    t.upsert(rows(spark), 2)
    assert content(t.read()) == [(None, "no key", 1.0)]


def test_batches_are_written_once(spark):
    t, seen = table(spark, "batches"), []

    def shape(batch):
        seen.append(1)
        return batch

    write = upsert_batches(t, shape)
    for _ in range(2):
        write(rows(spark, (1, "a", 1.0)), 0)
    assert len(seen) == 1 and content(t.read()) == [(1, "a", 1.0)]
    assert t.path.startswith(shared_dir(spark))
