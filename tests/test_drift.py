"""Question drift and result drift on hand-made frames."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriscope.functions import psi as P
from veriscope.functions import vectors as V
from veriscope.operators import drift as D
from veriscope.operators import matching as M
from veriscope.operators import result_drift as R

VECTORS = "query_id long, agent_type string, embedding array<float>"


def test_centroid_drops_zero_vectors_but_counts_them(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "a", [0.0, 0.0]), (4, "z", [0.0, 0.0])]
    out = D.centroids(spark.createDataFrame(rows, VECTORS)).collect()
    assert [(r.agent_type, r.centroid, r.num_queries) for r in out] == [("a", [0.5, 0.5], 3)]


def test_drift_classes_and_skip_states(spark):
    base = spark.createDataFrame([("a", [1.0, 0.0])], "agent_type string, centroid array<double>")
    rows = [
        (1, "a", [1.0, 0.0]), (2, "a", [0.6, 0.8]), (3, "a", [0.0, 1.0]), (4, "a", [0.0, 0.0]),
        (5, "b", [1.0, 0.0]), (6, "a", [1.0, 0.0, 0.0]), (7, "b", [0.0, 0.0]), (8, "a", [-1.0, 0.0]),
    ]
    out = {r.query_id: r for r in D.score_drift(spark.createDataFrame(rows, VECTORS), base).collect()}
    kinds = {k: r.drift_classification for k, r in out.items()}
    assert kinds == {
        1: "normal", 2: "medium", 3: "high", 4: "embedding_failed", 5: "no_baseline",
        6: "dimension_mismatch", 7: "embedding_failed", 8: "high",
    }
    assert {k for k, r in out.items() if r.stored} == {1, 2, 3, 8}
    assert out[8].drift_score == pytest.approx(2.0) and out[8].is_anomaly
    assert all(out[k].drift_score == 0 and not out[k].is_anomaly for k in (4, 5, 6, 7))


def test_class_edges(spark):
    rows = [(0.7,), (0.69999,), (0.5,), (0.49999,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s double").select(D.drift_class(F.col("s"))).collect()]
    assert got == ["normal", "medium", "medium", "high"]


def test_quality_of_missing_drift(spark):
    got = [r[0] for r in spark.createDataFrame([(0.2,), (1.5,), (None,)], "s double").select(D.drift_quality(F.col("s"))).collect()]
    assert got == pytest.approx([0.8, 0.0, 0.5])


def test_cosine_bounds(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.normal(size=5).tolist(), rng.normal(size=5).tolist()) for _ in range(50)] + [([], []), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    for (a, b), r in zip(rows, df.select(V.cosine("a", "b").alias("c")).collect()):
        want = float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) if a and b else 0.0
        assert r.c == pytest.approx(want) and -1 - 1e-9 <= r.c <= 1 + 1e-9


def _baseline(spark, values):
    rows = [("a", "m", float(v)) for v in values]
    return R.psi_baseline(spark.createDataFrame(rows, "agent_type string, column_name string, value double"))


def _psi(spark, values, baseline):
    rows = [(1, "a", "m", float(v)) for v in values]
    df = spark.createDataFrame(rows, "query_id long, agent_type string, column_name string, value double")
    return R.column_psi(df, baseline).collect()


@pytest.mark.parametrize("values", [range(19), [5] * 40])
def test_no_baseline_for_few_or_constant_values(spark, values):
    assert _baseline(spark, values).collect() == []


def _reference_psi(expected, actual):
    return sum((max(a, 1e-4) - max(e, 1e-4)) * math.log(max(a, 1e-4) / max(e, 1e-4)) for e, a in zip(expected, actual))


def test_psi_of_itself_is_zero_and_out_of_range_is_uniform(spark):
    base = _baseline(spark, range(20))
    row = base.first()
    assert len(row.expected_pct) == 10 and sum(row.expected_pct) == pytest.approx(1)
    assert _psi(spark, range(20), base)[0].psi == pytest.approx(0, abs=1e-4)
    uniform = _psi(spark, [1000] * 5, base)[0].psi
    assert uniform == pytest.approx(round(_reference_psi(row.expected_pct, [0.1] * 10), 4), abs=1e-4)
    # values outside the edges do not count in the denominator either
    partial = _psi(spark, [0, 0, 1000], base)[0].psi
    assert partial == pytest.approx(_reference_psi(row.expected_pct, [1.0] + [0.0] * 9), abs=1e-3)


def test_last_edge_is_inside_the_last_bucket(spark):
    edges = F.array(*[F.lit(x) for x in (0.0, 1.0, 2.0)])
    rows = [(v,) for v in (-0.1, 0.0, 0.9, 1.0, 2.0, 2.1)]
    got = [r[0] for r in spark.createDataFrame(rows, "v double").select(P.bucket_of(F.col("v"), edges)).collect()]
    assert got == [-1, 0, 0, 1, 1, -1]


def test_long_edge_arrays_need_their_length(spark):
    edges = F.array(*[F.lit(float(x)) for x in range(21)])
    df = spark.createDataFrame([(10.5,), (15.5,), (20.0,), (20.5,)], "v double")
    assert [r[0] for r in df.select(P.bucket_of(F.col("v"), edges, 20)).collect()] == [10, 15, 19, -1]
    with pytest.raises(Exception, match="more than 10 buckets"):
        df.select(P.bucket_of(F.col("v"), edges)).collect()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=25, max_size=60), st.lists(st.integers(-60, 60), min_size=1, max_size=30))
def test_psi_is_never_negative(spark, base_values, values):
    base = _baseline(spark, base_values)
    assert all(r.psi >= 0 for r in _psi(spark, values, base))


def test_metric_names(spark):
    names = ["revenue", "Status", "order_id", "created_at", "unit_code", "codes", " Name "]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", P.is_metric_column(F.col("n")).alias("m"))
    assert {r.n: r.m for r in df.collect()} == {n: P.is_metric_name(n) for n in names}
    assert [n for n in names if P.is_metric_name(n)] == ["revenue", "codes"]


@pytest.mark.parametrize("block_bytes", [2**24, 1024])
def test_ground_truth_match_in_blocks(spark, block_bytes):
    """One block or many give the rows of a brute force search, also below the threshold."""
    rng = np.random.default_rng(5)
    gt = rng.normal(size=(60, 6))
    asked = np.concatenate([gt[:30] + rng.normal(scale=0.3, size=(30, 6)), rng.normal(size=(20, 6)), gt[:1]])
    entries = spark.createDataFrame(
        [(i, f"entry {i}" + (" above 5" if i < 3 else ""), v.tolist()) for i, v in enumerate(gt)],
        "position long, gt_text string, gt_embedding array<double>")
    questions = spark.createDataFrame(
        [(i, "rows below 5" if i == 1 else "rows", v.tolist()) for i, v in enumerate(asked)],
        "query_id long, query_text string, embedding array<double>")
    got = {r.query_id: r for r in M.match_ground_truth(questions, entries, block_bytes=block_bytes).collect()}
    cos = (asked @ gt.T) / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(gt, axis=1)[None, :]
    assert len(got) == len(asked)
    for q in range(len(asked)):
        best = cos[q].max()
        assert got[q].position == cos[q].argmax() and got[q].match_score == pytest.approx(best)
        if best >= 0.7:
            clash = q == 1 and got[q].position < 3
            assert got[q].is_match == (not clash) and got[q].trusted == (best >= 0.8 and not clash)
        else:
            assert not got[q].is_match


@pytest.mark.parametrize("block_bytes", [2**24, 32])
def test_ground_truth_odd_vectors(spark, block_bytes):
    """Ties go to the first entry; null, empty and non-finite vectors take no part; a zero vector scores 0."""
    entries = spark.createDataFrame(
        [(4, [1.0, 1.0]), (2, [2.0, 2.0]), (7, [1.0, None]), (8, None), (1, [0.0, -1.0]), (9, [1.0, 0.0, 0.0])],
        "position long, gt_embedding array<double>")
    questions = spark.createDataFrame(
        [(1, [3.0, 3.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [1.0] * 4), (7, [5.0, 0.0, 0.0])],
        "query_id long, embedding array<double>")
    got = {r[0]: (r[1], round(r[2], 9)) for r in M.best_entries(questions, entries, block_bytes).collect()}
    assert got == {1: (2, 1.0), 2: (1, 0.0), 7: (9, 1.0)}
    assert M.best_entries(questions, entries.limit(0), block_bytes).count() == 0


def test_stream_uses_the_baseline_of_the_moment(spark, tmp_path):
    """A baseline replaced between two batches is used from the second batch on."""
    from veriscope.streaming.telemetry import scoring_batch

    table, out = str(tmp_path / "baseline"), str(tmp_path / "out")
    schema = "query_id long, agent_type string, embedding array<float>, status string, query_text string, generated_sql string, error string, created_at timestamp_ntz"
    batch = spark.createDataFrame([(1, "a", [1.0, 0.0], "success", "q", "SELECT 1", None, None)], schema)
    write = scoring_batch(out, [], [], lambda s: s.read.parquet(table))
    for batch_id, centroid in enumerate(([1.0, 0.0], [0.0, 1.0])):
        spark.createDataFrame([("a", centroid)], "agent_type string, centroid array<double>").write.mode("overwrite").parquet(table)
        write(batch, batch_id)
        write(batch, batch_id)  # a repeated batch replaces its rows
    got = {r.batch_id: r.drift_classification for r in spark.read.parquet(f"{out}/drift").collect()}
    assert got == {0: "normal", 1: "high"} and spark.read.parquet(f"{out}/drift").count() == 2


def test_wide_rows_give_the_same_psi_as_long_values(spark):
    rng = np.random.default_rng(8)
    values = [("a", "m", float(v)) for v in rng.normal(size=200)] + [("a", "k2", float(v)) for v in rng.integers(0, 4, 60)]
    values += [("b", "m", float(v)) for v in rng.normal(3, 2, 90)] + [("b", "row_id", float(v)) for v in range(50)]
    baseline = R.psi_baseline(spark.createDataFrame(values, "agent_type string, column_name string, value double"))
    some = lambda x: None if rng.random() < 0.2 else float(x)
    rows = [(int(i % 7), "ab?"[i % 3], some(rng.normal(1)), some(rng.integers(-1, 6)), some(i), None) for i in range(400)]
    rows += [(90, "a", None, None, None, None), (91, "a", float("nan"), 1e9, 1.0, None), (92, None, 1.0, 1.0, 1.0, 1.0)]
    shape = "query_id long, agent_type string, M double, k2 double, row_id double, other double"
    df = spark.createDataFrame(rows, shape)
    columns = ["M", "k2", "row_id", "other"]
    long = {tuple(r) for r in R.column_psi(R.to_long(df, ["query_id", "agent_type"], columns), baseline).collect()}
    wide = {tuple(r) for r in R.column_psi_of_rows(df, columns, baseline).collect()}
    assert wide == long and len(wide) > 20
    assert R.column_psi_of_rows(df.limit(0), columns, baseline).count() == 0
