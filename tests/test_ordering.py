"""Ranks, rolling means and percentiles against plain Python, with one dominant key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscope.operators import ordering as O


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(("hot" if rng.random() < 0.6 else rng.choice("abc")), i, float(rng.randrange(50))) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, i long, v double").repartition(5)


def test_rank_within(skewed):
    rows, df = skewed
    got = {(r.k, r.i): r.rank for r in O.rank_within(df, ["k"], [F.col("v"), F.col("i")]).collect()}
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        assert [got[(r[0], r[1])] for r in ordered] == list(range(1, len(ordered) + 1))


def test_rank_without_keys(skewed):
    rows, df = skewed
    got = sorted((r.i, r.rank) for r in O.rank_within(df, [], [F.col("i")]).collect())
    assert got == [(i, i + 1) for i in range(len(rows))]


@pytest.mark.parametrize("block", [10, 100_000])
def test_rolling_last_n(skewed, block):
    rows, df = skewed
    out = O.rolling_last_n(df, ["k"], ["i"], "v", 10, "mean", block=block)
    got = {(r.k, r.i): r["mean"] for r in out.collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for n, r in enumerate(own):
            window = [x[2] for x in own[max(0, n - 9): n + 1]]
            assert got[(r[0], r[1])] == pytest.approx(sum(window) / len(window))


def percentiles(spark, rows, cells):
    """Percentiles by key of (key, value) rows, after a check of all keys and counts."""
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    counts = O.value_counts(df, ["k"], "v").persist()
    probabilities = [i / 10 for i in range(11)] + [0.123, 0.999]
    out = O.percentiles_of_counts(counts, ["k"], "v", probabilities, cells=cells, ordered=cells).collect()
    assert {r.k for r in out} == {k for k, v in rows if v is not None}
    for r in out:
        values = [v for k, v in rows if k == r.k and v is not None]
        assert r.sample_count == len(values)
        yield r.percentiles, list(np.percentile(values, [100 * p for p in probabilities]))


@pytest.mark.parametrize("cells", [4096, 16])
def test_percentiles_at_every_depth_of_refinement(spark, skewed, cells):
    rows = [(k, v + i / 7) for k, i, v in skewed[0]] + [(None, 1.0), (None, 4.0), ("one", 2.5), ("none", None)]
    for got, want in percentiles(spark, rows, cells):
        assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("cells", [4096, 8])
def test_percentiles_of_masses_of_equal_values(spark, cells):
    rows = [("hot", 7.0)] * 2000 + [("hot", float(i)) for i in range(100)] + [("same", -1.5)] * 50
    for got, want in percentiles(spark, rows, cells):
        assert got == pytest.approx(want, rel=1e-12)


def test_percentiles_of_values_of_all_magnitudes(spark):
    rng = random.Random(3)
    rows = [("spread", rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300)) for _ in range(400)]
    rows += [("ends", x) for x in (-1.7e308, 1.7e308, 0.0, 1.0, -1.0) for _ in range(9)]
    for got, want in percentiles(spark, rows, 150):
        assert got == pytest.approx(want, rel=1e-6, abs=0)


def test_percentiles_with_values_that_are_no_numbers(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("k", float(i)) for i in range(40)] + [("k", inf), ("k", -inf), ("k", nan)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = O.percentiles_of_counts(O.value_counts(df, ["k"], "v"), ["k"], "v", [0.0, 0.5, 41 / 42], cells=8, ordered=8).first()
    assert out.sample_count == 43 and out.percentiles[:2] == [-inf, 20.0] and out.percentiles[2] == inf


def test_percentiles_of_nothing(spark):
    counts = O.value_counts(spark.createDataFrame([], "k string, v double"), ["k"], "v")
    assert O.percentiles_of_counts(counts, ["k"], "v", [0.5]).count() == 0


def test_first_and_latest(skewed):
    rows, df = skewed
    first = {r.k: r.i for r in O.first_per_key(df, ["k"], ["v", "i"]).collect()}
    last = {r.k: r.i for r in O.latest_per_key(df, ["k"], ["i"]).collect()}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        assert first[key] == min(own, key=lambda r: (r[2], r[1]))[1]
        assert last[key] == max(r[1] for r in own)
