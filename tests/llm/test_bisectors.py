import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veriscope.llm.bisectors import Bisectors, cluster

SCHEMA = "vec_id long, embedding array<float>, cluster string, v string"


def plain(rows, k, rounds, scale, dims):
    """Plain Lloyd rounds in Python integers; rows are (key, vector)."""
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, v, [math.floor(Fraction(x) * Fraction(scale)) for x in v]))
    rank = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [q for _, _, q in sorted(kept, key=rank)[:k]]
    for last in [False] * rounds + [True]:
        found = [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), i) for i, c in enumerate(centroids)) for _, _, q in kept]
        if last:
            break
        for i in range(len(centroids)):
            mine = [q for (_, _, q), (_, n) in zip(kept, found, strict=True) if n == i]
            if mine:
                centroids[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for (key, _, _), (d, n) in zip(kept, found, strict=True):
        own = sum(e for e, m in found if m == n)
        digest = hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()
        out.append((key, n, d, own, sum(e for e, _ in found), digest))
    return sorted(out, key=str), centroids


def run(spark, rows, k=3, rounds=2, scale=64.0, dims=2):
    frame = spark.createDataFrame([(key, v, "x", "y") for key, v in rows], SCHEMA)
    found, centroids = cluster(frame, k=k, rounds=rounds, scale=scale, dims=dims)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str), centroids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-5, 5), min_size=3, max_size=3), min_size=1, max_size=9),
       st.lists(st.lists(st.integers(-5, 5) | st.integers(-(10**22), 10**22), min_size=3, max_size=3), min_size=1, max_size=9))
def test_tournament_finds_the_nearest_and_keeps_the_smaller_number(centroids, points):
    x = np.empty((len(points), 3), dtype=object)
    x[:] = points
    number, distance = Bisectors(centroids).nearest(x)
    want = [min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), i) for i, c in enumerate(centroids)) for p in points]
    assert [(int(d), int(n)) for n, d in zip(number, distance, strict=True)] == want


def test_rows_equal_plain_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=2) + 3 * (i % 4)]) for i in range(120)]
    got, centroids = run(spark, rows, k=5, rounds=3)
    want, wanted = plain(rows, 5, 3, 64.0, 2)
    assert got == want and centroids == wanted


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 1.5]), (1, [0.5, 1.5]), (1, [-2.0, 8.0]), (2, [0.5, 1.5]), (None, [3.0, 3.0]), (None, None), (3, None), (4, []),
        (5, [1.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [-inf, 1.0]), (11, [1e6, -1e6]),
        (12, [-0.001, -0.0]),
    ]
    got, centroids = run(spark, rows)
    want, wanted = plain(rows, 3, 2, 64.0, 2)
    assert got == want and centroids == wanted and len(got) == 7


def test_equal_vectors_and_fewer_rows_than_centroids(spark):
    got, centroids = run(spark, [(i, [1.0, 1.0]) for i in range(40)])
    assert {r[1:4] for r in got} == {(0, 0, 0)} and centroids == [[64, 64]] * 3
    got, centroids = run(spark, [(1, [1.0, 1.0])])
    assert len(got) == 1 and len(centroids) == 1


def test_empty_table(spark):
    assert run(spark, []) == ([], [])
    assert run(spark, [(1, None)]) == ([], [])


def test_sums_beyond_64_bits_are_exact(spark):
    big = float(np.float32(2.0**24))
    rows = [(i, [big + 2.0 * (i % 3), -big]) for i in range(30)]
    got, _ = run(spark, rows, scale=2.0**6)
    assert got == plain(rows, 3, 2, 2.0**6, 2)[0]


def test_distance_beyond_64_bits_is_an_error(spark):
    with pytest.raises(Exception, match="beyond 64 bits"):
        run(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 0.0])], k=1, rounds=0)
