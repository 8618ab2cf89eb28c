"""Bit slices over many blocks and query batches: exact results, no copies of the index, blocks of a bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from veriscope.llm import bit_slices

DIMS, K = 8, 5


def test_blocks_meet_batches_without_copies(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=DIMS).round(2).tolist()) for i in range(300)] + [(i, [-1.0, 1.0] * 4) for i in range(300, 500)]
    vectors += [(7, [0.5] * DIMS), (7, [0.25] * DIMS), (None, [9.0] * DIMS), (501, None)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    monkeypatch.setattr(bit_slices, "BLOCK_VALUES", 100 * DIMS, raising=False)
    monkeypatch.setattr(bit_slices, "BATCH_VALUES", 16 * DIMS, raising=False)
    stored, plans, staged = {}, [], bit_slices.staged

    def seen(rows, name, *more):
        plans.append(rows._jdf.queryExecution().toString())
        stored[name] = staged(rows, name, *more)
        return stored[name]

    monkeypatch.setattr(bit_slices, "staged", seen)
    found = bit_slices.top_k(df, F.col("vec_id") % 2 == 1, K, batch_queries=4)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.rank] = (-int(r.score), r.vec_id)

    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if i is not None and v]
    asked = {i: min(v for j, v in whole if j == i) for i, _ in whole if i % 2}
    assert set(got) == set(asked)
    for i, q in asked.items():
        want = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i)[:K]
        assert [got[i][rank] for rank in range(1, K + 1)] == want

    plans.append(found._jdf.queryExecution().toString())
    assert not any("Generate" in plan or "CoGroup" in plan for plan in plans)  # blocks made anew for each batch of queries
    blocks = stored["slices"].select(F.length("ids") / 8 * F.col("dims")).collect()
    assert len(blocks) >= 5 and all(size <= 2 * 100 * DIMS for size, in blocks)
