from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from veriscope.operators.baskets import frequent_pairs


def plain(rows, least):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    single = Counter(i for s in baskets.values() for i in s)
    pairs = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    return {(*p, n, single[p[0]], single[p[1]]) for p, n in pairs.items() if n >= least}


def run(spark, rows, least, **options):
    frame = spark.createDataFrame([(b, i, "x") for b, i in rows], "basket long, item long, other string")
    return frequent_pairs(frame, F.col("basket"), F.col("item"), min_support=least, **options)


@pytest.mark.parametrize("block, cells", [(256, 1 << 20), (2, 1 << 20), (3, 5)])
def test_every_frequent_pair_with_its_counts(spark, block, cells):
    rows = [(b, (b * k + k * k) % 17) for b in range(40) for k in range(2 + b % 9)]
    rows += [(1, 3), (1, 3), (None, 4), (5, None), (None, None)]
    for least in (1, 2, 5):
        got = [tuple(r) for r in run(spark, rows, least, block=block, cells=cells).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows, least)


def test_an_order_of_ten_thousand_lines(spark):
    rows = [(1, i) for i in range(10_000)] + [(2, i * 40) for i in range(250)] + [(3, i * 80) for i in range(125)]
    got = [tuple(r) for r in run(spark, rows, 2, block=32).collect()]
    want = {(a * 40, b * 40, 2 + (a % 2 == b % 2 == 0), 2 + (a % 2 == 0), 2 + (b % 2 == 0)) for a, b in combinations(range(250), 2)}
    assert len(got) == len(want) and set(got) == want


def test_long_orders_alike(spark):
    # two equal orders of 1,500 lines: every pair is frequent, over many units
    rows = [(b, i) for b in (1, 2) for i in range(1500)]
    found = run(spark, rows, 2)
    assert found.count() == 1500 * 1499 // 2
    assert found.filter("orders <> 2 OR part >= other").isEmpty()


def test_empty(spark):
    assert run(spark, [], 1).count() == 0
    assert run(spark, [(1, 1), (2, 1)], 1).count() == 0
