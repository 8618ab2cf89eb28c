import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.brute import measures
from veriscope.llm import bit_slices, mixing, quality_ledger, url_rules
from veriscope.llm.shared import word_count


def test_urls(spark):
    rules = spark.createDataFrame(
        [("org", "/", "allow"), ("a.org", "/x", "block"), ("a.org", "/x", "allow"), ("net", "", "block"), ("", "/", "block"), (None, "/", "block")],
        "host string, path string, verdict string",
    )
    urls = ["http://B.A.ORG/xy?q#f", None, "a.org/x", "http://corg/", "http://x.net", "ftp://org", "http://a.org/xé", "http://x.org://a.org/x", ""]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)] + [(0, urls[0], "mine")], "page_id int, url string, rule string")
    got = url_rules.filter_urls(pages, rules, default="allow").collect()
    by_id = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(urls) + 1
    assert by_id[0] == ("b.a.org", "/xy", "a.org/x", "block") and by_id[6][2] == "a.org/x"
    assert by_id[1] == by_id[2] == by_id[8] == ("", "", None, "allow")
    assert by_id[3] == ("corg", "/", None, "allow") and by_id[4] == ("x.net", "", "net", "block") and by_id[5] == ("org", "", None, "allow")
    assert by_id[7] == ("x.org:", "//a.org/x", None, "allow")
    assert {r.verdict for r in url_rules.filter_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert url_rules.filter_urls(pages.limit(0), rules).count() == 0


def test_mix(spark):
    rnd = random.Random(2)
    docs = [(i, "w " * rnd.randrange(0, 60), f"s{i % 4}" if i % 5 else None) for i in range(400)] + [(7, "w w", "s3")] * 3 + [(None, None, None)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int")
    weights = spark.createDataFrame([("s0", 90.0), ("s1", 1.0), ("s2", 0.0), (None, 2.0)], "source string, weight double")
    for cut, rows in ((True, 50_000), (True, 10), (False, 10)):
        got = mixing.mix(df, weights, size=word_count(F.col("text")), cut=cut, bucket_rows=rows).collect()
        assert len(got) == len(docs)
        total, by = sum(r.size for r in got), {}
        for r in got:
            by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
            assert r.taken <= 3 * r.size and r.source_size >= r.size
        assert by["s2"][0] == by["s3"][0] == 0 and abs(sum(b[0] for b in by.values()) - total) < 1e-6 * total
        assert by["s0"][0] == 3 * by["s0"][1]
        assert all(abs(b[2] - b[0]) <= (3 if cut else 60) for b in by.values())
    assert mixing.mix(df.limit(0), weights, size=word_count(F.col("text"))).count() == 0


def test_water_filling_equals_the_repeated_reshare(spark):
    rnd = random.Random(4)
    for _ in range(4):
        rows = [(f"s{i}", rnd.randrange(0, 1000), float(rnd.choice([0, 1, 2, 5]))) for i in range(9)]
        total = sum(s for _, s, _ in rows)
        live, target, left = {n: (s, w) for n, s, w in rows if s and w}, dict.fromkeys([r[0] for r in rows], 0.0), float(total)
        while live:
            share = {n: left * w / sum(w for _, w in live.values()) for n, (_, w) in live.items()}
            full = [n for n in live if share[n] >= 3 * live[n][0]]
            if not full:
                target.update(share)
                break
            for n in full:
                target[n] = 3.0 * live.pop(n)[0]
                left -= target[n]
        df = spark.createDataFrame(rows, "source string, source_size long, weight double")
        got = {r.source: r.target for r in mixing.water_fill(df, F.lit(float(total)), 3.0).collect()}
        assert all(abs(got[n] - t) < 1e-6 * max(total, 1) for n, t in target.items())


def test_ledger(spark):
    texts = [None, "", " \n\t", "a b c a b c", "x | y\nx | y\n\n", "é" * 50_000, "w " * 20_000, "A B C " * 30, "\x1cq\x1c r"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] * 2, "doc_id int, text string, bits int")
    got = quality_ledger.ledger(df).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(texts[r.doc_id])
        assert r.bits & 1 and bool(r.bits & 2) == (2 * r.n_repeat_words > r.n_words) if r.n_words < 50 else not r.bits & 1
    wins = {r.rule: r for r in quality_ledger.ablations(quality_ledger.ledger(df), 2).collect()}
    m = quality_ledger.mask(quality_ledger.POLICIES[2])
    for name, r in wins.items():
        bit = quality_ledger.mask((name,))
        assert r.failed == sum(bool(x.bits & bit) for x in got) and r.failed_alone == sum(x.bits & m == bit for x in got)
        assert r.kept == sum(not x.bits & m & ~bit for x in got)
    assert [r.failed for r in quality_ledger.ablations(quality_ledger.ledger(df.limit(0)), 1).collect()] == [0, 0]


def test_bit_slices(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 420)]
    vectors += [(500, None), (501, []), (502, [1.0, None]), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (506, [2.0, 1.0]), (None, [1.0] * 8), (400, [1.0] * 8)]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<double>, score int")
    rows = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in vectors if i is not None and i not in range(500, 506)]
    for block in (64, 65_536):
        got = {}
        for r in bit_slices.top_k(df, F.col("vec_id") % 50 == 0, 5, block_rows=block, batch_queries=2).collect():
            got.setdefault(r.query_id, {})[r.rank] = (-r.score, r.vec_id)
        queries = {i: q for i, q in rows if i % 50 == 0}
        assert set(got) == set(queries)
        for i, q in queries.items():
            want = sorted((-int(q @ v), j) for j, v in rows if j != i and len(v) == len(q))[:5]
            assert [got[i][k] for k in sorted(got[i])] == want
    assert bit_slices.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bit_slices_keep_every_finite_vector(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=16).round(2).tolist()) for i in range(200)]
    for at, (i, x) in enumerate([(10, 1e6), (50, -3e6), (77, 2.7e5), (100, 1e12), (120, -4e13), (150, 3.6e16), (160, -3.6e16)]):
        vectors[i][1][at % 3] = x
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    exact = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors]
    for block in (64, 65_536):
        got = {}
        for r in bit_slices.top_k(df, F.col("vec_id") % 10 == 0, 5, block_rows=block, batch_queries=3).collect():
            got.setdefault(r.query_id, {})[r.rank] = (-int(r.score), r.vec_id)
        for i, q in exact[::10]:
            want = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in exact if j != i)[:5]
            assert [got[i][k] for k in sorted(got[i])] == want


def test_mix_takes_a_repetition_that_a_target_rounds_up_to(spark):
    docs = [(1, "w", "s"), *[(i, "w", "t") for i in range(2, 6)], (6, "", "s"), (7, "w", "t")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for weight, want in ((0.45, {"s": 3, "t": 3}), (0.15, {"s": 1, "t": 5})):  # targets 2.7 and 3.3, 0.9 and 5.1
        weights = spark.createDataFrame([("s", weight), ("t", 1 - weight)], "source string, weight double")
        for cut in (True, False):
            got = {"s": 0, "t": 0}
            for r in mixing.mix(df, weights, size=word_count(F.col("text")), cut=cut).collect():
                got[r.source] += r.taken
            assert got == want


def test_urls_are_cut_between_host_and_path(spark):
    pages = spark.createDataFrame([(1, "http://orgabc/x", "a", "b", "c"), (2, "http://orgabc", "a", "b", "c"), (3, "http://x.org/abcd", "a", "b", "c")],
                                  "page_id int, url string, best string, u_host string, u_path string")
    rules = spark.createDataFrame([("org", "abc", "block"), ("com", "", "allow"), ("org", "/abc", "block")], "host string, path string, verdict string")
    got = url_rules.filter_urls(pages, rules).orderBy("page_id").collect()
    assert [(r.verdict, r.rule, r.best, r.u_host, r.u_path) for r in got] == [
        ("allow", None, "a", "b", "c"), ("allow", None, "a", "b", "c"), ("block", "org/abc", "a", "b", "c")]


def test_components_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        bit_slices.top_k(df, F.lit(True), 1).collect()
