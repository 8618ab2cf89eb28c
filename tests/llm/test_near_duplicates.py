import random

import numpy as np

from llm.brute import near_duplicates as brute
from llm.brute import rows
from veriscope.llm import near_duplicates as nd
from veriscope.llm.components import components


def result(spark, docs, **options):
    df = spark.createDataFrame([(i, k, t, "x") for i, (k, t) in enumerate(docs)], "at int, doc_id long, text string, component_id string")
    got = nd.near_duplicates(df, keep=("at",), **options).collect()
    assert len(got) == len(docs)
    return {r.at: r for r in got}


def test_equals_brute_force_on_the_documents(spark, small):
    docs = rows(small, "SELECT doc_id, text FROM documents ORDER BY doc_id")
    want = brute(docs, 2, 80)
    got = {r.doc_id: r for r in nd.op6_near_duplicates(spark, small).collect()}
    assert {d: (got[d].n_shingles, got[d].component_id) for d, _ in docs} == {docs[i][0]: w for i, w in want.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_chains_of_near_copies_keep_every_link(spark):
    """Groups whose members are linked over others only: pivots alone would lose links."""
    rnd = random.Random(5)
    docs = []
    for g in range(6):
        base = [f"w{g}x{rnd.randrange(10**6)}" for _ in range(60)]
        for _ in range(40):
            words = list(base)
            for _ in range(rnd.randrange(0, 8)):
                words[rnd.randrange(60)] = f"n{rnd.randrange(10**6)}"
            docs.append((rnd.randrange(10**9), " ".join(words)))
            base = words if rnd.random() < 0.3 else base
    want = brute(docs, 2, 80)
    got = result(spark, docs, width=2)
    assert {i: got[i].component_id for i in got} == {i: w[1] for i, w in want.items()}


def test_defined_results_for_odd_rows(spark):
    text = "one two three four five six"
    docs = [(1, None), (2, ""), (3, " \n\t"), (None, text), (5, text.upper()), (5, text), (7, "one"), (8, "ONE"), (9, "one two"), (None, None)]
    got = result(spark, docs, width=5)
    assert [got[i].component_id for i in range(10)] == [1, 2, 3, 5, 5, 5, 7, 7, 9, None]
    assert [got[i].n_shingles for i in range(10)] == [0, 0, 0, 2, 2, 2, 1, 1, 1, 0]
    assert [got[i].kept for i in range(10)] == [True, True, True, False, True, True, True, False, True, True]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(df).count() == 0


def test_signature_estimates_similarity_and_is_order_free():
    rnd = np.random.default_rng(3)
    pool = rnd.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.sort(pool[:300]), np.sort(pool[100:])
    sig = nd.super_minhash([a, b, a])
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.1 and (sig[0] == sig[2]).all()
    alone = nd.super_minhash([b])
    assert (alone[0] == sig[1]).all()
    one = nd.super_minhash([pool[:1]])
    assert sorted((one[0] >> np.uint64(48)).tolist()) == list(range(nd.SLOTS))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (5, 5), (1, 2)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_columns_with_names_of_the_operator(spark):
    names = ("n_shingles", "node", "bands", "key", "id", "band", "root", "least_key", "kept", "m_node")
    df = spark.createDataFrame([(i, "a b c d e f g", *[f"{n}{i}" for n in names]) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = nd.near_duplicates(df, width=2, percent=80, keep=names, identity="root2")
    assert got.columns == ["doc_id", *[n for n in names if n not in ("n_shingles", "kept")], "n_shingles", "component_id", "kept", "root2"]
    assert [(r.doc_id, r.node, r.n_shingles, r.component_id) for r in got.orderBy("doc_id").collect()] == [(i, f"node{i}", 6, 0) for i in range(3)]


def test_small_sets_share_a_bucket_for_certain():
    rng = np.random.default_rng(4)
    for percent in (80, 60):
        for _ in range(3000):
            n = int(rng.integers(1, 16))
            both = rng.integers(0, 1 << 62, size=n, dtype=np.uint64)
            a = np.unique(both)
            b = np.unique(np.concatenate([both[int(rng.integers(0, 3)):], rng.integers(0, 1 << 62, size=int(rng.integers(0, 4)), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common):
                assert set(nd.prefix_bands(a, percent)) & set(nd.prefix_bands(b, percent))


def test_one_rare_shingle_in_many_unlinked_texts(spark):
    texts = [f"odd pair {' '.join(f'w{i}x{j}' for j in range(30))}" for i in range(1500)]
    got = nd.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=2, percent=80)
    assert got.filter("kept").count() == len(texts)
