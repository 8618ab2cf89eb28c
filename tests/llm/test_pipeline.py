import collections
import re

import corpus_pipeline as cp
from llm.brute import near_duplicates, rows
from veriscope.llm import secrets as sec


def _words(text):
    return set(re.findall(r"[^\W\d_]+", (text or "").lower()))


def _toxic_words(texts, toxic):
    """Words of several texts labelled toxic and of none labelled clean."""
    seen = {True: collections.Counter(), False: collections.Counter()}
    for d, t in toxic.items():
        seen[bool(t)].update(_words(texts[d]))
    return {w for w, n in seen[True].items() if n >= 2 and not seen[False][w]}


def test_stages_one_after_another(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    toxic = dict(rows(small, "SELECT doc_id, toxic FROM labels"))

    kept = spark.createDataFrame(cp.drop_toxic(spark, docs, small).collect(), docs.schema)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    told = _toxic_words(texts, toxic)
    silent = {d for d, t in toxic.items() if t and not told & _words(texts[d])}  # labelled, but nothing in the text says so
    missed = {d for d in ids if toxic.get(d)}
    assert kept.columns == columns and missed <= silent and len(missed) <= 1
    assert all(d in ids for d, t in toxic.items() if not t)

    unique = spark.createDataFrame(cp.one_of_each_group(spark, kept, small).collect(), docs.schema)
    pairs = [(r.doc_id, r.text) for r in kept.collect()]
    want = near_duplicates(pairs, 5, 80)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(k for i, (k, _) in enumerate(pairs) if want[i][1] == k)

    clean = spark.createDataFrame(cp.without_secrets(spark, unique, small).collect(), docs.schema)
    before = {r.doc_id: r.text for r in unique.collect()}
    for r in clean.collect():
        if not sec.scan(before[r.doc_id]):
            assert r.text == before[r.doc_id]
        else:
            assert r.text.count("<SECRET>") <= len(sec.scan(before[r.doc_id]))
    assert any("<SECRET>" in r.text for r in clean.collect())

    mixed = cp.mixed_sources(spark, clean, small)
    assert mixed.columns == columns
    words = lambda frame: collections.Counter()
    size, total = words(clean), words(mixed)
    for frame, out in ((clean, size), (mixed, total)):
        for r in frame.collect():
            out[r.source] += len(r.text.split())
    assert all(total[s] <= 3.2 * size[s] for s in total)
    assert abs(sum(total.values()) - sum(size.values())) < 0.1 * sum(size.values())


def test_odd_rows_through_all_stages(spark, small):
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    text = "one two three four five six seven"
    docs = [(1, text, "en", "a", 9), (2, text, "en", None, 9), (2, text, "en", None, 9), (None, text + " eight", None, "b", None),
            (5, None, None, None, None), (5, None, None, None, None), (6, "", "en", "a", 0), (7, "token=abcdefabcdef12", "en", "c", 20)]
    frame = spark.createDataFrame(docs, schema)
    for _, stage in cp.STAGES[:-1]:
        frame = spark.createDataFrame(stage(spark, frame, small).collect(), schema)
    assert all("abcdefabcdef12" not in (r.text or "") for r in frame.collect())
    assert cp.packed(spark, frame, small).count() > 0
    empty = spark.createDataFrame([], schema)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, small).count() == 0


def test_unrelated_texts_without_id_or_with_equal_ids_all_stay(spark, small):
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    docs = [(None, text(f"n{k}x"), "en", "a", 9) for k in range(5)]
    docs += [(3, text(f"t{k}x"), "en", "a", 9) for k in range(4)] + [(4, text("t0x") + " more", "en", "a", 9)]
    # near copies: of two without id one stays, of an id and none the id; repeated rows once
    docs += [(None, text("n0x") + " more", "en", "a", 9), (8, text("n1x") + " more", "en", "a", 9), (3, text("t1x"), "en", "a", 9)]
    got = cp.one_of_each_group(spark, spark.createDataFrame(docs, schema), small).collect()
    assert collections.Counter(r.doc_id for r in got) == {None: 4, 3: 4, 8: 1}
    assert {r.text.split()[0] for r in got} == {f"n{k}x0" for k in range(5)} | {f"t{k}x0" for k in range(4)}
