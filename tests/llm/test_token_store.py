import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm.brute import rows
from veriscope.llm import token_store as ts
from veriscope.llm.shared import fresh_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_store_gives_back_every_id(spark, small):
    whole = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in ts.op3_token_store(spark, small).collect()}
    start = 0
    for doc_id, text in rows(small, "SELECT doc_id, text FROM documents ORDER BY doc_id"):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        want = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == want
        start += len(ids)


def test_odd_rows_and_single_documents(spark):
    docs = [(3, "a few words"), (None, None), (3, ""), (3, ""), (9, "word " * 70_000)]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, start long")
    store = fresh_folder(spark, "store")
    ts.write_store(df, store, tokenizer=PATH, end_id=2, block_bytes=256)
    got = sorted(ts.read_store(spark, store).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 3, 3, 3, 9]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))
    one = ts.read_document(spark, store, 3)
    assert sorted(len(x) for x in one) == [1, 1, 4] and all(x[-1] == 2 for x in one)


def test_empty_table_and_foreign_dictionary(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    store = fresh_folder(spark, "store")
    ts.write_store(empty, store, tokenizer=PATH, end_id=2)
    assert ts.read_store(spark, store).count() == 0
    spark.createDataFrame([("0" * 64, PATH, 4, bytearray(b"x"))], "hash string, tokenizer string, width int, dictionary binary").write.mode(
        "overwrite"
    ).parquet(f"{store}/dictionary")
    with pytest.raises(ValueError, match="does not have the hash"):
        ts.read_store(spark, store)


def test_special_tokens_in_a_text_shift_later_documents(spark):
    whole = Tokenizer.from_file(PATH)
    docs = [(1, "x <|endoftext|> y"), (2, "x<|endoftext|><|endoftext|>y"), (3, "a few words")]
    store = fresh_folder(spark, "store")
    ts.write_store(spark.createDataFrame(docs, "doc_id long, text string"), store, tokenizer=PATH, end_id=2)
    got, start = {r.doc_id: r for r in ts.read_store(spark, store).collect()}, 0
    for doc_id, text in docs:
        n = len(whole.encode(text, add_special_tokens=False).ids) + 1
        assert (got[doc_id].start, got[doc_id].n_tokens) == (start, n)
        start += n


def test_workers_get_few_rows_and_blocks_are_cut_where_they_are_full(spark, tmp_path, monkeypatch):
    real, met = ts.encoder, tmp_path / "met"

    class Counted:
        def __init__(self, *args):
            self.real = real(*args)

        def encode(self, texts):
            with open(met, "a") as f:
                f.write(f"{len(texts)}\n")
            return self.real.encode(texts)

    monkeypatch.setattr(ts, "encoder", Counted)
    docs = spark.range(2500).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1)
    store = fresh_folder(spark, "store")
    ts.write_store(docs, store, tokenizer=PATH, end_id=2, block_bytes=500)
    assert max(map(int, met.read_text().split())) <= 1000
    at = 0
    for r in sorted(ts.read_store(spark, store).collect(), key=lambda r: r.start):
        want = np.array([*real(PATH, 4).whole.encode(f"text {r.doc_id}", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(want) // 4, want)
        at += r.n_tokens
    last = {}
    for r in spark.read.parquet(f"{store}/blocks").collect():
        assert [e.offset for e in r.entries] == list(np.cumsum([0] + [e.length for e in r.entries[:-1]])) and r.entries[-1].offset < 500
        last.setdefault(r.part, []).append((r.block, len(r.data)))
    assert all(size >= 500 for blocks in last.values() for _, size in sorted(blocks)[:-1])
