import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.brute import rows
from veriscope.llm import packing as p
from veriscope.llm import tokens
from veriscope.llm.tokens import PieceEncoder, encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, ids):
    """Every id in exactly one piece, sequences gapless and within capacity; returns the padding share."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for doc, want in ids.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            part = np.array(want[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(part)) and r.length > 0
            at += r.length
        assert at == len(want)
    total = 0
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
        total += 2048 if at & (at - 1) else at
    assert sorted(by_seq) == list(range(len(by_seq)))
    tokens = sum(map(len, ids.values()))
    return (total - tokens) / tokens


def test_query_packs_every_id_once(spark, small):
    whole = Tokenizer.from_file(PATH)
    ids = {d: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows(small, "SELECT doc_id, text FROM documents")}
    assert check(p.op4_cutting_stock(spark, small).collect(), ids) < 0.005


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (2, ""), (None, "a b"), (4, "word " * 5000)]
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, start string")
    got = p.pack(df, tokenizer=PATH, words=True, end_id=1).collect()
    assert sum(r.length for r in got) == 1 + 1 + 1 + 3 + 5001
    assert p.pack(df.limit(0), tokenizer=PATH, words=True, end_id=1).count() == 0


def test_plan_covers_a_large_histogram():
    rng = np.random.default_rng(1)
    classes = p.length_classes(2048)
    hist = {int(c): int(n) for c, n in zip(classes, rng.integers(0, 10**6, len(classes)), strict=True)}
    plan = p.packing_plan(hist, 2048)
    got = defaultdict(int)
    for c, lo, hi, _, _, _, _, length in plan:
        got[c] += (hi - lo) * length
    assert got == {c: c * n for c, n in hist.items() if n}
    sequences = max(s + (hi - lo - 1) // each for _, lo, hi, s, each, *_ in plan) + 1
    assert sequences <= sum(c * n for c, n in hist.items()) / 2048 * 1.003 + 1


def test_pieces_give_the_ids_of_the_whole_text():
    texts = ["a  b\n\n c", "  lead", "trail  \n", "a\tb \n x", "<|endoftext|> x", "é ́x", "Σας İx", "a\x1cb \x1c c",
             "a\t \tb", "x\t\ny", "it's a'll", "Élan ﬁ ẞ ß.", "a.  b", "\n", " ", "x\r\ny 123 ***a###"]
    for name, words in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        for text, got in zip(texts, PieceEncoder(path, 4, words).encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_special_tokens_in_a_text_are_those_of_the_loaded_tokenizer(spark):
    strings = ("<|endoftext|>", "<|startoftext|>")
    texts = [t.replace("#", s) for s in strings for t in ("#", "x # y", "x#y", "##", "# # #", "a\n#\nb", " # ", "it's#, a  b")]
    texts += ["<|EndOfText|> x", "<|endoftext|", "<|startoftext|><|endoftext|> b", "no such string"]
    for name, words in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        for text, got in zip(texts, encoder(path, 4, words).encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    whole = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {i: [*whole.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    check(p.pack(df, tokenizer=PATH, words=True, end_id=1).withColumn("ids_crc32", F.crc32("ids")).collect(), ids)


PIECES = st.sampled_from(["word", "Word,", "Élan", "ñ.", "it's", "12", "a***", "<|endoftext|>", "\u00a0", "\x1c", "\x01", "\t", "é", "ﬁ", "中文", "x\x01y", "!?", "", "\r"])
GAPS = st.sampled_from([" ", " ", " ", "\n", "  ", " \n", "\n\n"])


@pytest.mark.parametrize("name, words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(PIECES, GAPS), max_size=8), min_size=1, max_size=6))
def test_random_texts_give_the_ids_of_the_plain_tokenizer(name, words, texts):
    path = public_tokenizers.path(name)
    made = encoder(path, 4, words)
    whole = made.whole
    strings = ["".join(p + g for p, g in t) for t in texts] + [None, ""]
    for after_blank, run in ((False, made.encode), (True, made.encode_after_blank)):
        for text, got in zip(strings, run(strings), strict=True):
            want = whole.encode((" " if after_blank else "") + text, add_special_tokens=False).ids if text else []
            assert np.frombuffer(got, "<u4").tolist() == want, (after_blank, text)


def test_remembered_pieces_age(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    made, whole = PieceEncoder(path, 4, False, literal=False), Tokenizer.from_file(path)
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    for i in range(30):
        texts = [f"the old word{chr(97 + i)} and, new{chr(97 + i)}{j} xy{chr(97 + j)}. the old" for j in range(20)]
        got = made.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(made.pieces.number) <= 40


def test_workers_get_few_rows_at_once(spark, tmp_path, monkeypatch):
    real, met = p.encoder, tmp_path / "met"

    def counted(*args):
        with open(met, "a") as f:
            f.write("x")
        return real(*args)

    monkeypatch.setattr(p, "encoder", counted)
    docs = spark.range(2500).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1)
    got = p.pack(docs, tokenizer=PATH, words=True, end_id=1)
    assert got.select("doc_id").distinct().count() == 2500
    assert len(met.read_text()) >= 3


@pytest.mark.parametrize("name, words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_a_new_piece_is_looked_up_twice_at_most(name, words):
    class Asked(dict):
        times = 0

        def get(self, *args):
            self.times += 1
            return super().get(*args)

    made = PieceEncoder(public_tokenizers.path(name), 4, words, literal=False)
    made.pieces.number = asked = Asked()
    pieces = [f"{chr(97 + i)}{chr(97 + j)}x" for i in range(20) for j in range(20)]
    got = made.encode([" ".join(pieces)])
    assert np.frombuffer(got[0], "<u4").tolist() == made.whole.encode(" ".join(pieces), add_special_tokens=False).ids
    assert asked.times <= 2 * len(pieces) + 10
