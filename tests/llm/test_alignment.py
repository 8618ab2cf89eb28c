import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from llm.brute import rows
from veriscope.llm import alignment
from veriscope.llm.alignment import align, align_texts, diagonals, merge_piece, merged
from veriscope.llm.tokens import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_pair():
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    pieces = SentencePieceProcessor(model_file=B)
    back = {chr(c): b for b, c in byte_letters().items()}

    def encode(text):
        """[(id, bytes)] of A and of B, or two empty lists."""
        if not text:
            return [], []
        a = [(i, bytes(back[c] for c in whole.id_to_token(i))) for i in whole.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in pieces.encode(text):
            name = pieces.id_to_piece(i)
            b.append((i, bytes([int(name[3:5], 16)]) if pieces.is_byte(i) else name.replace("▁", " ").encode()))
        want = b" " + text.encode()
        good = b"".join(x for _, x in a) == want and b"".join(x for _, x in b) == want
        return (a, b) if good else ([], [])

    return encode


def spans(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain(encode, texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every text, token by token."""
    links, out = [], []
    for text in texts:
        a, b = (spans(x) for x in encode(text))
        found, start = [], 0
        for i, s, e in a:  # tokens of b in order, beginning with the first that reaches into this one
            while start < len(b) and b[start][2] <= s:
                start += 1
            at = start
            while at < len(b) and b[at][1] < e:
                found.append((i, b[at][0]))
                at += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, before, x, y = [], 0, 0, 0
        for cut in cuts:
            left, right = [], []
            while x < len(a) and a[x][2] <= cut:
                left.append(str(a[x][0]))
                x += 1
            while y < len(b) and b[y][2] <= cut:
                right.append(str(b[y][0]))
                y += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        links.append(found)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(cuts), len(found), digest))
    count = Counter(p for found in links for p in set(found))
    top = Counter()
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    return [
        (*o[:4], sum(count[p] == top[p[0]] for p in found), sum(count[p] for p in found), o[4])
        for o, found in zip(out, links, strict=True)
    ], count


def run(spark, docs, **options):
    frame = spark.createDataFrame([(k, t, 1, "x", [2]) for k, t in docs], "doc_id long, text string, n_a int, key string, pairs array<int>")
    found, ids = align(frame, tokenizer_a=A, tokenizer_b=B, **options)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str), ids


ODD = [
    None, "", "word", "The quick brown fox.\nNew line", "  two  blanks ", "\n\nlines\n", "<|endoftext|> x", "<s> a </s> <unk> <0x41>", "a▁b", "▁",
    "x y", "\t", "中文字 テスト 🙂🙂", "é ́x ﬁ Å", "\x00 \x01 \x7f", "12345 3.14 it's a'll", "same", "same", "Ünïcödé " * 40,
]


def test_odd_rows(spark, plain_pair):
    docs = [*enumerate(ODD), (None, "word"), (5, "word word"), (5, "word word")]
    want, count = plain(plain_pair, [t for _, t in docs])
    got, ids = run(spark, docs)
    assert got == sorted(((k, *w) for (k, _), w in zip(docs, want, strict=True)), key=str)
    assert Counter({(r.a_id, r.b_id): r.n for r in ids.collect()}) == count


def test_rare_pairs_are_joined_by_a_shuffle(spark, plain_pair):
    texts = ["the word and", "the thing of", "the", "a rare ñandú", "the the the word"] * 3
    want, _ = plain(plain_pair, texts)
    got, _ = run(spark, list(enumerate(texts)), hot=3)
    assert got == sorted(((k, *w) for k, w in enumerate(want)), key=str)


def test_empty_table(spark):
    got, ids = run(spark, [])
    assert got == [] and ids.count() == 0


def test_query_equals_brute_force(spark, small, plain_pair):
    docs = rows(small, "SELECT doc_id, text FROM documents ORDER BY doc_id")
    want, _ = plain(plain_pair, [t for _, t in docs])
    got = sorted((tuple(r) for r in alignment.op12_tokenizer_alignment(spark, small).collect()), key=lambda r: r[0])
    assert got == [(k, *w) for (k, _), w in zip(docs, want, strict=True)]
    assert sum(w[0] > 0 for w in want) > 0.9 * len(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.lists(st.integers(1, 4), max_size=40), st.integers(1, 9))
def test_pieces_of_the_merge_hold_equal_work_and_give_the_whole(left, right, work):
    a, b = (np.cumsum(np.array(x, dtype=np.int64)) for x in (left, right))
    end = max([*a, *b], default=0) + 1
    if left or right:
        a, b = np.append(a, end), np.append(b, end)
    i, j = diagonals(a, b, work)
    assert (np.diff(i + j) <= work + 1).all() and i[-1] == len(a) and j[-1] == len(b)
    whole = merge_piece(a, b, 0, len(a), 0, len(b))
    m = merged(a, b, work)
    for got, want in zip((m.ends, m.a, m.b), whole[:3], strict=True):
        assert got.tolist() == want.tolist()
    assert m.ends.tolist() == sorted({*a.tolist(), *b.tolist()}) and m.cuts.tolist() == sorted({*a.tolist()} & {*b.tolist()})
    for ends, tokens in ((a, m.a), (b, m.b)):
        assert [next(k for k, x in enumerate(ends) if x >= e) for e in m.ends] == tokens.tolist()
    assert m.a_group.tolist() == [int((m.cuts < e).sum()) for e in a] and m.b_group.tolist() == [int((m.cuts < e).sum()) for e in b]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n▁.中", max_size=30), min_size=1, max_size=8), st.integers(1, 7))
def test_random_texts_equal_brute_force(plain_pair, texts, work):
    pair = alignment._pair(A, B)
    x = align_texts(pair, texts, work)
    want, _ = plain(plain_pair, texts)
    got = list(zip(*(np.asarray(x[c]).tolist() for c in ("n_a", "n_b", "n_groups", "n_links")), x["groups_sha256"], strict=True))
    assert got == [(*w[:4], w[6]) for w in want]


