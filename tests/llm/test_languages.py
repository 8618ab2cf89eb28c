import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veriscope.llm import languages
from veriscope.llm.languages import every_fourth, identify
from veriscope.llm.registry import QUERIES
from pyspark.sql import functions as F

FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def plain_buckets(text):
    """Counter of the buckets of a text, character by character."""
    chars, out = " ", Counter()
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or chars[-1] != " ":
            chars += c
    chars += "" if chars[-1] == " " else " "
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            gram = chars[i : i + n]
            if gram.isspace():
                continue
            code = n
            for c, f in zip(gram, FACTORS, strict=False):
                code = ((code ^ ord(c)) * f) & 0xFFFFFFFF
                code ^= code >> 15
            out[code >> 16] += 1
    return out


def plain(rows):
    """(doc_id, held_out, lang_pred, log odds) by dictionaries; rows are (doc_id, text, lang)."""
    held = lambda k: zlib.crc32(str("" if k is None else k).encode()) % 4 == 2
    counts, documents = {}, Counter()
    for k, text, lang in rows:
        if not held(k) and lang is not None:
            documents[lang] += 1
            counts.setdefault(lang, Counter()).update(plain_buckets(text or ""))
    out = []
    for k, text, _ in rows:
        if not documents or not any(c.isalpha() for c in text or ""):
            out.append((k, held(k), "und", 0.0))
            continue
        odds = {}
        for lang in sorted(documents):
            total = sum(counts[lang].values()) + 0.5 * 65536
            odds[lang] = math.log(documents[lang] / sum(documents.values())) + math.fsum(
                n * (math.log(counts[lang][b] + 0.5) - math.log(total)) for b, n in plain_buckets(text).items()
            )
        best = max(odds, key=lambda x: (odds[x], [-ord(c) for c in x]))
        out.append((k, held(k), best, 1 / math.fsum(math.exp(v - odds[best]) for v in odds.values())))
    return out


def run(spark, rows):
    frame = spark.createDataFrame(
        [(k, t, l, 1, "a", 2.0) for k, t, l in rows], "doc_id long, text string, lang string, held_out int, lang_pred string, score double"
    )
    return [tuple(r) for r in identify(frame, every_fourth(F.col("doc_id"))).collect()]


def equal(got, want):
    order = lambda r: (str(r[0]), r[1], r[2], round(r[3], 6))
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-9)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abÉß ñ.\n1𝔸中²İ", max_size=60), st.integers(2, 9))
def test_blocks_hold_the_plain_ngrams(text, block):
    whole = languages.BLOCK
    try:
        languages.BLOCK = block
        got = Counter(np.concatenate(list(languages._blocks(text))).tolist())
    finally:
        languages.BLOCK = whole
    assert got == plain_buckets(text)


def test_rows_equal_plain_bayes(spark):
    words = {"en": "the of and thing tion", "fr": "le que éaient eaux ètre", "de": "der schön und größe ung"}
    rng = np.random.default_rng(3)
    rows = [
        (i, " ".join(rng.choice(words[l].split(), size=int(rng.integers(1, 6)))), l)
        for i, l in enumerate(rng.choice(list(words), size=90).tolist())
    ]
    equal(run(spark, rows), plain(rows))


def test_odd_rows(spark):
    rows = [
        (0, "the of", "en"), (0, "the of", "en"), (0, "der und", "de"), (1, None, "en"), (2, "", "de"), (3, "12 34 !!", "de"),
        (None, "schön", "de"), (None, None, None), (5, "der", None), (6, "x" * 700_000, "en"), (7, "½ ² _", "en"), (8, "中 文", ""),
        (9, "THE OF", None), (10, "ß\u0000ñ\t e", "de"),
    ]
    got = run(spark, rows)
    equal(got, plain(rows))
    assert {r[2] for r in got if r[0] in (1, 2, 3, 7)} == {"und"}


def test_nothing_to_learn_from(spark):
    assert run(spark, []) == []
    assert {r[2:] for r in run(spark, [(1, "abc", None), (2, "def", None)])} == {("und", 0.0)}


def test_ties_go_to_the_first_language(spark):
    got = run(spark, [(0, "same", "b"), (0, "same", "a"), (1, "same", None)])
    assert {(r[2], r[3]) for r in got} == {("a", 0.5)}


def test_too_many_languages_are_an_error(spark):
    frame = spark.createDataFrame([(0, "a", str(i)) for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(Exception, match="more than 4 languages"):
        identify(frame, F.lit(False), most_languages=4)


def test_held_out_accuracy(spark, small):
    got = QUERIES["op13_language_id"](spark, small).toPandas()
    docs = pd.read_parquet(f"{small}/documents.parquet")[["doc_id", "lang"]]
    both = got.merge(docs, on="doc_id")
    out = both[both["held_out"]]
    assert len(got) == len(docs) and len(out) > 150
    assert (out["lang_pred"] == out["lang"]).mean() >= 0.97
    assert got["score"].between(0, 1).all()
