r"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every character that is no letter becomes a blank, and runs of blanks count once. Its features
are all n-grams of 1 to 3 characters of the result that hold a letter, hashed to 2**16 buckets. Counts per
language and bucket come from all learning documents: a task adds up its documents in one matrix, Spark
adds the tasks' matrices, and at most `most_languages` x 2**16 sums reach the driver. The matrix of log
probabilities is broadcast to the workers: 0.5 MB a language, 128 MB at that bound.

Batches of texts are turned into one array of characters, their n-grams into one sparse array of (document, bucket)
entries, and the scores into sums of matrix rows, all in numpy. Long texts are cut into blocks of characters that
overlap by the n-grams' length, so memory does not grow with a text and no n-gram is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm.registry import query
from veriscope.llm.shared import shipped, staged, table

BITS, LENGTHS, ALPHA, MOST_LANGUAGES = 16, 3, 0.5, 256
#: Characters handled at once; bounds memory, not what is read.
BLOCK = 1 << 18
_BLANK = np.uint32(0x20)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)

UNKNOWN = "und"
_is_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all of them; built once per worker."""
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)
    return _is_letter


def normalised(text: str) -> np.ndarray:
    """Code points of a text as the n-grams see it: lower case, a blank at both ends and for every run of other characters."""
    chars = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[chars]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # the first other character behind a letter stands for its run
    return np.where(letter, chars, _BLANK)[keep]


def buckets(chars: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Buckets of all n-grams of normalised characters; blanks alone are none."""
    out = []
    for n in range(1, LENGTHS + 1):
        if len(chars) < n:
            break
        size = len(chars) - n + 1
        code = np.full(size, n, dtype=np.uint32)
        for i in range(n):
            code = (code ^ chars[i : i + size]) * _FACTORS[i]
            code ^= code >> np.uint32(15)
        out.append((code >> np.uint32(32 - bits))[chars[:size] != _BLANK] if n == 1 else code >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


def _blocks(text: str) -> Iterator[np.ndarray]:
    """Buckets of a text, block by block; every n-gram is in exactly one block."""
    chars = normalised(text)
    if len(chars) <= BLOCK:
        yield buckets(chars)
        return
    for start in range(0, len(chars), BLOCK):
        block = chars[start : start + BLOCK]
        found = [buckets(block)]
        after = chars[start + BLOCK : start + BLOCK + LENGTHS - 1]
        if len(after):  # n-grams that begin in this block and end behind it
            found.append(_across(block[-(LENGTHS - 1) :], after))
        yield np.concatenate(found)


def _across(head: np.ndarray, after: np.ndarray) -> np.ndarray:
    both, count = np.concatenate([head, after]), len(head)
    out = []
    for n in range(2, LENGTHS + 1):
        for start in range(max(0, count - n + 1), count):
            if start + n <= len(both):
                out.append(buckets(both[start : start + n])[-1:])
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


class Model:
    """Languages in code point order, log priors and the log-probability matrix [language, bucket]."""

    def __init__(self, languages: list[str], documents: np.ndarray, counts: np.ndarray):
        self.languages = languages
        self.prior = np.log(documents / documents.sum()) if len(languages) else np.zeros(0)
        smooth = counts.astype(np.float64) + ALPHA
        self.matrix = np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log score of every text and language: prior plus the matrix rows of its n-grams."""
        out = np.tile(self.prior, (len(texts), 1))
        rows, owners, size = [], [], 0
        for at, text in enumerate(texts):
            for found in _blocks(text):
                rows.append(found)
                owners.append(at)
                size += len(found)
                if size >= BLOCK:
                    self._add(out, rows, owners)
                    rows, owners, size = [], [], 0
        self._add(out, rows, owners)
        return out

    def _add(self, out: np.ndarray, rows: list[np.ndarray], owners: list[int]) -> None:
        rows, owners = [r for r in rows if len(r)], [o for r, o in zip(rows, owners, strict=True) if len(r)]
        if rows:
            starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
            flat = np.concatenate(rows)
            sums = np.stack([np.add.reduceat(logs[flat], starts) for logs in self.matrix], axis=1)
            np.add.at(out, owners, sums)


def learn(
    documents: DataFrame, *, text: str = "text", lang: str = "lang", most_languages: int = MOST_LANGUAGES,
) -> Model:
    """Model from every row with a language; a null text counts as empty. More than `most_languages` is an error.

    Rows count as often as they occur. Without a row to learn from the model knows no language.
    """
    rows = shipped(documents).select(F.col(text).alias("t"), F.col(lang).alias("l")).filter(F.col("l").isNotNull())

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for f in frames:
            for t, l in zip(f["t"], f["l"], strict=True):
                if l not in held:
                    if len(held) >= most_languages:
                        raise ValueError(f"more than {most_languages} languages to learn")
                    held[l] = [0, np.zeros(1 << BITS, dtype=np.int64)]
                mine = held[l]
                mine[0] += 1
                for found in _blocks(t or ""):
                    np.add.at(mine[1], found, 1)
        for l, (n, total) in held.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"l": l, "b": np.append(used, -1).astype(np.int32), "n": np.append(total[used], n)})

    # bucket -1 holds the number of documents
    summed = rows.mapInPandas(count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    summed = staged(summed, "language-counts")
    languages = [r.l for r in summed.filter("b = -1").select("l").limit(most_languages + 1).collect()]
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages to learn")
    languages = sorted(languages)
    place = {l: i for i, l in enumerate(languages)}
    found = summed.toPandas()  # at most most_languages x (2**BITS + 1) rows
    counts, sizes = np.zeros((len(languages), 1 << BITS), dtype=np.int64), np.zeros(len(languages))
    at, b, n = found["l"].map(place).to_numpy(np.int64), found["b"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    counts[at[b >= 0], b[b >= 0]] = n[b >= 0]
    sizes[at[b < 0]] = n[b < 0]
    return Model(languages, sizes, counts)


def predicted(text: Column, model: Model, spark: SparkSession) -> Column:
    """Struct (lang_pred, score): the most probable language, ties to the first by code point, and its posterior probability.

    A text that is null or has no letter, and any text if the model knows no language, is `und` with score 0.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        names = np.array(known.languages, dtype=object)
        letter = _letters()
        for texts in frames:
            lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            able = [i for i, t in enumerate(texts) if t and len(names) and _has_letter(t, letter)]
            if able:
                odds = known.scores([texts.iloc[i] for i in able])
                best = odds.argmax(axis=1)
                lang[able] = names[best]
                score[able] = 1.0 / np.exp(odds - odds.max(axis=1, keepdims=True)).sum(axis=1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return F.pandas_udf(run, "lang_pred string, score double")(text)


def _has_letter(text: str, letter: np.ndarray) -> bool:
    return any(map(str.isalpha, text[:64])) or bool(letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].any())


def identify(
    documents: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
    most_languages: int = MOST_LANGUAGES,
) -> DataFrame:
    """<key>, held_out, lang_pred, score: the language of every whole text, learnt from the rows not held out.

    Every row gives a row, repeated ones too; equal texts get equal answers. A row with a null language is judged
    but not learnt from; a null `held_out` counts as false. An empty table gives no row. Other columns are not read.
    """
    out = F.coalesce(held_out, F.lit(False))
    rows = documents.select(F.col(key), F.col(text).alias("__t"), F.col(lang).alias("__l"), out.alias("__out"))
    model = learn(rows.filter(~F.col("__out")), text="__t", lang="__l", most_languages=most_languages)
    return rows.withColumn("__p", predicted(F.col("__t"), model, documents.sparkSession)).select(
        key, F.col("__out").alias("held_out"), F.col("__p.lang_pred").alias("lang_pred"), F.col("__p.score").alias("score")
    )


def every_fourth(key: Column) -> Column:
    """crc32 of the key as text leaves 2 when divided by 4; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@query("op13_language_id")
def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents").select("doc_id", "text", "lang"), every_fourth(F.col("doc_id")))
