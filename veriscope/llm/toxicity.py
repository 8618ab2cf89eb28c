r"""Toxicity by a chain of linear classifiers.

Categories are predicted in a fixed order; the model of a category sees the words of a text and the probability
of every earlier category. In training those are out-of-fold predictions (a model never feeds a later one
with what it has learnt by heart), in scoring the predictions of models fitted on all folds.

A text is the set of its words and of their first 4 and 5 letters, hashed to 2**20 features, so inflected forms
share evidence. Models are fitted on a bounded sample of labelled rows: at most `max_rows`, the first in a hash
order of their ids. Only their feature numbers reach the driver. A fit uses the features whose frequencies
in the two classes differ by a factor of exp(1.5) at least. Scoring is one pass over all whole
texts without a shuffle; a worker remembers what each word adds to each category.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm.registry import query
from veriscope.llm.shared import shipped, table

BITS, FOLDS, MAX_ROWS, MIN_ROWS_OF_FEATURE = 20, 5, 4_000, 3
L2, STEPS, CLIP, MIN_LOG_RATIO = 0.3, 25, 12.0, 1.5
REMEMBERED = 400_000
_LETTERS = re.compile(r"[^\W\d_]+").findall


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself and its first letters."""
    code = word.encode()
    head = word[:5].encode()
    return tuple({zlib.crc32(code, 1) >> (32 - BITS), zlib.crc32(word[:4].encode(), 4) >> (32 - BITS), zlib.crc32(head, 5) >> (32 - BITS)})


def text_features(text: str | None) -> np.ndarray:
    """Features of a text, one entry for every word that has them."""
    found: list[int] = []
    for word in set(_LETTERS(text.lower())) if text else ():
        found += word_features(word)
    return np.array(found, dtype=np.int32)


def fit_logistic(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Weights (size features, then the dense columns, then the bias) by L-BFGS on the L2-penalised log loss.

    Features enter scaled by their log ratio of class frequencies (as in naive Bayes); the weights returned apply
    to plain counts.
    """
    n, extra = len(rows), dense.shape[1]
    counts = np.fromiter(map(len, rows), np.int64, n)
    flat = np.concatenate(rows) if counts.sum() else np.empty(0, np.int64)
    owner = np.repeat(np.arange(n), counts)
    sign = np.where(y > 0, 1.0, -1.0)
    # a feature weighs as much as its frequencies in either class differ, so that few labels do not drown in rare words
    yes, no = (np.bincount(flat, weights=(y == v)[owner].astype(float), minlength=size) for v in (1, 0))
    ratio = np.log((yes + 1) / (y.sum() + 2)) - np.log((no + 1) / (n - y.sum() + 2))
    ratio[np.abs(ratio) < MIN_LOG_RATIO] = 0
    told = ratio[flat] != 0
    flat, owner = flat[told], owner[told]
    value = ratio[flat]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(owner, weights=w[flat] * value, minlength=n) + dense @ w[size : size + extra] + w[-1]
        m = sign * z
        e = -sign / (1 + np.exp(np.clip(m, -35, 35)))
        g = np.concatenate([np.bincount(flat, weights=e[owner] * value, minlength=size), dense.T @ e, [e.sum()]])
        g[:-1] += L2 * w[:-1]
        return float(np.logaddexp(0, -m).sum() + 0.5 * L2 * (w[:-1] ** 2).sum()), g

    w = np.zeros(size + extra + 1)
    f, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        d, alphas = -g, []
        for s, t, r in reversed(past):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * t
        if past:
            s, t, _ = past[-1]
            d = d * ((s @ t) / (t @ t))
        for (s, t, r), a in zip(past, reversed(alphas), strict=True):
            d = d + (a - r * (t @ d)) * s
        slope = float(g @ d)
        if slope > -1e-6 * n:
            break
        step = 1.0 if past else min(1.0, 1.0 / np.abs(g).sum() * 10)
        for _ in range(25):
            f2, g2 = loss(w + step * d)
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = step * d, g2 - g
        w, f, g = w + s, f2, g2
        if s @ t > 1e-10:
            past = [*past[-6:], (s, t, 1 / float(s @ t))]
    w[:size] *= ratio
    return w


def _odds(rows: list[np.ndarray], dense: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    z = np.array([w[r].sum() for r in rows]) + dense @ w[size : size + dense.shape[1]] + w[-1]
    return np.clip(z, -CLIP, CLIP)


def _probability(odds):
    return 1 / (1 + np.exp(-odds))


@dataclass(frozen=True)
class Chain:
    """Fitted chain: feature numbers in use, their weights [feature, category], links [category, earlier probability], biases."""

    categories: tuple[str, ...]
    features: np.ndarray
    weights: np.ndarray
    links: np.ndarray
    biases: np.ndarray


def fit_chain(features: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, categories: tuple[str, ...]) -> Chain:
    """Chain over rows of feature numbers; labels [row, category] are 0 or 1.

    A category without both values gets its prior alone (its log-odds clipped to +-12; without rows -12).
    """
    k = len(categories)
    if len(features):
        numbers, n = np.unique(np.concatenate(features), return_counts=True)
        numbers = numbers[n >= MIN_ROWS_OF_FEATURE]
    else:
        numbers = np.empty(0, np.int32)
    rows = []
    for f in features:
        at = np.searchsorted(numbers, f)
        ok = (at < len(numbers)) & (numbers[np.minimum(at, max(len(numbers) - 1, 0))] == f) if len(numbers) else np.zeros(len(f), bool)
        rows.append(at[ok])
    size = len(numbers)
    weights, links, biases = np.zeros((size, k)), np.zeros((k, k)), np.full(k, -CLIP)
    earlier = np.zeros((len(rows), 0))
    for j in range(k):
        y = labels[:, j]
        if not 0 < y.sum() < len(y):
            if len(y):
                biases[j] = CLIP if y.sum() else -CLIP
            earlier = np.column_stack([earlier, np.full(len(rows), _probability(biases[j]))])
            continue
        w = fit_logistic(rows, earlier, y, size)
        weights[:, j], links[j, :j], biases[j] = w[:size], w[size : size + j], w[-1]
        held_out = np.zeros(len(rows))
        for fold in np.unique(folds):
            inside, outside = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
            if len(inside) and 0 < y[inside].sum() < len(inside):
                v = fit_logistic([rows[i] for i in inside], earlier[inside], y[inside], size)
                held_out[outside] = _odds([rows[i] for i in outside], earlier[outside], v, size)
        earlier = np.column_stack([earlier, _probability(held_out)])
    return Chain(categories, numbers, weights.astype(np.float32), links, biases)


class _Adds(dict):
    """Word to the row of its contributions, computed when first met."""

    def __init__(self, chain: Chain):
        super().__init__()
        used = np.flatnonzero((chain.weights != 0).any(axis=1))
        self.weights = dict(zip(chain.features[used].tolist(), chain.weights[used].tolist(), strict=True))
        self.used = 0
        self.rows = np.zeros((1024, len(chain.categories)))

    def __missing__(self, word: str) -> int:
        found = [w for f in word_features(word) if (w := self.weights.get(f))]
        if not found:
            self[word] = 0  # row 0 stays empty
            return 0
        at = self.used = self.used + 1
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = np.sum(found, axis=0)
        self[word] = at
        return at


def score_text(text: str | None, chain: Chain, adds: _Adds) -> list[float]:
    """Log-odds of every category. Features count once per word, so words with equal first letters add up."""
    words = set(_LETTERS(text.lower())) if text else ()
    at = np.fromiter(map(adds.__getitem__, words), np.int64, len(words))
    total = adds.rows[at].sum(axis=0)
    out: list[float] = []
    earlier: list[float] = []
    for j in range(len(chain.categories)):
        z = float(total[j] + chain.biases[j] + sum(a * b for a, b in zip(chain.links[j], earlier, strict=False)))
        out.append(min(CLIP, max(-CLIP, z)))
        earlier.append(1 / (1 + math.exp(-out[-1])))
    return out


def train_chain(
    documents: DataFrame, labels: DataFrame, categories: dict[str, Column], *, key: str = "doc_id", text: str = "text",
    max_rows: int = MAX_ROWS,
) -> Chain:
    """Chain over `categories` (name to a boolean column of `labels`, in chain order), fitted on documents that have labels.

    The sample is the first `max_rows` labels by the hash of their key; labels with a null key or a null category
    and labels without a document are left out. Repeated rows count as often as they occur, the sample being cut once
    more at `max_rows` behind the join, so copies of a labelled document cannot make it longer.
    """
    names = list(categories)
    sample = (
        labels.select(F.col(key).alias("l_key"), *[c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())])
        .dropna().orderBy(F.xxhash64("l_key"), "l_key").limit(max_rows)
    )

    def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.drop(columns=["t"]).assign(x=[np.sort(text_features(t)).tobytes() for t in f["t"]])

    shape = ", ".join(["l_key long", *[f"y{i} int" for i in range(len(names))], "x binary"])
    rows = (
        shipped(documents).select(F.col(key).alias("d_key"), F.col(text).alias("t"))
        .join(F.broadcast(sample), F.col("d_key") == F.col("l_key"))  # at most max_rows rows
        .select(F.col("l_key").cast("long"), *[f"y{i}" for i in range(len(names))], "t")
        .mapInPandas(featured, shape).orderBy(F.xxhash64("l_key"), "l_key", "x").limit(max_rows)
        .toPandas().sort_values(["l_key", "x"], kind="stable")
    )
    features = [np.frombuffer(x, np.int32) for x in rows["x"]]
    y = rows[[f"y{i}" for i in range(len(names))]].to_numpy(np.int64).reshape(len(rows), len(names))
    folds = np.array([zlib.crc32(str(k).encode()) % FOLDS for k in rows["l_key"]], dtype=np.int64)
    return fit_chain(features, y, folds, tuple(names))


def probabilities(text: Column, chain: Chain) -> Column:
    """Struct with the probability of every category of the chain; null and empty texts have the priors."""
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        adds = _Adds(chain)
        for texts in frames:
            out = []
            for t in texts:
                if len(adds) > REMEMBERED:
                    adds = _Adds(chain)
                out.append(score_text(t, chain, adds))
            odds = np.array(out, dtype=float).reshape(len(out), len(chain.categories))
            yield pd.DataFrame(_probability(odds), columns=list(chain.categories))

    return F.pandas_udf(run, ", ".join(f"`{c}` double" for c in chain.categories))(text)


def score_documents(documents: DataFrame, chain: Chain, *, text: str = "text", threshold: float = 0.5, decide: str = "toxic") -> DataFrame:
    """`documents` with `p_<category>` and `is_<decide>` (probability of that category at least the threshold).

    Rows are judged one by one: repeated rows alike, an empty table gives no row. Input columns named like an
    output are replaced.
    """
    made = [f"p_{c}" for c in chain.categories] + [f"is_{decide}"]
    keep = [c for c in documents.columns if c not in made]
    scored = shipped(documents).withColumn("__p", probabilities(F.col(text), chain))
    return scored.select(
        *keep, *[F.col(f"__p.{c}").alias(f"p_{c}") for c in chain.categories], (F.col(f"__p.{decide}") >= threshold).alias(f"is_{decide}")
    )


def without_flagged(documents: DataFrame, chain: Chain, *, text: str = "text", threshold: float = 0.5, decide: str = "toxic") -> DataFrame:
    """The rows of `documents` that score below the threshold, with their own columns, whatever those are called."""
    scored = shipped(documents).withColumn("__p", probabilities(F.col(text), chain))
    return scored.filter(F.col(f"__p.{decide}") < threshold).select(*[F.col(f"`{c}`") for c in documents.columns])


def label_categories() -> dict[str, Column]:
    """The chain over the labels at hand: low quality first, toxicity after it."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


@query("op7_toxicity_chain")
def op7_toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    chain = train_chain(documents, table(spark, folder, "labels"), label_categories())
    return score_documents(documents, chain).select("doc_id", "p_low_quality", "p_toxic", "is_toxic")
