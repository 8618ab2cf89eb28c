"""Nearest ground-truth entry of each question."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope import constants as K
from veriscope.functions.text import polarity_conflict
from veriscope.functions.vectors import unit_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BLOCK_BYTES = 16 * 1024 * 1024
_PRODUCT_CELLS = 4_000_000
_TIE = 12
_FOUND = "query_id long, position long, match_score double"


def _best_in_block(asked: pa.Table, entries: pa.Table) -> pa.Table:
    """Best entry of one block for each question of one slice, by matrix products."""
    ids = asked["query_id"].to_numpy()
    positions = entries["position"].to_numpy()
    homes = unit_rows(entries["gt_embedding"].combine_chunks())
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for size, (rows, unit) in unit_rows(asked["embedding"].combine_chunks()).items():
        if size not in homes:
            continue
        order = np.argsort(positions[homes[size][0]], kind="stable")
        place, against = positions[homes[size][0]][order], homes[size][1][order]
        step = max(1, _PRODUCT_CELLS // len(against))
        for start in range(0, len(rows), step):
            q = unit[start : start + step]
            cos = q @ against.T
            # the first entry within rounding of the best, then its score by a plain sum: no block shape changes it
            best = (cos >= cos.max(axis=1)[:, None] - 10.0**-_TIE).argmax(axis=1)
            out.append((ids[rows[start : start + step]], place[best], (q * against[best]).sum(axis=1)))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, int), np.empty(0, int), np.empty(0)]
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.table(dict(zip(("query_id", "position", "match_score"), map(pa.array, columns, kinds))))


def _parts(df: DataFrame, vector: str, block_bytes: int) -> int:
    """How many parts of `block_bytes` the vectors of a table make."""
    cells = df.agg(F.sum(F.greatest(F.size(vector), F.lit(0)).cast("long"))).first()[0] or 0
    return max(1, -(-cells * 8 // block_bytes))


def _numbered(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def best_entries(questions: DataFrame, entries: DataFrame, block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """(query_id, position, match_score): most similar entry, the first one on ties.

    `entries` has (position, gt_embedding). Both sides are cut by hash into parts of about `block_bytes`; every
    slice of questions meets every block of entries in one group, as matrices, and a group gives one row per
    question. So the output is questions x blocks, no group grows with the tables and the method is the same at
    every size. Every question with a vector gets a row if any entry has its dimension, however low
    the score; vectors that are null, empty or not finite take no part.
    """
    blocks = _parts(entries, "gt_embedding", block_bytes)
    slices = _parts(questions, "embedding", block_bytes)
    asked = questions.select(
        F.col("query_id").cast("long"), "embedding", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int").alias("slice"),
        _numbered(blocks).alias("block"),
    )
    known = entries.select(
        F.col("position").cast("long"), "gt_embedding", F.pmod(F.xxhash64("position"), F.lit(blocks)).cast("int").alias("block"),
        _numbered(slices).alias("slice"),
    )
    cut = ["slice", "block"]
    found = asked.groupBy(*cut).cogroup(known.groupBy(*cut)).applyInArrow(_best_in_block, _FOUND)
    rank = F.struct(F.round("match_score", _TIE), -F.col("position"))
    return found.groupBy("query_id").agg(F.max_by(F.struct("position", "match_score"), rank).alias("best")).select(
        "query_id", "best.*"
    )


def match_ground_truth(questions: DataFrame, entries: DataFrame, threshold: float = K.GT_MATCH,
                       block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """Matched entry per question, with `is_match` and `trusted`.

    Only the most similar entry is looked at: if it asks for the opposite
    direction ("less than" against "more than") the question has no match.
    `questions` has (query_id, query_text, embedding), `entries` has
    (position, gt_text, gt_embedding, ...).
    """
    best = best_entries(questions, entries, block_bytes)
    joined = questions.drop("embedding").join(best, ["query_id"], "left").join(
        entries.drop("gt_embedding"), ["position"], "left"
    )
    near = F.coalesce(F.col("match_score") >= threshold, F.lit(False))
    clash = F.coalesce(polarity_conflict(F.col("query_text"), F.col("gt_text")), F.lit(False))
    matched = near & ~clash
    return joined.withColumns(
        {"is_match": matched, "trusted": matched & (F.col("match_score") >= K.GT_TRUST)}
    )
