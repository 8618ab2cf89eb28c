r"""Packing documents into sequences by cutting-stock column generation.

A document of n tokens is cut into whole sequences and a rest; the rest into a piece of a length class and,
where its length lies between classes, a tail of few tokens. Classes are every length up to 64
and 32 lengths per doubling above (224 for 2048), so every piece has exactly its class's length.

1. The histogram of classes (a row per class) is all that reaches the driver.
2. A linear program over patterns (how many pieces of each class fill a sequence) is solved by
   column generation: the master's duals price pieces and an unbounded knapsack over the capacity
   finds the best new pattern, until Farley's bound says the rest is worth less than `gap`.
3. Pattern counts are rounded down; what remains (less than a sequence per pattern) is packed
   largest first, cutting the piece that crosses the end, so of these only the last sequence has room.
4. Pieces are ranked within their class: a running sum over (part, class) counts plus the number a
   task gave them. Patterns own rank ranges, so a piece finds its sequence by its rank alone.

The plan has at most a row per pattern and class plus the residual's (bounded by the classes, whatever
the data), so it is broadcast. Ids are moved only if the table of rank bases is too large to broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriscope.llm.registry import query
from veriscope.llm.shared import FEW_ROWS, shipped, staged, table
from veriscope.llm.tokens import encoder

CAPACITY, GAP = 2048, 2e-3
EXACT, PER_DOUBLING = 64, 32


def length_classes(capacity: int) -> np.ndarray:
    """Every length up to EXACT, then PER_DOUBLING lengths per doubling, and the capacity."""
    out, low = list(range(1, min(EXACT, capacity) + 1)), EXACT
    while low < capacity:
        step = max(1, low // PER_DOUBLING)
        out += [x for x in range(low + step, 2 * low + 1, step) if x < capacity]
        low *= 2
    return np.array(sorted({*out, capacity}), dtype=np.int64)


def cut_document(n: int, capacity: int, classes: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; every length is a class."""
    whole = n // capacity
    out = [(i * capacity, capacity) for i in range(whole)]
    at = whole * capacity
    while at < n:
        length = int(classes[np.searchsorted(classes, n - at, "right") - 1])
        out.append((at, length))
        at += length
    return out


def best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the dearest multiset of pieces that fits."""
    worth = np.zeros(capacity + 1)
    steps = []
    for i in np.flatnonzero(prices > 0):
        length, times = int(lengths[i]), 1
        while times * length <= capacity:  # 1, 2, 4, ... pieces at once give every number of them
            room = times * length
            better = worth[:-room] + times * prices[i]
            taken = better > worth[room:] + 1e-12
            np.copyto(worth[room:], better, where=taken)
            steps.append((i, times, room, taken))
            times *= 2
    pattern, left = np.zeros(len(lengths), dtype=np.int64), capacity
    for i, times, room, taken in reversed(steps):
        if left >= room and taken[left - room]:
            pattern[i] += times
            left -= room
    return float(worth[capacity]), pattern


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns [class, pattern] and their (fractional) counts that cover the demand within `gap` of the least."""
    m = len(lengths)
    basis = np.diag(capacity // lengths).astype(float)
    inverse = np.diag(1.0 / (capacity // lengths))
    counts = inverse @ demand
    floor = float((lengths * demand).sum()) / capacity
    for step in range(40 * m + 100):
        if counts.sum() <= floor * (1 + gap):
            break
        duals = inverse.sum(axis=0)
        value, pattern = best_pattern(lengths, np.maximum(duals, 0), capacity)
        if value <= 1 + gap:  # Farley: no solution is below sum(counts) / value
            break
        direction = inverse @ pattern
        ratios = np.where(direction > 1e-9, counts / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratios.argmin())
        counts = counts - ratios[out] * direction
        counts[out] = ratios[out]
        basis[:, out] = pattern
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
        if step % 100 == 99:  # against the drift of repeated updates
            inverse = np.linalg.inv(basis)
            counts = np.maximum(inverse @ demand, 0)
    return basis.astype(np.int64), np.maximum(counts, 0)


PLAN = "class long, lo long, hi long, sequence long, each long, at long, piece_from long, piece_length long"


def packing_plan(histogram: dict[int, int], capacity: int, gap: float = GAP) -> list[tuple]:
    """PLAN rows: pieces of a class with rank lo..hi-1 go to consecutive sequences, `each` per sequence from `at` on."""
    plan: list[tuple] = []
    used = Counter()
    sequence = histogram.get(capacity, 0)
    if sequence:
        plan.append((capacity, 0, sequence, 0, 1, 0, 0, capacity))
    lengths = np.array(sorted(c for c, n in histogram.items() if n and c != capacity), dtype=np.int64)
    if not len(lengths):
        return plan
    left = {int(c): histogram[int(c)] for c in lengths}
    patterns, counts = solve_patterns(lengths, np.array([left[int(c)] for c in lengths], dtype=float), capacity, gap)
    for p in np.argsort(-counts, kind="stable"):
        pattern = {int(lengths[i]): int(k) for i, k in enumerate(patterns[:, p]) if k}
        times = min([int(counts[p] + 1e-6), *(left[c] // k for c, k in pattern.items())])
        if times <= 0:
            continue
        at = 0
        for c, k in sorted(pattern.items(), reverse=True):
            plan.append((c, used[c], used[c] + k * times, sequence, k, at, 0, c))
            used[c] += k * times
            left[c] -= k * times
            at += k * c
        sequence += times
    # the residual: largest first, the piece that crosses the end is cut
    room, at, carried = capacity, 0, None
    classes = [int(c) for c in lengths[::-1]]
    while carried or any(left.values()):
        if carried:
            c, rank, start, length = carried
            take = min(length, room)
            plan.append((c, rank, rank + 1, sequence, 1, at, start, take))
            carried = (c, rank, start + take, length - take) if take < length else None
        else:
            c = next((c for c in classes if left[c] and c <= room), None)
            if c is None:
                c = min(c for c in classes if left[c])
                carried = (c, used[c], 0, c)
                used[c] += 1
                left[c] -= 1
                continue
            k = min(left[c], room // c)
            plan.append((c, used[c], used[c] + k, sequence, k, at, 0, c))
            used[c] += k
            left[c] -= k
            take = k * c
        at, room = at + take, room - take
        if not room:
            sequence, room, at = sequence + 1, capacity, 0
    return plan


def pack(
    documents: DataFrame, *, tokenizer: str, words: bool, end_id: int, capacity: int = CAPACITY, key: str = "doc_id",
    text: str = "text", gap: float = GAP,
) -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, sequence_id, offset and `ids` (little-endian 32-bit).

    Every whole text is encoded and ends with `end_id`; a null or empty text is that id alone. The pieces of a
    sequence lie from offset 0 without gaps and every id is in one piece. Repeated rows and null keys are
    documents of their own; ties in a class are ordered as the tasks met them. An empty table gives
    no row. Sequence ids run from 0; padding is within `gap` of the tokens plus one sequence.
    """
    classes = length_classes(capacity)
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, met = TaskContext.get().partitionId(), Counter()
        for frame in frames:
            encode = encoder(tokenizer, 4, words).encode
            out = []
            for k, ids in zip(frame["key"], encode(frame["text"]), strict=True):
                ids += end
                n = len(ids) // 4
                for start, length in cut_document(n, capacity, classes):
                    out.append((None if pd.isna(k) else k, start, length, met[length], n, ids[4 * start : 4 * (start + length)]))
                    met[length] += 1
            piece = pd.DataFrame(out, columns=["key", "start", "class", "local", "doc_tokens", "ids"])
            yield piece.astype({"key": "Int64"}).assign(part=part)[["part", "class", "local", "key", "start", "doc_tokens", "ids"]]

    rows = shipped(documents).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    pieces = staged(
        rows.mapInPandas(cut, "part int, class long, local long, key long, start long, doc_tokens long, ids binary"), "pieces",
        FEW_ROWS,
    )
    counts = pieces.groupBy("part", "class").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1), "bases")
    histogram = {r["class"]: r.n for r in bases.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    plan = documents.sparkSession.createDataFrame(packing_plan(histogram, capacity, gap), PLAN)
    ranked = pieces.join(bases.select("part", "class", "base"), ["part", "class"]).withColumn("rank", F.col("base") + F.col("local"))
    placed = ranked.join(F.broadcast(plan), "class").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        F.col("key").alias(key), (F.col("start") + F.col("piece_from")).alias("start"), F.col("piece_length").alias("length"),
        "doc_tokens", (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("at") + nth % F.col("each") * F.col("class")).alias("offset"),
        F.substr("ids", (4 * F.col("piece_from") + 1).cast("int"), (4 * F.col("piece_length")).cast("int")).alias("ids"),
    )


END_ID = 1


@query("op4_cutting_stock")
def op4_cutting_stock(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    packed = pack(
        table(spark, folder, "documents").select("doc_id", "text"),
        tokenizer=public_tokenizers.path("word_bpe_49k.json"), words=True, end_id=END_ID,
    )
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
