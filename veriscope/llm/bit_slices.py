r"""Exact top-k inner products by a bit-sliced index.

A vector is quantised to integers. The index keeps, per block of rows, one bitmap for each bit of
each attribute (bit i of attribute d over all rows of the block). A query multiplies by adding:
for each set digit of its own component (binary, with signs) the attribute's slices enter the score at
that weight, summed by carry-save adders on all bitmaps of a number at once, 64 rows a word. The score
slices are then read from the most significant one downward: rows are split by the bit until k are
certain, and rows that tie at the boundary are taken in ascending id, the order in which a block stores
them. The result is exact.

Blocks have a fixed number of rows and query batches a fixed number of queries (fewer of long vectors),
whatever the keys are, so equal vectors spread like others. A block meets every batch once (a stated query
set against all rows, in blocks). Blocks and batches are rows of two stored tables; a task reads its share of
either, and no copy of a block is made for a batch. It keeps k rows per query, Spark the best of all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriscope.llm.registry import query
from veriscope.llm.shared import FEW_ROWS, shipped, staged, table

SCORE = "decimal(38,0)"
LIMIT = float(1 << 63)  # quantised components are 64-bit integers, as in the SQL; sums of products may be longer
BLOCK_VALUES, BATCH_VALUES = 1 << 23, 1 << 18  # components of a block and of a query batch at most: what a task holds, for vectors of any length
MEETINGS = 512  # query batches grow with the table up to their limit, so that there are about so many meetings


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component as long; null for a vector that takes no part.

    Null vectors, vectors without components and vectors with a null or non-finite component take no part. A finite
    component whose quantised value is no 64-bit integer is an error, as in the SQL: no vector is left out unsaid.
    """
    def whole(x: Column) -> Column:
        scaled = x.cast("double") * F.lit(float(scale))
        too_large = F.raise_error(F.lit("a quantised component is beyond 64 bits")).cast("long")
        return F.when(F.abs(scaled) >= LIMIT, too_large).otherwise(F.floor(scaled))

    wide = F.transform(vector, whole)
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, odd), F.lit(True)), wide)


def build_slices(values: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Bitmaps [attribute, bit, word], the least value and the number of bits, of rows x attributes."""
    low = int(values.min())
    shifted = (values - low).astype(np.uint64)
    bits = max(1, int(shifted.max()).bit_length())
    rows = values.shape[0]
    narrow = np.dtype(f"u{next(size for size in (1, 2, 4, 8) if bits <= 8 * size)}")
    padded = np.zeros((values.shape[1], -(-rows // 64) * 64), dtype=narrow)
    padded[:, :rows] = shifted.T
    out = np.empty((values.shape[1], bits, padded.shape[1] // 64), dtype=np.uint64)
    for b in range(bits):
        out[:, b] = np.packbits(padded & narrow.type(1 << b), axis=1, bitorder="little").view(np.uint64)
    return out, low, bits


def digits(q: int) -> tuple[int, int]:
    """Two numbers without a common bit, the first less the second is q: its signed binary digits, a third of them set."""
    size = abs(q)
    three, odd = 3 * size, size ^ (3 * size)
    plus, minus = (three & odd) >> 1, (size & odd) >> 1
    return (plus, minus) if q > 0 else (minus, plus)


def score_slices(slices: np.ndarray, signed: list[tuple[int, int]]) -> list[np.ndarray]:
    """Bitmaps, least significant first, of the sum of plus_d * u_d + minus_d * (not u_d) over (plus_d, minus_d) of `signed`."""
    bits = slices.shape[1]
    # numbers to be added by the weight of their first bitmap: all bitmaps of a number go through an adder at once
    numbers: list[list[np.ndarray]] = []
    for planes, (plus, minus) in zip(slices, signed, strict=True):
        if not plus | minus:
            continue
        flipped = ~planes if minus else planes
        for shift in range((plus | minus).bit_length()):
            while len(numbers) <= shift:
                numbers.append([])
            if plus >> shift & 1:
                numbers[shift].append(planes)
            elif minus >> shift & 1:
                numbers[shift].append(flipped)
    columns: list[list[np.ndarray]] = []
    at = 0
    while at < len(numbers):
        column = numbers[at]
        if len(numbers) == at + 1 and len(column) > 2:
            numbers.append([])
        while len(column) > 2:  # three numbers of a weight make one of it and one of the next
            total, carry = _added(column.pop(), column.pop(), column.pop())
            column.append(total)
            numbers[at + 1].append(carry)
        while column and len(columns) < at + bits:
            columns.append([])
        for number in column:
            for b in range(bits):
                columns[at + b].append(number[b])
        numbers[at] = []
        at += 1
    out, at = [], 0
    while at < len(columns):
        column = columns[at]
        if len(columns) == at + 1 and len(column) > 1:
            columns.append([])
        while len(column) > 2:  # the same with single bitmaps
            total, carry = _added(column.pop(), column.pop(), column.pop())
            column.append(total)
            columns[at + 1].append(carry)
        if len(column) == 2:
            a, b = column
            columns[at + 1].append(a & b)
            column = [a ^ b]
        out.append(column[0] if column else np.zeros(slices.shape[2], dtype=np.uint64))
        columns[at] = []
        at += 1
    return out


def _added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the sum and carries of three bitmaps (or of as many as an array holds)."""
    ab = a ^ b
    carry = a & b
    carry |= ab & c
    ab ^= c
    return ab, carry


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def top_rows(score: list[np.ndarray], candidates: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best candidates, ties to the smaller position, unordered."""
    certain = np.zeros_like(candidates)
    open_rows, missing = candidates, k
    for plane in reversed(score):
        if missing <= 0:
            break
        ones = open_rows & plane
        n = _count(ones)
        if n > missing:
            open_rows = ones
        else:
            certain, missing, open_rows = certain | ones, missing - n, open_rows & ~plane
    return np.concatenate([_rows(certain), _rows(open_rows)[: max(missing, 0)]])


def _search(block: dict, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For every query its k best rows of the block as (-score, id)."""
    bits, low = block["bits"], block["low"]
    slices = np.frombuffer(block["slices"], dtype=np.uint64).reshape(block["dims"], bits, -1)
    ids = np.frombuffer(block["ids"], dtype=np.int64)
    everyone = np.zeros(slices.shape[2] * 64, dtype=np.uint8)
    everyone[: len(ids)] = 1
    everyone = np.packbits(everyone, bitorder="little").view(np.uint64)
    for query_id, q in zip(query_ids.tolist(), queries, strict=True):
        candidates = everyone
        lo, hi = np.searchsorted(ids, query_id, "left"), np.searchsorted(ids, query_id, "right")
        if hi > lo:
            own = np.zeros(len(everyone) * 64, dtype=np.uint8)
            own[lo:hi] = 1
            candidates = everyone & ~np.packbits(own, bitorder="little").view(np.uint64)
        signed = [digits(x) for x in q.tolist()]
        score = score_slices(slices, signed)
        best = top_rows(score, candidates, k)
        # from sums of shifted or flipped values back to the inner product
        ceiling = (1 << bits) - 1
        back = sum(q.tolist()) * low - sum(minus for _, minus in signed) * ceiling
        # sums that could leave 64 bits are added as Python integers
        kind = np.int64 if len(score) <= 62 and abs(back) < 1 << 62 else object
        total = np.zeros(len(best), dtype=kind)
        for b, plane in enumerate(score):
            total += ((plane[best >> 6] >> (best & 63).astype(np.uint64)) & np.uint64(1)).astype(kind) << b
        total += back
        yield query_id, [(-int(value), int(ids[at])) for at, value in zip(best, total, strict=True)]


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, *, key: str = "vec_id", vector: str = "embedding",
    scale: float = 256.0, block_rows: int = 65_536, batch_queries: int = 64,
) -> DataFrame:
    """The k highest inner products of every query row: query_id, rank, <key>, score.

    Candidates are all rows but those with the query's own key; ties go to the smaller key; a query
    with fewer candidates returns all. Vectors that take no part (see `quantised`) and rows with a null key
    are neither queries nor candidates. Only vectors of equal length meet. Rows repeated with one
    key are candidates each; as queries they count once (the first by its components). A score is an
    exact integer of up to 38 digits; a longer one is an error.
    """
    rows = staged(
        shipped(vectors).select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), is_query.alias("is_query"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull())
        .withColumns({"dims": F.size("v"), "row": F.monotonically_increasing_id()}),
        "vectors",
    )
    per_dims = {r.dims: r.n for r in rows.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    parts = [_top_k_of(rows.filter(F.col("dims") == d), d, n, k, block_rows, batch_queries) for d, n in sorted(per_dims.items())]
    found = parts[0] if parts else rows.select(F.col("id").alias("query_id"), "id", F.lit(0).cast(SCORE).alias("score")).limit(0)
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(key), "score")
    )


def _top_k_of(rows: DataFrame, dims: int, n: int, k: int, block_rows: int, batch_queries: int) -> DataFrame:
    blocks = -(-n // min(block_rows, max(64, BLOCK_VALUES // dims)))

    def build(rows: pa.Table) -> pa.Table:
        ids = rows["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        values = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        slices, low, bits = build_slices(values[order])
        return pa.table({
            "dims": pa.array([dims], pa.int32()), "bits": pa.array([bits], pa.int32()), "low": [low],
            "ids": [ids[order].tobytes()], "slices": [slices.tobytes()],
        })

    # rows are dealt by their number, not by their key; a task gets a few blocks, so few are written or read at once
    index = staged(
        rows.select("id", "v", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
        .repartition(blocks, "block").groupBy("block")
        .applyInArrow(build, "dims int, bits int, low long, ids binary, slices binary"),
        "slices",
    )
    asked = rows.filter("is_query").groupBy("id").agg(F.min("v").alias("v"))
    count = asked.count()
    size = max(batch_queries, min(-(-count * blocks // MEETINGS), BATCH_VALUES // dims))
    batches = max(1, -(-count // size))

    def pack(rows: pa.Table) -> pa.Table:
        ids, values = rows["id"].to_numpy(), rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({"batch": rows["batch"][:1], "query_ids": [ids.tobytes()], "queries": [values.tobytes()]})

    queries = staged(
        asked.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")).groupBy("batch")
        .applyInArrow(pack, "batch int, query_ids binary, queries binary"),
        "queries",
    )

    def meet(pairs: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple[int, int]]] = {}
        for pair in (row for some in pairs for row in some.to_dict("records")):
            query_ids = np.frombuffer(pair["query_ids"], dtype=np.int64)
            asked = np.frombuffer(pair["queries"], dtype=np.int64).reshape(len(query_ids), -1)
            for query_id, found in _search(pair, asked, query_ids, k):
                best[query_id] = sorted(best.get(query_id, []) + found)[:k]
        while best:
            some = [best.popitem() for _ in range(min(FEW_ROWS, len(best)))]
            out = [(query_id, i, Decimal(-score)) for query_id, found in some for score, i in found]
            yield pd.DataFrame(out, columns=["query_id", "id", "score"]).astype({"query_id": "int64", "id": "int64", "score": "object"})

    # every block meets every batch: a task reads its blocks and its batch where they are stored, neither is copied for it
    pairs = index.crossJoin(queries.repartitionByRange(batches, "batch").drop("batch").hint("shuffle_replicate_nl"))
    return staged(pairs.mapInPandas(meet, f"query_id long, id long, score {SCORE}"), "found", 1)


SCALE, K, EVERY = 256.0, 5, 50
_OK = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query("op9_bit_sliced_top_k", rf"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)::BIGINT::HUGEINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND {_OK}),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % {EVERY} = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}""")
def op9_bit_sliced_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = top_k(vectors, F.col("vec_id") % EVERY == 0, K, scale=SCALE)
    # as in the SQL, a score beyond 64 bits is an error
    fits = F.abs("score") < F.lit(str(1 << 63)).cast(SCORE)
    score = F.when(fits, F.col("score").cast("long")).otherwise(F.raise_error(F.lit("op9: a score is beyond 64 bits")).cast("long"))
    return found.withColumn("score", score)
