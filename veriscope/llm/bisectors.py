r"""Centroid clustering by a bisector tournament.

Vectors and centroids are integers. |x - a|^2 - |x - b|^2 = x . n - t with the integer normal n = 2 (b - a) and the
integer threshold t = |b|^2 - |a|^2, so the sign of one linear form tells which of two centroids is nearer.
Normals and thresholds of all pairs are computed once per round (k (k - 1) / 2 of them; k is bounded by `MOST`).
A vector plays centroid 0 against 1, the winner against 2, and so on: k - 1 sign tests. A zero keeps the smaller
number, which the winner so far always has. Only the distance to the last winner is computed, exactly.

A round is one pass over the vectors without a shuffle of them: a task adds up its vectors per centroid, Spark
adds the tasks' sums, and k x dimensions sums and counts reach the driver. Hot values need no care: no vector is grouped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm.registry import query
from veriscope.llm.shared import shipped, staged, table

K, ROUNDS, SCALE, DIMS, SEED = 16, 3, 64.0, 64, "1"
#: Most centroids: k^2 normals of every dimension are held by each worker.
MOST = 1024
#: Terms of a linear form stay below this bound in 64-bit arithmetic; larger values are Python integers.
_SAFE = 1 << 62
_LONG = 1 << 63


def takes_part(vector: Column, dims: int) -> Column:
    """True for vectors with exactly `dims` components, none of them null or non-finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dims) & ~F.coalesce(odd, F.lit(True))


def floors(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of doubles: 64-bit integers, or Python integers if one does not fit."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not scaled.size or np.abs(scaled).max() < _SAFE:
        return scaled.astype(np.int64)
    exact = [int(s) if math.isfinite(s) else math.floor(Fraction(v) * Fraction(scale)) for s, v in zip(scaled.flat, values.flat, strict=True)]
    out = np.empty(scaled.shape, dtype=object)
    out.flat = exact
    return out


class Bisectors:
    """Normals and thresholds of every pair of centroids (lists of Python integers)."""

    def __init__(self, centroids: list[list[int]]):
        plain = np.empty((len(centroids), len(centroids[0])), dtype=object)
        plain[:] = centroids
        self.largest = max(1, max(abs(int(v)) for v in plain.flat)) if plain.size else 1
        squares = (plain * plain).sum(axis=1)
        self.plain = plain
        self.normals = 2 * (plain[None, :, :] - plain[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]
        # up to this size of a component, 64 bits hold every sum of products with these centroids
        self.limit = math.isqrt(_SAFE // (8 * max(1, plain.shape[1]))) - self.largest
        self.fixed = tuple(x.astype(np.int64) for x in (plain, self.normals, self.thresholds)) if self.limit > self.largest else None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance to it, for every row of integers."""
        narrow = (np.abs(x).max(axis=1) < self.limit).astype(bool) if self.fixed and x.size else np.zeros(len(x), dtype=bool)
        if narrow.all() and len(x):
            return _tournament(x.astype(np.int64), *self.fixed)
        number, distance = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=object)
        for rows, kind in ((np.flatnonzero(narrow), np.int64), (np.flatnonzero(~narrow), object)):
            if len(rows):
                tables = self.fixed if kind is np.int64 else (self.plain, self.normals, self.thresholds)
                number[rows], distance[rows] = _tournament(x[rows].astype(kind), *tables)
        return number, distance


def _tournament(x: np.ndarray, centroids: np.ndarray, normals: np.ndarray, thresholds: np.ndarray):
    winner = np.zeros(len(x), dtype=np.int64)
    for rival in range(1, len(centroids)):
        side = (x * normals[winner, rival]).sum(axis=1) - thresholds[winner, rival]
        winner[(side > 0).astype(bool)] = rival
    away = x - centroids[winner]
    return winner, (away * away).sum(axis=1)


def _integers(batch: pa.RecordBatch, dims: int, scale: float) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return floors(flat.reshape(-1, dims), scale)


def _sums(centroids: list[list[int]], dims: int, scale: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors, k = Bisectors(centroids), len(centroids)
        counts, totals = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=object)
        for batch in batches:
            x = _integers(batch, dims, scale)
            number, _ = bisectors.nearest(x)
            if x.dtype == np.int64 and x.size and int(np.abs(x).max()) * len(x) >= _SAFE:
                x = x.astype(object)
            for c in np.unique(number):
                mine = x[number == c]
                counts[c] += len(mine)
                totals[c] += mine.sum(axis=0).astype(object)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "c": pa.array(np.repeat(used, dims), pa.int32()),
            "d": pa.array(np.tile(np.arange(dims), len(used)), pa.int32()),
            "n": pa.array(np.repeat(counts[used], dims), pa.int64()),
            "s": pa.array([Decimal(int(v)) for v in totals[used].flat], pa.decimal128(38, 0)),
        })

    return run


def _assignments(centroids: list[list[int]], dims: int, scale: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = Bisectors(centroids)
        for batch in batches:
            number, distance = bisectors.nearest(_integers(batch, dims, scale))
            if distance.dtype == object and any(d >= _LONG for d in distance):
                raise ValueError("a squared distance is beyond 64 bits")
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(number, pa.int32()), pa.array(distance.tolist(), pa.int64())],
                names=["key", "cluster", "distance"],
            )

    return run


def first_centroids(kept: DataFrame, k: int, seed: str, scale: float) -> list[list[int]]:
    """The k rows (key, v) least by sha256 of `seed:key`, in that order; equal keys by their components."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    rows = kept.select("v", rank.alias("rank")).orderBy("rank", "v").limit(k).collect()
    return [[int(x) for x in floors(np.array(r.v, dtype=np.float64), scale)] for r in rows]


def moved(kept: DataFrame, centroids: list[list[int]], scale: float) -> list[list[int]]:
    """Centroids after one round: floor(sum / count) of the vectors nearest to each; one without vectors stays."""
    dims = len(centroids[0])
    rows = (
        kept.mapInArrow(_sums(centroids, dims, scale), "c int, d int, n long, s decimal(38,0)")
        .groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # at most k x dims rows
    )
    out = [list(c) for c in centroids]
    for r in rows:
        out[r.c][r.d] = int(r.s) // int(r.n)
    return out


def cluster(
    vectors: DataFrame, *, k: int = K, rounds: int = ROUNDS, scale: float = SCALE, dims: int = DIMS, seed: str = SEED,
    key: str = "vec_id", vector: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """Clusters of the vectors with `dims` finite components, and the final centroids.

    Rows: <key>, cluster int, distance long (squared), cluster_inertia long, inertia long, centroid_sha256. Components
    become floor(scale * x). Centroids start as the k vectors first in the hash order of their keys (all, if fewer),
    move for `rounds` rounds, then every vector is assigned once more; ties go to the smaller number.

    Vectors that are null, of another length, or hold a null or non-finite component give no row. Repeated rows are
    rows of their own. A null key counts as an empty text in the hash order. An empty table gives no rows and no
    centroids. Other columns, whatever they are called, are not read. Large components are exact as well; a squared
    distance or an inertia beyond 64 bits is an error, never a wrapped number.
    """
    if not 0 < k <= MOST:
        raise ValueError(f"k must be from 1 to {MOST}")
    kept = staged(shipped(vectors).select(F.col(key).alias("key"), F.col(vector).alias("v")).filter(takes_part(F.col("v"), dims)), "vectors")
    kept = kept.withColumn("v", F.col("v").cast("array<double>"))
    centroids = first_centroids(kept, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids, scale)
    kind = kept.schema["key"].dataType.simpleString()
    found = kept.mapInArrow(_assignments(centroids, dims, scale), f"key {kind}, cluster int, distance long") if centroids else (
        kept.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    )
    found = staged(found, "clusters")
    wide = F.col("distance").cast("decimal(38,0)")
    per_cluster = staged(found.groupBy("cluster").agg(F.sum(wide).alias("own")), "inertia")  # at most k rows
    total = per_cluster.agg(F.sum("own").alias("all"))
    digests = found.sparkSession.createDataFrame(
        [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)],
        "cluster int, centroid_sha256 string",
    )
    facts = (
        per_cluster.join(F.broadcast(digests), "cluster").crossJoin(F.broadcast(total))
        .select("cluster", F.col("own").cast("long").alias("cluster_inertia"), F.col("all").cast("long").alias("inertia"), "centroid_sha256")
    )
    rows = found.join(F.broadcast(facts), "cluster").select(  # at most k rows
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
    return rows, centroids


def _round_sql(i: int) -> str:
    """CTEs a<i> (vectors with their nearest centroid of c<i>) and c<i + 1>."""
    return f"""
a{i} AS (
  SELECT r, q, min({{'d': list_sum(list_transform(range(1, {DIMS} + 1), lambda i: (q[i] - c[i]) * (q[i] - c[i]))), 'cl': cl}}) AS m
  FROM kept, c{i} GROUP BY r, q),
s{i} AS (
  SELECT cl, list(((s - ((s % n) + n) % n) // n) ORDER BY i) AS c FROM (
    SELECT m.cl AS cl, i, sum(q[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, {DIMS} + 1) AS t(i) GROUP BY 1, 2)
  GROUP BY cl),
c{i + 1} AS (SELECT c{i}.cl, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} ON c{i}.cl = s{i}.cl)"""


_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, embedding,
    list_transform(embedding, lambda x: floor({SCALE}::DOUBLE * x::DOUBLE)::BIGINT::HUGEINT) AS q
  FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, embedding) - 1 AS cl, q AS c FROM (
    SELECT *, sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept) QUALIFY cl < {K}),
{",".join(_round_sql(i) for i in range(ROUNDS))},
last AS (
  SELECT r, min({{'d': list_sum(list_transform(range(1, {DIMS} + 1), lambda i: (q[i] - c[i]) * (q[i] - c[i]))), 'cl': cl}}) AS m
  FROM kept, c{ROUNDS} GROUP BY r)
SELECT vec_id, m.cl::INT AS cluster, m.d::BIGINT AS distance, (sum(m.d) OVER (PARTITION BY m.cl))::BIGINT AS cluster_inertia,
  (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last JOIN kept USING (r) JOIN c{ROUNDS} ON cl = m.cl"""


@query("op11_bisector_clusters", _SQL)
def op11_bisector_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster(table(spark, folder, "embeddings").select("vec_id", "embedding"))[0]
