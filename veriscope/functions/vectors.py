"""Vector arithmetic on Arrow batches.

Spark has no dot product over arrays; a lambda per element is interpreted, so
the arithmetic runs in numpy over whole Arrow batches without building Python
objects per row.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these functions with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _flat(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements as doubles, start offset and length of each vector (null = empty)."""
    lengths = np.nan_to_num(
        vectors.value_lengths().to_numpy(zero_copy_only=False).astype("float64")
    ).astype("int64")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64")
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    return flat, starts, lengths


def _segment_sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths))
    filled = lengths > 0
    if filled.any():
        out[filled] = np.add.reduceat(values, starts[filled])
    return out


@F.arrow_udf(T.DoubleType())
def norm(vector: pa.Array) -> pa.Array:
    """Euclidean length; 0 for a null or empty vector."""
    flat, starts, lengths = _flat(vector)
    return pa.array(np.sqrt(_segment_sums(flat * flat, starts, lengths)))


@F.arrow_udf(T.DoubleType())
def cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    """Cosine similarity; 0 for a zero vector or differing dimensions."""
    lf, ls, ll = _flat(left)
    rf, rs, rl = _flat(right)
    out = np.zeros(len(ll))
    usable = (ll == rl) & (ll > 0)
    if usable.any():
        if usable.all():
            a, b = lf, rf
        else:
            a = lf[np.repeat(usable, ll)]
            b = rf[np.repeat(usable, rl)]
        lengths = ll[usable]
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        dot = np.add.reduceat(a * b, starts)
        size = np.sqrt(np.add.reduceat(a * a, starts)) * np.sqrt(np.add.reduceat(b * b, starts))
        out[usable] = np.divide(dot, size, out=np.zeros_like(dot), where=size != 0)
    return pa.array(out)


def unit_rows(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per dimension the row numbers and the vectors at length 1; a zero vector stays zero.

    Null and empty vectors and those with a null or non-finite element are left out.
    """
    flat, starts, lengths = _flat(vectors)
    out = {}
    for size in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == size)
        values = flat[starts[rows][:, None] + np.arange(size)]
        usable = np.isfinite(values).all(axis=1)
        rows, values = rows[usable], values[usable]
        if len(rows):
            length = np.sqrt((values * values).sum(axis=1))[:, None]
            out[int(size)] = rows, np.divide(values, length, out=np.zeros_like(values), where=length != 0)
    return out


def partial_sums(key: str, vector: str, zero_norm: float):
    """For `mapInArrow`: per batch and key, the count and element sums of its usable vectors.

    A batch shrinks to one row per key and dimension before anything is shuffled.
    """
    schema = pa.schema(
        [
            (key, pa.string()),
            ("dimension", pa.int32()),
            ("seen", pa.int64()),
            ("used", pa.int64()),
            ("sums", pa.list_(pa.float64())),
        ]
    )

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, starts, lengths = _flat(batch.column(vector))
            usable = np.sqrt(_segment_sums(flat * flat, starts, lengths)) > zero_norm
            keys = batch.column(key).dictionary_encode()
            codes = keys.indices.to_numpy(zero_copy_only=False)
            out = []
            for code, label in enumerate(keys.dictionary.to_pylist()):
                for size in np.unique(lengths[codes == code]):
                    mine = (codes == code) & (lengths == size)
                    good = np.flatnonzero(mine & usable)
                    rows = flat[starts[good][:, None] + np.arange(size)]
                    out.append((label, int(size), int(mine.sum()), len(good), rows.sum(axis=0).tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, f.type) for column, f in zip(zip(*out), schema)], schema=schema
            )

    return run
