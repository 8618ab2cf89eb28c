r"""Token-id output: documents compressed one by one with a shared zstandard dictionary.

A store is a folder of three Parquet tables, so that Spark's committer makes writes whole and any
file system holds them:

- `dictionary`: one row (hash, tokenizer, width, dictionary). The zstandard dictionary is trained on
  serialized id arrays of at most `sample` distinct texts, the first in a hash order;
  it decides how small frames get, never what they hold.
- `blocks`: (part, block, data, entries) with frames one after another, about `block_bytes` each, and what
  the index says of them.
- `index`: (part, seq, doc_id, block, offset, length, n_tokens, part_start, dictionary_hash), an entry per
  document. One short document is an index row, one block and one slice. `bases` has the ids before a part.

Documents are range-partitioned by doc_id, so parts in order are documents in order. `start`, the ids
before a document, is the base of its part plus its start in the part; bases are a running
sum over one row per part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriscope.llm.registry import query
from veriscope.llm.shared import FEW_ROWS, arrow_batches, fresh_folder, shipped, staged, table
from veriscope.llm.tokens import encoder

SAMPLE, DICTIONARY_BYTES, LEVEL = 2_000, 64 << 10, 3
BLOCK_BYTES = 1 << 20


def train_dictionary(arrays: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary over serialized id arrays; empty (no dictionary) if they are too few to train one."""
    cut = [a[: 16 << 10] for a in arrays if len(a) >= 8]
    try:
        return zstandard.train_dictionary(size, cut).as_bytes() if len(cut) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_store(
    documents: DataFrame, folder: str, *, tokenizer: str, end_id: int, key: str = "doc_id",
    text: str = "text", sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES,
) -> str:
    """Encodes every whole text, appends `end_id` and writes the store to `folder`; returns its dictionary hash.

    A null or empty text is the end id alone. A null key comes first; rows with equal keys are ordered by
    their ids, each with an entry of its own. An empty table gives a store without entries.
    """
    spark = shipped(documents).sparkSession
    end = np.array([end_id], dtype="<u4").tobytes()

    def ids(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(tokenizer, 4).encode
        for texts in frames:
            yield pd.Series([x + end for x in encode(texts)], dtype=object)

    to_ids = F.pandas_udf(ids, "binary")
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hashed = rows.select("text", F.xxhash64("text").alias("h"))
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    chosen = hashed.filter(F.col("h") <= max(least, default=0)).dropDuplicates(["h"]).select(F.substring(to_ids("text"), 1, 16 << 10).alias("x"))
    with arrow_batches(spark, FEW_ROWS):
        dictionary = train_dictionary(sorted(bytes(r.x) for r in chosen.collect()))
    digest = hashlib.sha256(dictionary).hexdigest()

    def frames_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, 4).encode
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_dict_id=False).compress
        for batch in batches:
            arrays = [x + end for x in encode(batch.column("text").to_pylist())]
            counts, data = pa.array([len(a) // 4 for a in arrays], pa.int64()), pa.array(map(compress, arrays), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, data], names=["doc_id", "n_tokens", "frame"])

    made = staged(
        rows.select("doc_id", "text").mapInArrow(frames_of, "doc_id long, n_tokens long, frame binary")
        .select("*", F.xxhash64("frame").alias("tie"), F.monotonically_increasing_id().alias("row")),
        "frames", FEW_ROWS,
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, size, block, start, seq = [], 0, 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids, counts, data = (pa.concat_arrays([h.column(c) for h in held]) for c in ("doc_id", "n_tokens", "frame"))
            lengths, n = pc.binary_length(data).to_numpy(), counts.to_numpy()
            entries = pa.StructArray.from_arrays(
                [pa.array(seq + np.arange(len(n))), ids, pa.array(np.cumsum(lengths) - lengths, pa.int32()), pa.array(lengths, pa.int32()),
                 counts, pa.array(start + np.cumsum(n) - n)],
                names=["seq", "doc_id", "offset", "length", "n_tokens", "part_start"],
            )
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([b"".join(data.to_pylist())], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), entries)],
                names=["part", "block", "data", "entries"],
            )

        for batch in batches:
            ends, first = np.append(0, np.cumsum(pc.binary_length(batch.column("frame")).to_numpy(), dtype=np.int64)), 0
            while first < batch.num_rows:  # up to the row that fills the block
                last = min(int(np.searchsorted(ends, ends[first] + block_bytes - size)), batch.num_rows)
                held.append(batch.slice(first, last - first))
                size, first = size + int(ends[last] - ends[first]), last
                if size >= block_bytes:
                    yield flush()
                    start, seq = start + sum(pc.sum(h.column("n_tokens")).as_py() for h in held), seq + sum(h.num_rows for h in held)
                    held, size, block = [], 0, block + 1
        if held:
            yield flush()

    order = ["doc_id", "tie", "row"]
    (
        made.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "frame")
        .mapInArrow(
            blocks,
            "part int, block int, data binary, "
            "entries array<struct<seq:long,doc_id:long,offset:int,length:int,n_tokens:long,part_start:long>>",
        )
        .write.option("compression", "none").parquet(f"{folder}/blocks")
    )
    index = spark.read.parquet(f"{folder}/blocks").select("part", "block", F.explode("entries").alias("e")).select("part", "block", "e.*")
    index.withColumn("dictionary_hash", F.lit(digest)).write.parquet(f"{folder}/index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    (
        spark.read.parquet(f"{folder}/index").groupBy("part").agg(F.sum("n_tokens").alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "base")
        .write.parquet(f"{folder}/bases")
    )
    spark.createDataFrame(
        [(digest, tokenizer, 4, bytearray(dictionary))], "hash string, tokenizer string, width int, dictionary binary"
    ).write.parquet(f"{folder}/dictionary")
    return digest


def _opened(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    data = bytes(row.dictionary)
    if hashlib.sha256(data).hexdigest() != row.hash:
        raise ValueError("the dictionary of this store does not have the hash it is kept under")
    return row.hash, data


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the store, ids as little-endian 32-bit integers.

    Fails if the dictionary, or the one an index entry was written with, is not the store's own.
    """
    digest, dictionary = _opened(spark, folder)
    data = spark.read.parquet(f"{folder}/blocks")
    foreign = spark.read.parquet(f"{folder}/index").filter(F.col("dictionary_hash") != digest)
    if not foreign.isEmpty():
        raise ValueError("entries of this store were written with another dictionary")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
        for batch in batches:
            for part, block, entries in zip(batch.column("part"), batch.column("data"), batch.column("entries"), strict=True):
                e = pa.RecordBatch.from_struct_array(entries.values)
                kept, offsets = block.as_py(), e.column("offset").to_pylist()
                ids = [inflate(kept[at : at + size]) for at, size in zip(offsets, e.column("length").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(part, len(ids)), e.column("doc_id"), e.column("part_start"), e.column("n_tokens"), pa.array(ids, pa.binary())],
                    names=["part", "doc_id", "part_start", "n_tokens", "ids"],
                )

    return (
        data.select("part", "data", "entries").mapInArrow(frames, "part int, doc_id long, part_start long, n_tokens long, ids binary")
        .join(spark.read.parquet(f"{folder}/bases"), "part")
        .select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")
    )


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """The id arrays kept under a doc_id: one index lookup, one block and one frame each."""
    digest, dictionary = _opened(spark, folder)
    inflate = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
    out = []
    for e in spark.read.parquet(f"{folder}/index").filter(F.col("doc_id") == doc_id).orderBy("part", "seq").collect():
        if e.dictionary_hash != digest:
            raise ValueError(f"part {e.part} was written with dictionary {e.dictionary_hash}")
        block = spark.read.parquet(f"{folder}/blocks").filter((F.col("part") == e.part) & (F.col("block") == e.block))
        frame = block.select(F.expr(f"substring(data, {e.offset + 1}, {e.length})").alias("x")).first().x
        out.append(np.frombuffer(inflate(bytes(frame)), dtype="<u4"))
    return out


END_ID = 2


@query("op3_token_store")
def op3_token_store(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    store = fresh_folder(spark, "store")
    write_store(
        table(spark, folder, "documents").select("doc_id", "text"), store,
        tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=END_ID,
    )
    return read_store(spark, store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
