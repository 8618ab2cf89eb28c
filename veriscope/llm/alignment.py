r"""Alignment of the tokens of two tokenizers over the same bytes.

A text is encoded whole by A and by B; both token lists end at byte offsets of the same string, a blank and the text.
Merging the two sorted lists of ends gives everything: each distinct end closes one overlap of an A token and a
B token (a link), and an end that both lists hold cuts a group.

The merge is cut by merge-path partitioning: on the diagonal of every `work`-th merged end a binary search finds how
many ends of A and of B lie before it, for all diagonals at once. The pieces between two diagonals do equal
work, whatever the documents' lengths are, and are merged independently; each emits its overlaps and the cuts
it holds. A group that crosses a piece's border is stitched from the cuts on both sides of it.

Corpus counts are the number of documents per id pair: tasks count distinct pairs of their documents before the shuffle.
Looking them up, pairs that many documents hold never travel: the most frequent ones (at most `HOT` by a count
of pairs per power of two of their counts) are broadcast, and only the other pairs of a document are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm.registry import query
from veriscope.llm.shared import shipped, staged, table
from veriscope.llm.tokens import PieceEncoder, byte_letters

#: Ends that one piece of the merge holds; bytes of texts that are aligned at once (a longer text is aligned alone).
WORK, STEP_BYTES, STEP_TEXTS = 1 << 16, 2 << 20, 1 << 14
#: Most pairs broadcast for look-up: 16 bytes each and their hash table, some 50 MB.
HOT = 1 << 20
#: Ids stay below 2**24, so a pair and the place of a text in its step fit 64 bits.
_ID_BITS = 24


class _Tokens:
    """Bytes and decimal forms of a vocabulary's tokens."""

    def __init__(self, entries: list[bytes], last: bytes):
        if len(entries) >= 1 << _ID_BITS:
            raise ValueError("a vocabulary of more than 2**24 entries")
        self.bytes = entries
        self.lengths = np.array([len(e) for e in entries], dtype=np.int64)
        width = len(str(len(entries))) + 1
        self.between = np.array([b"%d," % i for i in range(len(entries))], dtype=f"S{width}")
        self.last = np.array([b"%d" % i + last for i in range(len(entries))], dtype=f"S{width}")


class Pair:
    """Tokenizers A (byte-level BPE) and B (pieces with byte fallback, which adds a blank itself)."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.encoder = PieceEncoder(path_a, 4, words=False)
        back = {chr(c): b for b, c in byte_letters().items()}
        names = self.encoder.whole.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            # an added token outside the byte alphabet is never an id of plain text
            entries[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        self.a = _Tokens(entries, b"|")
        self.pieces = SentencePieceProcessor(model_file=path_b)
        self.b = _Tokens([self._piece(i) for i in range(self.pieces.get_piece_size())], b";")

    def _piece(self, i: int) -> bytes:
        name = self.pieces.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.pieces.is_byte(i) else name.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B for every text; None if either side's bytes are not a blank and the text."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, a, b in zip(texts, self.encoder.encode_after_blank(texts), self.pieces.encode(texts, num_threads=1), strict=True):
            ids = np.frombuffer(a, dtype="<u4")
            whole = b" " + text.encode()
            good = text and b"".join(map(self.b.bytes.__getitem__, b)) == whole and b"".join(map(self.a.bytes.__getitem__, ids.tolist())) == whole
            out.append((ids.astype(np.int64), np.array(b, dtype=np.int64)) if good else None)
        return out


@lru_cache(maxsize=2)
def _pair(path_a: str, path_b: str) -> Pair:
    """One pair of tokenizers per worker process, kept between tasks."""
    return Pair(path_a, path_b)


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of a and of b lie before every `work`-th place of their merge, first and last place included.

    Equal ends count a's first; a border between two equal ends is moved behind both.
    """
    total = len(a) + len(b)
    place = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(0, place - len(b)), np.minimum(place, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        at = np.where(open_, middle, 0)
        before = np.zeros(len(place), dtype=bool)
        before[open_] = a[at[open_]] <= b[(place - 1 - at)[open_]]
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    i, j = low, place - low
    split = np.zeros(len(place), dtype=bool)
    inner = (i > 0) & (j < len(b))
    split[inner] = a[i[inner] - 1] == b[j[inner]]
    return i, j + split


def merge_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int):
    """Overlaps of one piece: distinct ends in order, the tokens of a and b that reach them, and which ends both hold."""
    ours, theirs = a[i0:i1], b[j0:j1]
    ends = np.concatenate([ours, theirs])
    ends.sort(kind="stable")
    both = np.empty(len(ends), dtype=bool)
    both[:1], both[1:] = False, ends[1:] == ends[:-1]
    # an end that occurs twice stays once, marked
    first = ~both
    shared = np.append(both[1:], False)[first] if len(ends) else both
    ends = ends[first]
    return ends, i0 + np.searchsorted(ours, ends), j0 + np.searchsorted(theirs, ends), shared


@dataclass
class Merged:
    """Links by distinct end (their A and B token), and the group of every token."""

    ends: np.ndarray
    a: np.ndarray
    b: np.ndarray
    cuts: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray


def merged(a: np.ndarray, b: np.ndarray, work: int = WORK) -> Merged:
    """Merge of two strictly ascending lists of ends with the same last end, piece by piece, groups stitched."""
    i, j = diagonals(a, b, work)
    pieces = [merge_piece(a, b, *x) for x in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True)]
    empty = np.empty(0, dtype=np.int64)
    ends, left, right, shared = (np.concatenate(x) for x in zip(*pieces, strict=True)) if pieces else (empty, empty, empty, empty.astype(bool))
    cuts = ends[shared]
    return Merged(ends, left, right, cuts, np.searchsorted(cuts, a), np.searchsorted(cuts, b))


def group_text(pair: Pair, ids_a: np.ndarray, ids_b: np.ndarray, m: Merged) -> np.ndarray:
    """Tokens in the order of `a1,a2|b1;a3|b2,b3`, each with the character behind it, as padded bytes."""
    def last(groups: np.ndarray) -> np.ndarray:
        return np.append(groups[1:] != groups[:-1], True)[: len(groups)]

    out = np.empty(len(ids_a) + len(ids_b), dtype=max(pair.a.last.dtype, pair.b.last.dtype, key=lambda t: t.itemsize))
    out[np.arange(len(ids_a)) + np.searchsorted(m.b_group, m.a_group, "left")] = np.where(last(m.a_group), pair.a.last[ids_a], pair.a.between[ids_a])
    out[np.arange(len(ids_b)) + np.searchsorted(m.a_group, m.b_group, "right")] = np.where(last(m.b_group), pair.b.last[ids_b], pair.b.between[ids_b])
    return out


def align_texts(pair: Pair, texts: list[str | None], work: int = WORK) -> dict[str, np.ndarray | list]:
    """Of every text: n_a, n_b, n_groups, n_links, groups_sha256, and its distinct id pairs with how often each is linked.

    `pairs` and `times` hold the pairs of all texts one after another, `held` how many each text has. A pair is
    a's id times 2**32 plus b's. Texts without tokens have zeros and an empty hash.
    """
    found = pair.encode([t or "" for t in texts])
    kept = np.array([f is not None for f in found], dtype=bool)
    n = len(texts)
    n_a, n_b = (np.array([0 if f is None else len(f[side]) for f in found], dtype=np.int64) for side in (0, 1))
    empty = [np.empty(0, dtype=np.int64)]
    ids_a, ids_b = (np.concatenate(empty + [f[side] for f in found if f is not None]) for side in (0, 1))
    ends_a, ends_b = np.cumsum(pair.a.lengths[ids_a]), np.cumsum(pair.b.lengths[ids_b])
    m = merged(ends_a, ends_b, work)
    # where each text ends, in tokens and in bytes; those without tokens end where the one before does
    last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
    byte = np.append(0, ends_a)[last_a]
    links, groups = np.searchsorted(m.ends, byte, "right"), np.searchsorted(m.cuts, byte, "right")
    tokens = group_text(pair, ids_a, ids_b, m)
    digests, before = [], 0
    for at, good in zip(last_a + last_b, kept, strict=True):
        digests.append(hashlib.sha256(tokens[before:at].tobytes().replace(b"\0", b"")[:-1]).hexdigest() if good else "")
        before = at
    owner = np.repeat(np.arange(n), np.diff(links, prepend=0))
    code = (owner << (2 * _ID_BITS)) | (ids_a[m.a] << _ID_BITS) | ids_b[m.b]
    distinct, times = np.unique(code, return_counts=True)
    low = (1 << _ID_BITS) - 1
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.diff(groups, prepend=0), "n_links": np.diff(links, prepend=0), "groups_sha256": digests,
        "held": np.bincount(distinct >> (2 * _ID_BITS), minlength=n), "times": times,
        "pairs": (((distinct >> _ID_BITS) & low) << 32) | (distinct & low),
    }


def _steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text or "")
        if size >= STEP_BYTES or at + 1 - start >= STEP_TEXTS:
            yield start, at + 1
            start, size = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


def aligned(documents: DataFrame, *, tokenizer_a: str, tokenizer_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's own figures, as a written table: row, key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(tokenizer_a, tokenizer_b)
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for start, end in _steps(texts):
                x = align_texts(pair, texts[start:end])
                offsets = pa.array(np.append(0, np.cumsum(x["held"])), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(start, end - start), *[pa.array(x[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                     pa.array(x["groups_sha256"], pa.string()), pa.ListArray.from_arrays(offsets, pa.array(x["pairs"], pa.int64())),
                     pa.ListArray.from_arrays(offsets, pa.array(x["times"], pa.int64()))],
                    names=["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    kind = documents.schema[key].dataType.simpleString()
    shape = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    rows = shipped(documents).select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(run, shape)
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """Written table (pair, n, best): documents per id pair, and whether that is the highest count of its A id."""
    counts = staged(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a_id = F.shiftright("pair", 32)
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("top"))
    return staged(
        counts.withColumn("a", a_id).join(highest, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pairs"
    )


def hot_from(counts: DataFrame, most: int) -> int:
    """Least power of two such that at most `most` pairs are held by that many documents."""
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r.p: r.c for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("c")).collect()}  # at most 64 rows
    total, least = 0, 63
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > most:
            break
        least = p
    return 1 << least if sizes else 1


def align(
    documents: DataFrame, *, tokenizer_a: str, tokenizer_b: str, key: str = "doc_id", text: str = "text", hot: int = HOT,
) -> tuple[DataFrame, DataFrame]:
    """Per document <key>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and the table (a_id, b_id, n, best).

    A row is a document, also if it is repeated. A text that is null or empty, or that either tokenizer does not give
    back byte for byte (with a blank before it), has no tokens: zeros and an empty hash. A null key stays null. An
    empty table gives no rows. Other columns are not read.
    """
    rows = aligned(documents, tokenizer_a=tokenizer_a, tokenizer_b=tokenizer_b, key=key, text=text)
    counts = pair_counts(rows)
    limit = hot_from(counts, hot)
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    common = F.broadcast(counts.filter(F.col("n") >= limit))  # at most `hot` rows
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    scored = links.join(common, "pair").groupBy("row").agg(*sums)
    rare = counts.filter(F.col("n") < limit)
    if limit > 1 and not rare.isEmpty():
        others = links.join(common, "pair", "left_anti").join(rare, "pair").groupBy("row").agg(*sums)
        scored = scored.unionByName(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = rows.drop("pairs", "times").join(scored, "row", "left").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
    ids = counts.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id"), "n", "best")
    return out, ids


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return align(
        table(spark, folder, "documents").select("doc_id", "text"),
        tokenizer_a=public_tokenizers.path("byte_bpe_50k.json"), tokenizer_b=public_tokenizers.path("piece_bpe_32k.model"),
    )[0]
