r"""Near duplicates by SuperMinHash, banding, verification and union-find.

A text becomes the set of its w-word shingles. In SuperMinHash an element does not draw one value per
slot: it owns a permutation of the slots and the slot at permutation position j gets j plus a
fraction. The ranks of an element are correlated (each slot gets another rank), which lowers
the variance, and an element can stop as soon as every slot holds a rank below its next one; all
elements of a batch of texts step together. The permutation is affine modulo a prime slot count.

Texts with equal sets are one node. Nodes that share a band of the signature are candidates:

1. in every band bucket all members are compared with a few central pivots (the nodes that share
   bands with most others), so a group of n near copies costs n comparisons a pivot and not n * n / 2;
2. verified links are joined to components;
3. where a bucket still holds several components, the members outside its largest one look for
   partners by an exact prefix filter: both must hold one of each other's rarest shingles, early enough
   that a link is still possible. No link inside a bucket is lost by the pivots.

Every comparison uses the full shingle sets. With 56 bands of 6 slots a pair at similarity 0.8 would share no bucket
with a probability of 4e-8 if slots were independent. Slots of small sets are not: 4 of 1,044,000 pairs of 4 and 5 shingles
at exactly 0.8 were measured to share none. Sets of up to SMALL shingles are therefore found exactly: they and the
slightly larger ones that can be linked with them also share a bucket per shingle of their prefix, the first shingles
in the order of their hashes of which two linked sets must have one in common.
Shingle sets are made for nodes with a candidate only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriscope.llm.components import components
from veriscope.llm.registry import query
from veriscope.llm.shared import FEW_ROWS, LOWER, UPPER, shipped, staged, table

SLOTS, BANDS, ROWS = 337, 56, 6
PIVOTS = 4
#: Linked pairs with a set of at most this size share a bucket for certain.
SMALL = 15
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RANK = np.uint64(48)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, no word gives none."""
    words = text.encode().translate(_FOLD).split() if text else ()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    span = min(width, n)
    out = np.full(n - span + 1, np.uint64(span))
    for k in range(span):
        out = _mix(out + _M1) ^ hashes[k : n - span + 1 + k]
    return np.unique(_mix(out))


def super_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures [text, SLOTS] of non-empty sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    seeds = _mix(np.concatenate(sets) + _M1)
    at = (seeds % np.uint64(SLOTS)).astype(np.int64)
    step = (_mix(seeds) % np.uint64(SLOTS - 1)).astype(np.int64) + 1
    out = np.full(len(sets) * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    table_ = out.reshape(len(sets), SLOTS)
    for j in range(SLOTS):
        value = (np.uint64(j) << _RANK) | (_mix(seeds + np.uint64((j + 1) * int(_M1) & (1 << 64) - 1)) >> np.uint64(16))
        np.minimum.at(out, owner * SLOTS + at, value)
        if j < 12 or j % 8 == 0:
            # early stop: what follows ranks at least j + 1 and cannot lower a filled slot
            active = table_.max(axis=1) >= (np.uint64(j + 1) << _RANK)
            if not active.any():
                break
            go_on = active[owner]
            if not go_on.all():
                owner, seeds, at, step = owner[go_on], seeds[go_on], at[go_on], step[go_on]
        at = at + step
        at[at >= SLOTS] -= SLOTS
    return table_


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    cells = signatures[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), cells.shape[:2]) * _M1
    for r in range(ROWS):
        out = _mix(out ^ cells[:, :, r]) + _M1
    return out.view(np.int64)


def prefix_bands(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Buckets of a small set's prefix: sets linked at `percent` share one of them; larger sets have none."""
    n = len(shingles)
    if not 0 < n <= SMALL * 100 // percent:
        return np.empty(0, np.int64)
    return _mix(shingles[: n - -(-percent * n // 100) + 1] ^ _M2).view(np.int64)


def _described(width: int, percent: int, text: str, chunk: int = 1 << 18):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingle_set(x, width) for x in frame[text]]
            nodes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            bands: list = [None] * len(sets)
            held, size = [], 0
            for i, s in enumerate(sets):
                if len(s):
                    held.append(i)
                    size += len(s)
                if held and (size >= chunk or i == len(sets) - 1):
                    for k, row in zip(held, band_hashes(super_minhash([sets[h] for h in held])), strict=True):
                        bands[k] = np.concatenate([row, prefix_bands(sets[k], percent)])
                    held, size = [], 0
            yield frame.drop(columns=[text]).assign(n_shingles=[len(s) for s in sets], node=nodes, bands=bands)

    return run


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of `pairs` (a, b, ...) whose full sets have 100 * intersection >= percent * union."""
    columns = pairs.columns

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            linked = []
            for x, y in zip(f["xs"], f["ys"], strict=True):
                both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(both) - common))
            yield f.loc[linked, columns]

    return (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xs")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("ys")), "b")
        .mapInPandas(meet, pairs.schema)
    )


def _thinned(links: DataFrame) -> DataFrame:
    """Links (a, b, pivot) as fewer edges with the same components.

    Every member hangs on the least pivot it is linked with, and its other pivots, at most PIVOTS * BANDS, hang
    on that one too. The latter repeat from member to member, so about one edge a member is left.
    """
    member = F.when(F.col("pivot") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    held = links.groupBy(member.alias("member")).agg(F.collect_list("pivot").alias("pivots"))
    ends = F.explode(F.array_append("pivots", F.col("member")))
    return held.select(ends.alias("a"), F.array_min("pivots").alias("b")).filter("a <> b").distinct()


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, shingle, remaining): the rarest shingles of every set, as many as any linked partner must share one of.

    All sets are ordered alike, by how many of these sets hold a shingle. A set of n shingles shares at least
    percent / 100 * n with a partner, so one of its first n - that + 1. `remaining` counts the
    set from that place on. Shingles that no other set holds take their place but are left out.
    """

    def exploded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, x in zip(f["id"], f["shingles"], strict=True):
                x = np.frombuffer(x, np.int64)
                yield pd.DataFrame({"id": i, "n": len(x), "shingle": x})

    rows = staged(sets.mapInPandas(exploded, "id long, n long, shingle long"), "shingles", FEW_ROWS)
    held = rows.groupBy("shingle").agg(F.count("*").alias("holders"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("holders", "shingle"))
    least = F.ceil(F.col("n") * F.lit(percent) / 100)
    return (
        rows.join(held, "shingle").withColumn("place", place)
        .filter((F.col("place") <= F.col("n") - least + 1) & (F.col("holders") > 1))
        .select("id", "n", "shingle", (F.col("n") - F.col("place") + 1).alias("remaining"))
    )


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_duplicates(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, keep: tuple[str, ...] = (),
    identity: str | None = None,
) -> DataFrame:
    """One row per document: key, the `keep` columns, n_shingles, component_id, kept.

    Words are runs without blanks with A-Z in lower case. Two documents are linked if their shingle sets
    have a Jaccard similarity of `percent` or more; component_id is the smallest key reachable over
    links and `kept` marks the document that carries it. A document without words (or null) is linked with
    nothing. Rows with equal texts are linked, also repeated rows; a null key is reachable from no
    other (component_id is the smallest key that is not null). An empty table gives no row. `keep` columns that are
    named like an output are replaced by it; other names clash with nothing.

    component_id is a key, and components share it where keys repeat or are all null. With `identity` a column
    of that name tells components apart: the smallest 128-bit hash of their shingle sets, null without words.
    """
    keep = tuple(c for c in keep if c not in (key, "n_shingles", "component_id", "kept", identity))
    held = [F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)]
    rows = staged(
        shipped(documents).select(F.col(key).alias("key"), *held, F.col(text).alias("__text")).mapInPandas(
            _described(width, percent, "__text"),
            documents.select(F.col(key).alias("key"), *held, F.lit(0).cast("long").alias("n_shingles"),
                             F.lit(None).cast("binary").alias("node"), F.lit(None).cast("array<long>").alias("bands")).schema,
        ),
        "described", FEW_ROWS,
    )
    nodes = staged(
        rows.filter("n_shingles > 0").groupBy("node")
        .agg(F.min("key").alias("least_key"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .withColumn("id", F.monotonically_increasing_id()),
        "nodes",
    )
    buckets = nodes.select("id", "n", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    members = staged(buckets.join(shared, "band"), "buckets")

    # central nodes share bands with most others; few compare as well with all of a group as they do
    central = members.groupBy("id").agg(F.sum("members").alias("weight"))
    order = Window.partitionBy("band").orderBy(F.col("weight").desc(), "id")
    chosen = (
        members.select("band", "id").join(central, "id").withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= PIVOTS).select("band", "place", F.col("id").alias("p_id"))
    )
    chosen = staged(chosen, "pivots")
    pivots = (
        members.select("band", "id").join(chosen, "band").filter("p_id <> id")
        .groupBy(*_pair("id", "p_id")).agg(F.min("p_id").alias("pivot"))
    )
    first_pairs = staged(pivots, "pairs")

    # the sets of all nodes in a bucket, made again from the texts of one document each
    wanted = nodes.join(members.select("id").distinct(), "id").select("id", F.col("node").alias("w_node"), F.col("least_key"))
    sources = documents.select(F.col(key).alias("key"), F.col(text).alias("t")).join(
        wanted.select("least_key").distinct(), F.col("key").eqNullSafe(F.col("least_key")), "left_semi"
    )

    def shingled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = [shingle_set(x, width).tobytes() for x in f["t"]]
            yield pd.DataFrame({"s_node": [xxhash.xxh3_128_digest(s) for s in sets], "shingles": sets})

    made = sources.mapInPandas(shingled, "s_node binary, shingles binary")
    sets = staged(
        wanted.join(made, F.col("w_node") == F.col("s_node")).groupBy("id").agg(F.first("shingles").alias("shingles")), "sets", FEW_ROWS,
    )

    links = staged(_compared(first_pairs, sets, percent), "links", FEW_ROWS)
    roots = staged(components(staged(_thinned(links), "edges")), "roots")
    placed = staged(
        members.select("band", "id", "n").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "placed"
    )
    main = (
        placed.groupBy("band", "root").agg(F.count("*").alias("c"))
        .groupBy("band").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    )
    open_rows = placed.join(main, "band")
    outside = staged(open_rows.groupBy("id", "root").agg(F.max(F.col("root") != F.col("main")).alias("outside")), "open")
    prefix = staged(_rare_first(sets.join(outside.select("id"), "id"), percent).join(outside, "id"), "prefixes")
    other = prefix.filter("outside").select(*[F.col(c).alias(f"o_{c}") for c in ("id", "n", "shingle", "remaining", "root")])
    # counted from a first common shingle on, both must still hold what a link needs
    enough = (100 + percent) * F.least("remaining", "o_remaining") >= percent * (F.col("n") + F.col("o_n"))
    rest = (
        prefix.join(other, F.col("shingle") == F.col("o_shingle")).filter((F.col("root") != F.col("o_root")) & enough)
        .select(*_pair("id", "o_id")).distinct().join(first_pairs, ["a", "b"], "left_anti")
    )
    more = staged(_compared(staged(rest, "pairs"), sets, percent), "links", FEW_ROWS)
    named = nodes.select("id", "node", "least_key").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    if not more.isEmpty():
        # links between components: only their roots are joined anew
        root_of = outside.select("id", "root").distinct()
        between = more.join(root_of.toDF("a", "ra"), "a").join(root_of.toDF("b", "rb"), "b")
        above = components(between.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).toDF("root", "top")
        named = named.join(above, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
    own = [F.min("node").alias("m_identity")] if identity else []
    least = named.groupBy("root").agg(F.min("least_key").alias("component_id"), *own)
    by_node = named.join(least, "root").select(F.col("node").alias("m_node"), *least.columns[1:])
    joined = rows.drop("bands").join(by_node, F.col("node") == F.col("m_node"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key"))
    return joined.select(
        F.col("key").alias(key), *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], "n_shingles", component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"), *[F.col("m_identity").alias(x) for x in (identity,) if x],
    )


@query("op6_near_duplicates")
def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), width=2, percent=80)
