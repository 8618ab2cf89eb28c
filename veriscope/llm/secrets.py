r"""Secret scan with corpus-wide ownership frequency.

Patterns give candidates; what a candidate is worth is decided by the corpus. The hashes of all
candidate values are counted by distinct owner and repository: a value that many owners carry is
a copied example, one that stays with few is a live-looking credential of theirs. Base spans
(assign, access, hex) are always reported, with that verdict; the wider patterns (key_block, jwt,
generic) add a span only if its value is live-looking and overlaps no base span.

Texts are read once. What is shuffled is one row per candidate: hash, owner, repository, combined
before the shuffle, so a value copied a million times is a handful of rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm.registry import query
from veriscope.llm.shared import FEW_ROWS, shipped, staged, table

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEY_BEGIN = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")
_GENERIC = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
KINDS = ("assign", "access", "hex", "key_block", "jwt", "generic")
BASE = 3


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Private key blocks from left to right; a text is searched for each kind's end once."""
    at, without = 0, set()
    while m := _KEY_BEGIN.search(text, at):
        at = m.end()
        if m[1] in without:
            continue
        mark = f"-----END {m[1]}PRIVATE KEY-----"
        end = text.find(mark, at + 1)
        if end < 0:
            without.add(m[1])
        else:
            at = end + len(mark)
            yield m.start(), at


def scan(text: str | None) -> list[tuple[int, int, int, int, int]]:
    """Candidates of one whole text: (kind, start, end, value start, value end), by start and kind.

    Offsets are code points, ends exclusive. Base kinds: leftmost matches that do not overlap within a
    kind, those that are too short dropped. Wider kinds only where no base span lies.
    """
    if not text:
        return []
    found = [(0, *m.span(), *m.span(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(1, *m.span(), *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(2, *m.span(), *m.span()) for m in _HEX.finditer(text)]
    wide = []
    if "-----BEGIN" in text:
        wide += [(3, *span, *span) for span in _key_blocks(text)]
    if "eyJ" in text:
        wide += [(4, *m.span(), *m.span()) for m in _JWT.finditer(text)]
    for m in _GENERIC.finditer(text):
        s = m.group()
        if any(map(str.isdigit, s)) and any(map(str.isupper, s)) and any(map(str.islower, s)) and _entropy(s) >= 3.5:
            wide.append((5, *m.span(), *m.span()))
    starts, ends = [], []  # what base spans cover, as stretches that do not touch
    for s, e in sorted((s, e) for _, s, e, _, _ in found):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    last = 0
    for span in sorted(wide, key=lambda x: (x[1], x[0])):
        at = bisect_right(ends, span[1])  # the first stretch that ends behind the span's start
        if span[1] >= last and not (at < len(starts) and starts[at] < span[2]):
            found.append(span)
            last = span[2]
    return sorted(found, key=lambda x: (x[1], x[0]))


_SPANS = "array<struct<kind:int,start:int,end:int,from:int,to:int,value:string>>"


def _scanned(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in frames:
        yield pd.Series([
            [(*c, hashlib.sha256(t[c[3] : c[4]].encode()).hexdigest()[:32]) for c in scan(t)] for t in texts
        ], dtype=object)


def find_secrets(
    documents: DataFrame, *, text: str = "text", owner: str = "source", repository: Column | str = "source", max_owners: int = 2,
    max_repositories: int = 4, keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The `keep` columns and `spans`, an array of (kind, start, end, from, to, value, live, owners, repos).

    `owners` and `repos` count who holds the value; `kind` is a place in KINDS, from and to enclose the secret itself, `value` is the start of its SHA-256
    and `live` says that at most `max_owners` owners and `max_repositories` repositories hold the
    value; wider kinds are reported only if live. Spans are ordered by start, then kind. A null
    owner or repository is one like others. Null and empty texts have no spans; repeated rows are
    reported each. An empty table gives no row.
    """
    repo = F.col(repository) if isinstance(repository, str) else repository
    rows = staged(
        shipped(documents).select(
            *keep, F.col(owner).alias("__owner"), repo.alias("__repo"),
            F.pandas_udf(_scanned, _SPANS)(F.col(text)).alias("__spans"),
        ).withColumn("__row", F.monotonically_increasing_id()),
        "spans", FEW_ROWS,
    )
    found = rows.filter(F.size("__spans") > 0).select("__row", "__owner", "__repo", F.explode("__spans").alias("s"))
    counted = (
        found.groupBy(F.col("s.value").alias("value"), "__owner", "__repo").agg(F.count("*").alias("n"))
        .groupBy("value", "__owner").agg(F.count("*").alias("repos"))
        .groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
        .withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repositories))
        .select(F.col("value").alias("v"), "live", "owners", "repos")
    )
    judged = (
        found.select("__row", "s").join(counted, F.col("s.value") == F.col("v"))
        .filter((F.col("s.kind") < BASE) | F.col("live"))
        .groupBy("__row")
        .agg(F.collect_list(F.struct(*[F.col(f"s.{c}").alias(c) for c in ("start", "kind", "end", "from", "to", "value")], "live", "owners", "repos")).alias("__found"))
        .withColumnRenamed("__row", "j_row")
    )
    order = F.transform(
        F.sort_array("__found"),
        lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "start", "end", "from", "to", "value", "live", "owners", "repos")]),
    )
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,from:int,to:int,value:string,live:boolean,owners:long,repos:long>>")
    return rows.join(judged, F.col("__row") == F.col("j_row"), "left").select(*keep, F.coalesce(order, empty).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ","
    )


def live_ranges(spans: Column) -> Column:
    """(from, to) of the live secrets, for `redact`."""
    live = F.filter(spans, lambda x: x["live"])
    return F.transform(live, lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to")))


def redact(text: Column, ranges: Column, mark: str = "<SECRET>") -> Column:
    """`text` with every range (from, to) replaced by `mark`; overlapping ranges become one.

    Only texts with a range are sent to the Python workers.
    """

    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in frames:
            out = []
            for t, ranges_ in zip(texts, spans, strict=True):
                if t is None or ranges_ is None or not len(ranges_):
                    out.append(t)
                    continue
                parts, at = [], 0
                for r in sorted(ranges_, key=lambda x: (x["from"], x["to"])):
                    if r["from"] >= at:
                        parts += [t[at : r["from"]], mark]
                    at = max(at, r["to"])
                out.append("".join([*parts, t[at:]]))
            yield pd.Series(out, dtype=object)

    held = ranges.isNotNull() & (F.size(ranges) > 0)
    return F.when(held, F.pandas_udf(run, "string")(F.when(held, text), ranges)).otherwise(text)


@query("op10_secret_ownership")
def op10_secret_ownership(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    found = find_secrets(documents, repository=F.concat_ws("/", "source", "lang"))
    base = F.filter("spans", lambda x: x["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        spans_text(F.filter("spans", lambda x: x["live"])).alias("live_spans"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws("/", x["owners"], x["repos"])), ",").alias("ownership"),
    )
