"""Entries of large JSON documents, read by many tasks each.

A document is one JSON value: a list of objects, or an object whose list under one key holds them. Spark's text reader
cuts files into byte ranges at any closing brace. Where a range begins cannot be told from the range itself, so a first
pass sums up each range twice, as if it began outside and inside a string: how it ends, how the nesting changes, and the
last key at every level. Composed in file order (a row per range) these say how each range really begins. The second pass then cuts
entries out of the ranges; the pieces of an entry that crosses ranges are put together by their order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriscope.session import ship_package, written

# a string with what follows it if that makes it a key, a string that does not end here, or a bracket
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"(\s*:)?|("(?:[^"\\]|\\.)*\Z)|[{}\[\]]', re.DOTALL)
_REST = re.compile(r'(?:[^"\\]|\\.)*"(\s*:)?', re.DOTALL)
_SUMMARY = "file string, start long, first string, ends string"
_PIECE = "file string, start long, seq long, kind string, text string"


class _Range:
    """Reads the fragments of a byte range in order; a fragment ends before a closing brace, inside or outside a string."""

    def __init__(self, in_string: bool, depth: int = 0):
        self.in_string, self.depth = in_string, depth
        self.keys: dict[int, str] = {}

    def tokens(self, text: str) -> Iterator[tuple[str, int]]:
        """(bracket, place) of every bracket outside strings, the closing brace behind the fragment included."""
        at = 0
        if self.in_string:
            rest = _REST.match(text)
            if rest is None:
                return
            if rest[1]:
                self.keys[self.depth] = ""  # a key that began in another fragment: no name that is asked for
            self.in_string, at = False, rest.end()
        for m in _TOKEN.finditer(text, at):
            if m[2] is not None:
                self.in_string = True
                return
            mark = m[0]
            if mark[0] == '"':
                if m[1]:
                    self.keys[self.depth] = mark[: -len(m[1])][1:-1]
                continue
            yield mark, m.start()
        yield "}", len(text)

    def step(self, mark: str) -> None:
        self.depth += 1 if mark in "{[" else -1


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[tuple, tuple[list[str], list[_Range]]] = {}
    for f in frames:
        for file, start, text in zip(f["file"], f["start"], f["value"], strict=True):
            first, readers = known.setdefault((file, start), ([], [_Range(False), _Range(True)]))
            if not first and text.strip():
                first.append(text.lstrip("﻿ \t\r\n")[:1])
            for r in readers:
                for mark, _ in r.tokens(text):
                    r.step(mark)
    rows = [
        (file, start, first[0] if first else "", json.dumps([[r.in_string, r.depth, r.keys] for r in readers]))
        for (file, start), (first, readers) in known.items()
    ]
    yield pd.DataFrame(rows, columns=["file", "start", "first", "ends"])


def composed(summaries: list[tuple[str, int, str, str]]) -> dict[tuple[str, int], tuple[bool, int, str, bool]]:
    """How every range begins: (inside a string, depth, last key of the outermost object, whether the document is a list)."""
    out, state, file = {}, None, None
    for name, start, first, ends in sorted(summaries):
        if name != file:
            file, state = name, (False, 0, "", first == "[")
        out[name, start] = state
        in_string, depth, key, listed = state
        inside, change, keys = json.loads(ends)[int(in_string)]
        state = (inside, depth + change, keys.get(str(1 - depth), key), listed)
    return out


def _pieces(begins: dict[tuple[str, int], tuple[bool, int, str, bool]], under: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, reader, seq, held, open_ = None, None, 0, [], False
        level, listed, out = 0, False, []

        def flush_open() -> None:
            if now is not None and open_:
                out.append((*now, seq, "head" if seq >= 0 else "through", "".join(held)))

        for f in frames:
            for file, start, text in zip(f["file"], f["start"], f["value"], strict=True):
                if (file, start) != now:
                    flush_open()
                    now, seq, held = (file, start), -1, []
                    in_string, depth, key, listed = begins[now]
                    level = 1 if listed else 2
                    reader = _Range(in_string, depth)
                    reader.keys[1] = key
                    open_ = depth > level and (listed or key == under)
                    if not open_:
                        seq = 0
                at = 0  # where the open entry goes on in this fragment
                for mark, place in reader.tokens(text):
                    if mark == "{" and reader.depth == level and not open_ and (listed or reader.keys.get(1) == under):
                        open_, at, held = True, place, []
                    reader.step(mark)
                    if mark == "}" and open_ and reader.depth == level:
                        held.append(text[at:place] + "}")
                        out.append((file, start, seq, "tail" if seq < 0 else "whole", "".join(held)))
                        open_, held, seq = False, [], seq + 1
                if open_:
                    held.append(text[at:] + "}")
            yield pd.DataFrame(out, columns=["file", "start", "seq", "kind", "text"])
            out = []
        flush_open()
        yield pd.DataFrame(out, columns=["file", "start", "seq", "kind", "text"])

    return run


def read_entries(spark: SparkSession, path: str, under: str = "queries") -> DataFrame:
    """(position, text): the JSON text of every entry, `position` a struct (file, start, seq) that orders entries of all files.

    Entries are the objects of a list, or of the list under the key `under` of an object; other keys may hold anything. Files without
    entries and empty files give no row. What is no JSON gives texts that do not parse, never an error. A task holds one entry at
    a time; the driver holds a row per byte range (`spark.sql.files.maxPartitionBytes` each).
    """
    ship_package(spark)
    fragments = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    summaries = [tuple(r) for r in fragments.mapInPandas(_summaries, _SUMMARY).collect()]  # a row per byte range
    pieces = written(fragments.mapInPandas(_pieces(composed(summaries), under), _PIECE))
    order = Window.partitionBy("file").orderBy("start", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at most two pieces a range: entries that cross ranges begin with a head
    crossing = pieces.filter("kind <> 'whole'").withColumn("entry", F.sum(F.when(F.col("kind") == "head", 1).otherwise(0)).over(order))
    joined = crossing.filter("entry > 0").groupBy("file", "entry").agg(
        F.min(F.struct("start", "seq")).alias("p"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "text"))), lambda x: x["text"]), "").alias("text"),
    )
    whole = pieces.filter("kind = 'whole'").select(F.struct("file", "start", "seq").alias("position"), "text")
    return whole.unionByName(joined.select(F.struct("file", "p.start", "p.seq").alias("position"), "text"))
