"""Plain versions of the operators, written for small inputs only."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import duckdb

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, width: int) -> set:
    words = WORDS.findall(fold(text or ""))
    if not words:
        return set()
    span = min(width, len(words))
    return {tuple(words[i : i + span]) for i in range(len(words) - span + 1)}


def near_duplicates(docs: list[tuple], width: int, percent: int) -> dict:
    """position -> (number of shingles, component id) by comparing all pairs."""
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    root[find(i)] = find(j)
    groups: dict = {}
    for i, (key, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(key)
    least = {r: min((k for k in keys if k is not None), default=None) for r, keys in groups.items()}
    return {i: (len(sets[i]), least[find(i)] if sets[i] else docs[i][0]) for i in range(len(docs))}


def base_secrets(text: str | None) -> list[tuple]:
    text = text or ""
    keyed = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(keyed, text, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def base_digest(spans: list[tuple]) -> str:
    kinds = ("assign", "access", "hex")
    return hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def measures(text: str | None) -> tuple:
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def rows(folder: str, sql: str) -> list[tuple]:
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con.execute(sql).fetchall()
