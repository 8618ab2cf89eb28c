"""Queries of this subpackage and their SQL; `__spark_entry__.py` adds them when it can import them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "mixing", "url_rules", "token_store", "packing", "tool_calls",
    "near_duplicates", "toxicity", "quality_ledger", "bit_slices", "secrets", "bisectors", "languages", "alignment",
)


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is tested against a brute-force version."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    """Register every query (importing a module registers its query)."""
    for name in _MODULES:
        import_module(f"veriscope.llm.{name}")
