"""Runnable queries over the driver tables, grouped by subject."""

from importlib import import_module

_MODULES = ("drift", "reports", "scoring", "comparison", "quality", "sources", "workload", "streams")


def load_all() -> None:
    """Register every query (importing a module registers its queries)."""
    for name in _MODULES:
        import_module(f"veriscope.plans.{name}")
