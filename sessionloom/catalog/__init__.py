"""Named queries with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["priors", "metrics", "keys", "sequences", "scalars", "views", "decisions", "neighbours", "texts", "quality", "files"]


def load():
    """Import all query modules; returns (queries, sql)."""
    from sessionloom.catalog.registry import QUERIES, SQL

    for name in MODULES:
        import_module(f"sessionloom.catalog.{name}")
    return QUERIES, SQL
