"""Named queries over the given tables, each with an independent SQL statement for the same result."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ("pixels", "planning", "naming", "reports", "text", "files", "headers")


def load_all():
    """All registered queries and SQL texts."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
