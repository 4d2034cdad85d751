"""Queries over the given tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

import importlib

from workload.registry import QUERIES, SQL

MODULES = ["ranking", "cleaning", "searching", "vectors", "extraction", "storage", "streams", "composed"]


def load():
    """All queries and all SQL by name."""
    for name in MODULES:
        importlib.import_module(f"workload.{name}")
    return QUERIES, SQL
