"""All queries of the core library, gathered from the modules of ``quern.plans``."""

from __future__ import annotations

import importlib

#: Each module has QUERIES (name -> callable) and ORACLE_SQL (name -> SQL).
MODULES: tuple[str, ...] = ("retrieval", "chunking", "indexing", "operations", "language", "backends", "indexes", "turns")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        for key, value in getattr(importlib.import_module(f"quern.plans.{name}"), attribute).items():
            if key in found:
                raise ValueError(f"query {key} is registered twice")
            found[key] = value
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
