"""Registered queries: one module per operator family, each with its DuckDB counterpart."""

from __future__ import annotations

import importlib
from types import ModuleType

MODULES = ("cells", "series", "summaries", "warehouse", "evaluation", "learners", "ledger", "audit", "governance", "stats", "sources", "streams")


def load() -> ModuleType:
    """Import every plan module once and return the filled registry."""
    for name in MODULES:
        importlib.import_module(f"panelspark.plans.{name}")
    return importlib.import_module("panelspark.plans.registry")
