"""Query registry shared by the plan modules and the driver entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn`` under ``name``; ``covers`` lists the SURVEY rows it implements."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
