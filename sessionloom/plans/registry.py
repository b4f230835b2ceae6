"""Names of the queries, what they run and how to check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return add


def load() -> None:
    """Import every catalogue module once."""
    from sessionloom.plans import catalog_log, catalog_prepare, catalog_rank  # noqa: F401
