"""The catalogue of queries: name to (query, DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """Adds a query, with the SQL that gives the same rows if there is one."""
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql
