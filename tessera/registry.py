"""Registry of queries and of their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame, with DuckDB SQL that gives the same rows."""

    def add(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add
