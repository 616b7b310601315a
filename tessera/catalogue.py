"""Queries and oracles of the library's own operators."""

from __future__ import annotations

from tessera.plans import queries_graphs, queries_information, queries_tables, queries_tokens  # noqa: F401
from tessera.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
