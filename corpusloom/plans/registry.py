"""The registered queries: name, callable, covered operators, and the check in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query. `covers` lists operator ids of the inventory; `sql` is an
    independent formulation for DuckDB, absent where SQL cannot express the work."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        COVERS[name] = covers.split()
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load() -> None:
    """Import every module that registers queries."""
    from corpusloom.plans import (  # noqa: F401
        q_books,
        q_chat,
        q_links,
        q_retrieval,
        q_sync,
        q_text,
    )
