"""All named queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that must give the same rows, where SQL can."""
    def put(f: Query) -> Query:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key!r} is registered")
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from quillspark.plans import block_queries, chat_queries, loss_queries, numeric_queries, select_queries, stats_queries, text_queries, token_queries, training_queries  # noqa: F401
