"""All registered queries of the library and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered already")
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def _load() -> None:
    from tidemark.plans import anchoring, certification, contracts, deciding, encoding, evidence, joining, loading, measuring, merging, modeling, scalars, selecting, streams, vectors  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL equivalent."""

    def wrap(function: Query) -> Query:
        register(function.__name__, function, sql)
        return function

    return wrap
