"""All registered queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; `sql` is its reference form, over the common table expressions in `views`."""

    def add(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = function
        if sql:
            head = sql.strip()
            _SQL[name] = head if not views else f"WITH {views}, {head[5:]}" if head.startswith("WITH ") else f"WITH {views} {head}"
        return function

    return add


def _load() -> None:
    from . import analyses, elements, quality  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
