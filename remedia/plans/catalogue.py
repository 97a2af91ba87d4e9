"""The query catalogue: every registered query with the SQL statement that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(*ctes: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``ctes`` are the views that its SQL reads."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import analytics, repairs, selection, texts  # noqa: F401  (their definitions register)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
