"""Every query of the library, by name, with the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and its oracle where SQL can state it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _loaded() -> None:
    from cairn.plans import catalogue  # noqa: F401  registers the queries


def queries() -> dict[str, Query]:
    _loaded()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(ORACLES)
