"""The library's queries over the given tables, and the same queries as SQL for DuckDB."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has any."""

    def register(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ship(spark), sf_dir)

        _queries[f.__name__] = run
        if sql:
            _oracles[f.__name__] = sql
        return run

    return register


def queries() -> dict[str, Query]:
    from . import registered  # noqa: F401

    return _queries


def oracle_sql() -> dict[str, str]:
    from . import registered  # noqa: F401

    return _oracles
