"""The registry of queries over the driver's tables, each with its DuckDB twin where SQL can tell it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lantern.plans import derive

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its oracle over the derived tables."""

    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql is not None:
            _ORACLES[function.__name__] = derive.oracle(sql)
        return function

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
