"""Registration of the named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it on whole tables, its oracle."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def near(value: Column | str, digits: int = 6) -> Column:
    """Round a float whose last bits depend on the order of a sum; no negative zero."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, digits) + F.lit(0.0)


def sql_near(value: str, digits: int = 6) -> str:
    return f"(round({value}, {digits}) + 0.0::DOUBLE)"
