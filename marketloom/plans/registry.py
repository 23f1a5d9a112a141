"""Queries over the test tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketloom.plans import identity, market, memory, report, state

FLAGSHIP = "price_summary"
ALL = {**market.QUERIES, **state.QUERIES, **report.QUERIES, **identity.QUERIES, **memory.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in ALL.items() if sql}
