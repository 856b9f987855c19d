"""Register of the driver's queries: a Spark function and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimspark.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows.

    It goes by its function name; a ``q_`` in front (to tell it from an operator) is left out.
    """
    def add(fn: Query) -> Query:
        name = fn.__name__.removeprefix("q_")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add
