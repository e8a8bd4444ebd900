"""Named queries with the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; the views its ``sql`` mentions are put in front of it."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = with_views(sql)
        return fn
    return add
