"""The catalogue of runnable queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the equivalent SQL where there is one."""

    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            CHECKS[key] = sql
        return function

    return register


def load() -> None:
    """Import the modules that hold queries."""
    from weblode.plans import crawl_queries, enrich_queries, link_queries, report_queries, store_queries  # noqa: F401
