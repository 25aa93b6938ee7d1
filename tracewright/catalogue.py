"""All queries of the library by name, with the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``sql`` is what DuckDB must answer alike."""

    def add(function: Query) -> Query:
        if function.__name__ in QUERIES:
            raise ValueError(f"query {function.__name__} is already registered")
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


from tracewright.queries import argument, compose, documents, graph, matching, measures  # noqa: E402,F401
