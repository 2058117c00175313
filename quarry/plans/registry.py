"""The registry of named queries: each has a Spark form and, where SQL can express it, a DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its oracle SQL if there is one."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


from quarry.plans import architecture, events, graph, history, retrieval, review, scope  # noqa: E402, F401
