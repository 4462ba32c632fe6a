"""Where the modules of this package enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) as a query, with its DuckDB SQL where there is one."""

    def enter(f):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return enter
