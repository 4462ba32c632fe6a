"""The query catalogue: every registered query with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumigraph.plans import image_queries, registry, score_queries, system_queries  # noqa: F401
from lumigraph.session import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records kept and dropped by each content rule."""
    return registry.QUERIES["filter_funnel"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
