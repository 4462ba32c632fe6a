"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumigraph.llm import p01_format_duplicates, p02_contributor_caps, p03_template_residue, p04_batch_history, p05_score_cutoffs, p06_target_proportions, p07_garbled_encoding, p08_container_packing, p09_evaluation_leaks, p10_shared_spans

_MODULES = [p01_format_duplicates, p02_contributor_caps, p03_template_residue, p04_batch_history, p05_score_cutoffs, p06_target_proportions, p07_garbled_encoding, p08_container_packing, p09_evaluation_leaks, p10_shared_spans]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(getattr(m, "SQL", {}))
    return out
