"""Schemas of the logical tables and resolution of columns by candidate names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITES = "url string, sector string, subsector string, organization_name string"
SEEDS = "url string, category string, subcategory string"
SNAPSHOTS = "timestamp string, year int, original string, wayback_url string"
BLOBS = "key string, value binary"
DATASET = "image string, class int, split string"

#: Names under which tools look for the same column, in their order.
SCORE_NAMES = ["score", "prediction", "confidence"]
LABEL_NAMES = ["predicted_label", "pred", "prediction_label", "label"]
TRUTH_NAMES = ["gt_label", "ground_truth_label", "ground_truth", "gt", "target"]
MODEL_NAMES = ["model_name", "image_model", "model", "generator"]
PATH_NAMES = ["stored_path", "local_path", "image_path", "path", "image"]


def resolve_column(df: DataFrame, candidates: list[str], ignore_case: bool = True, numeric_fallback: bool = False, ignore: tuple[str, ...] = ()) -> str | None:
    """The first candidate that df has; else, if asked for, its first numeric column outside ignore."""
    names = {c.lower() if ignore_case else c: c for c in reversed(df.columns)}
    for c in candidates:
        if (c.lower() if ignore_case else c) in names:
            return names[c.lower() if ignore_case else c]
    if numeric_fallback:
        for name, kind in df.dtypes:
            if kind in ("double", "float", "int", "bigint") and name not in ignore:
                return name
    return None


def with_defaults(df: DataFrame, defaults: dict[str, Column | str]) -> DataFrame:
    """Adds missing columns and fills blank ones."""
    for name, value in defaults.items():
        v = value if isinstance(value, Column) else F.lit(value)
        df = df.withColumn(name, F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), v) if name in df.columns else v)
    return df
