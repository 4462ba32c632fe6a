"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one salt of a hot key may hold.
ROWS_PER_SALT = 100_000
#: Hot keys (some 100 bytes each) that may be broadcast; a key with less than this part of all rows is never hot.
MAX_HOT_KEYS = 100_000


def hot_keys(groups: DataFrame, keys: list[str], count_col: str, rows_per_salt: int = ROWS_PER_SALT, at_most: int = MAX_HOT_KEYS) -> DataFrame | None:
    """Keys holding more rows than one task should, with their number of salts.

    A key is hot from max(rows_per_salt, total / at_most) rows on, so there are never more than at_most and the list
    may be broadcast whatever the size of the data.
    """
    total = groups.agg(F.sum(count_col).alias("n")).first()["n"] or 0
    hot = groups.filter(F.col(count_col) > max(rows_per_salt, total // at_most)).select(
        *keys, F.ceil(F.col(count_col) / rows_per_salt).cast("int").alias("__salts")
    )
    return hot if total > rows_per_salt and hot.limit(1).count() else None


def attach_group_values(
    rows: DataFrame, groups: DataFrame, keys: list[str], count_col: str, spread_by: str, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Inner join of rows with one row per group; rows of hot groups are salted by spread_by, the group row repeated per salt."""
    hot = hot_keys(groups, keys, count_col, rows_per_salt)
    if hot is None:
        return rows.join(groups, keys)
    hot = F.broadcast(hot)
    left = rows.join(hot, keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("__salts")).cast("int"), F.lit(0))).drop("__salts")
    right = (
        groups.join(hot, keys, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)))
        .drop("__salts")
    )
    return left.join(right, [*keys, "__salt"]).drop("__salt")


def salted_self_join(a: DataFrame, b: DataFrame, key: str, counts: DataFrame, count_col: str, spread_by: str, rows_per_salt: int = 2000, at_most: int = MAX_HOT_KEYS) -> DataFrame:
    """Inner join of two tables on a key that many rows of both may share: rows of a on a hot key are spread over salts
    by a column, those of b repeated per salt, so the product of a hot key is made by many tasks."""
    hot = hot_keys(counts, [key], count_col, rows_per_salt, at_most)
    if hot is None:
        return a.join(b, key)
    hot = F.broadcast(hot)
    left = a.join(hot, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("__salts")).cast("int"), F.lit(0))).drop("__salts")
    right = b.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))).drop("__salts")
    return left.join(right, [key, "__salt"]).drop("__salt")
