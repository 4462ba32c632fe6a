"""Ranks, running figures, quotas and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigraph.operators import ordered


def running(df: DataFrame, keys: list[str], order: str, **values: Column) -> DataFrame:
    """Running sums per key in the order of a unique column."""
    return ordered.running(df, keys, [F.col(order)], values)


def bce(score: Column, label: Column, eps: float = 1e-7) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), score))
    return -(label * F.ln(p) + (1 - label) * F.ln(1 - p))


def ecdf(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, value, share): the share of rows up to each distinct value, from counts per value."""
    keys = keys or []
    c = ordered.cumulative_counts(df.filter(~F.isnan(value)), keys, value)
    return c.select(*keys, value, (F.col("through") / F.col("through_total")).alias("share"))


def quota(df: DataFrame, key: str, quotas: dict, order: str) -> DataFrame:
    """The first rows of each group, up to its quota; groups without one are left out."""
    if not quotas:
        return df.limit(0)
    limits = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    w = Window.partitionBy(key).orderBy(order)
    ranked = df.filter(F.col(key).isin(list(quotas))).withColumn("__rn", F.row_number().over(w))
    # the constant bound lets each task drop rows beyond it before the shuffle
    return ranked.filter(F.col("__rn") <= max(quotas.values())).filter(F.col("__rn") <= limits[F.col(key)]).drop("__rn")


def spread(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """k rows of each group, evenly spread in its order, both ends among them; all rows of smaller groups."""
    r = ordered.ranked(df, [key], [F.col(order)], "__i", "__n").withColumn("__i", F.col("__i") - 1)
    if k == 1:
        return r.filter("__i = 0").drop("__i", "__n")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(float(k - 1)), 0).cast("bigint"))
    return r.filter((F.col("__n") <= k) | F.array_contains(wanted, F.col("__i").cast("bigint"))).drop("__i", "__n")


def every_nth(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """About k rows of each group: every (n div k)-th in its order, k at most."""
    r = ordered.ranked(df, [key], [F.col(order)], "__i", "__n").withColumn("__i", F.col("__i") - 1).withColumn("__step", F.greatest(F.floor(F.col("__n") / k), F.lit(1)))
    return r.filter((F.col("__i") % F.col("__step") == 0) & (F.col("__i") / F.col("__step") < k)).drop("__i", "__n", "__step")


def hash_sample(df: DataFrame, id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """A share of the rows, the same on every run and whatever the partitions."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_000)) / 1_000_000.0
    return df.filter(u < fraction)


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement (a heap of n per task, merged)."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(n)


def drop_adjacent(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before it in the group."""
    seen = ordered.with_previous(df, [key], F.col(order), value, "__b")
    return seen.filter(F.col("__b").isNull() | (F.col("__b") != F.col(value))).drop("__b")


def natural_key(c: Column) -> Column:
    """A text that sorts digits as numbers, however many: each run of digits without leading zeros, behind its length."""
    pieces = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), 1)

    def sortable(p: Column) -> Column:
        digits = F.regexp_replace(p, r"^0+(?=\d)", "")
        return F.when(p.rlike(r"^\d+$"), F.concat(padded(F.length(digits), 10), digits)).otherwise(F.lower(p))

    return F.array_join(F.transform(pieces, sortable), "")


def padded(n: Column, width: int) -> Column:
    """A number with leading zeros up to a width; longer numbers stay whole."""
    text = n.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def offsets(df: DataFrame, order: str, length: str) -> DataFrame:
    """Start of every row in the concatenation of all."""
    return ordered.running(df, [], [F.col(order)], {"__end": F.coalesce(F.col(length), F.lit(0))}).withColumn("offset", F.col("__end") - F.coalesce(F.col(length), F.lit(0))).drop("__end")
