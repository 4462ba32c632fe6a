"""Keeping the k least keys of each group exactly, without bringing a group together.

Keys are positive numbers. Rows are counted per group and bucket of the key (one small shuffle), the bucket that holds
the k-th key is found from the counts, rows of lesser buckets are kept where they are, and only the rows of that one
bucket are ranked. Buckets are steps of the key's logarithm: exponential keys of any mixture of rates (and uniform keys)
never have more than 0.7 of their rows in an octave, so buckets that become finer with the number of rows stay small
however large a group is and however poor its records are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket of the largest possible group should hold.
ROWS_PER_BUCKET = 50_000
#: Least steps of an octave.
STEPS = 64


def uniform(seed: str, *ids: Column) -> Column:
    """A number in (0, 1) that depends on the ids and the seed only (32 bits of an MD5, the same in any SQL engine)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in ids])), 1, 8), 16, 10).cast("double")
    return (bits + 0.5) / 4294967296.0


def exponential(u: Column, weight: Column) -> Column:
    """The exponential random key of a draw u in (0, 1): the least keys are those of the greatest u ** (1 / weight)."""
    return -F.log(u) / weight


def keep_least(df: DataFrame, group: str, key: str, tie: str, limits: DataFrame, limit: str, n_rows: int) -> DataFrame:
    """Rows of df among the limit least keys of their group (ties by the smaller value of tie).

    limits has one row per group (group, limit); groups without a row there are left out.
    """
    steps = max(STEPS, n_rows // ROWS_PER_BUCKET)
    placed = df.withColumn("__bucket", F.floor(F.log2(key) * steps).cast("bigint"))
    counts = placed.groupBy(group, "__bucket").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(group).orderBy("__bucket")
    edges = (
        counts.withColumn("__through", F.sum("__n").over(w)).join(limits.select(group, F.col(limit).alias("__limit")), group)
        .filter(F.col("__through") - F.col("__n") < F.col("__limit"))
        .groupBy(group).agg(F.max("__bucket").alias("__edge"), F.max(F.struct("__through", "__n")).alias("__last"), F.first("__limit").alias("__limit"))
        .select(group, "__edge", (F.col("__limit") - F.col("__last.__through") + F.col("__last.__n")).alias("__open"))
    )
    placed = placed.join(bounded(edges, limits), group).filter("__bucket <= __edge")
    below = placed.filter("__bucket < __edge")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(key, tie))
    at = placed.filter("__bucket = __edge").withColumn("__rank", rank).filter("__rank <= __open").drop("__rank")
    return below.unionByName(at).drop("__bucket", "__edge", "__open")


#: Rows of some 50 bytes up to which a small side is broadcast; beyond it the join is a shuffle.
MAX_BROADCAST_ROWS = 200_000


def bounded(small: DataFrame, sized: DataFrame | None = None) -> DataFrame:
    """small, to be broadcast if it (or a table with at least as many rows that is cheap to read) has few enough rows."""
    n = (small if sized is None else sized).limit(MAX_BROADCAST_ROWS + 1).count()
    return F.broadcast(small) if n <= MAX_BROADCAST_ROWS else small
