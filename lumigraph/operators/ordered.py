"""Running sums, ranks and quantiles per key that no key can bring into one task.

Rows are placed in ranges of (keys, order); a key that holds many rows spans several ranges. Sums of each key and range
are added up per key (at most one row a range), and each row adds its running sum inside its own range. Order columns
must tell rows of one key apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigraph.session import persist_shared

#: Rows of partial sums up to which they are broadcast.
MAX_BROADCAST_ROWS = 200_000


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def placed(df: DataFrame, keys: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """df with __p, the number of its range. Written, since a range must be the same wherever it is read."""
    by = [*map(F.col, keys), *order]
    return persist_shared((df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)).withColumn("__p", F.spark_partition_id()), "ranges")


def running(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column], totals: bool = False, ranges: int | None = None) -> DataFrame:
    """df with running sums (this row included) per key in the given order; with totals also NAME_total, the sum of the key."""
    rows = placed(df.select("*", *[v.alias(f"__v_{n}") for n, v in values.items()]), keys, order, ranges)
    part = rows.groupBy("__p", *keys).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in values]
    columns += [F.sum(f"__s_{n}").over(Window.partitionBy(*keys)).alias(f"{n}_total") for n in values] if totals else []
    starts = persist_shared(part.select("__p", *keys, *columns), "starts")
    if starts.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        starts = F.broadcast(starts)
    inside = Window.partitionBy("__p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("*", *[F.sum(f"__v_{n}").over(inside).alias(f"__r_{n}") for n in values])
    joined = own.alias("l").join(starts.alias("r"), _same("l", "r", ["__p", *keys]))
    sums = [F.when(F.col(f"__r_{n}").isNull() & (F.col(f"__b_{n}") == 0), None).otherwise(F.coalesce(F.col(f"__r_{n}"), F.lit(0)) + F.col(f"__b_{n}")).alias(n) for n in values]
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *sums, *[F.col(f"{n}_total") for n in values if totals])


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", total: str | None = None, ranges: int | None = None) -> DataFrame:
    """df with the number of each row in its key, from 1, and if asked for the number of rows of the key."""
    out = running(df, keys, order, {name: F.lit(1)}, totals=total is not None, ranges=ranges)
    return out if total is None else out.withColumnRenamed(f"{name}_total", total)


def cumulative_counts(df: DataFrame, keys: list[str], value: str, descending: bool = False) -> DataFrame:
    """(keys, value, n, through, through_total): rows per distinct value, summed up in its order."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = [F.desc(value) if descending else F.asc(value)]
    return running(counts, keys, order, {"through": F.col("n")}, totals=True)


def quantiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """(keys, NAME...): exact quantiles with linear interpolation, from the counts per distinct value; not a number sorts last."""
    c = cumulative_counts(df, keys, value)
    at = lambda i: F.max(F.when((F.col("through") > i) & (F.col("through") - F.col("n") <= i), F.col(value)))
    aggs = []
    for name, f in fractions.items():
        p = F.lit(float(f)) * (F.col("through_total") - 1)
        aggs += [at(F.floor(p)).alias(f"__lo_{name}"), at(F.ceil(p)).alias(f"__hi_{name}"), F.max(p - F.floor(p)).alias(f"__f_{name}")]
    both = c.groupBy(*keys).agg(*aggs)
    return both.select(*keys, *[(F.col(f"__lo_{n}") * (1 - F.col(f"__f_{n}")) + F.col(f"__hi_{n}") * F.col(f"__f_{n}")).alias(n) for n in fractions])


def with_previous(df: DataFrame, keys: list[str], order: Column, value: str, name: str, ranges: int | None = None) -> DataFrame:
    """df with the value of the row before in its key (null for the first); order is one column that tells rows apart."""
    rows = placed(df.withColumn("__o", order), keys, [F.col("__o")], ranges)
    ends = rows.groupBy("__p", *keys).agg(F.max_by(F.struct(F.col(value).alias("v")), "__o").alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__p", *keys, F.last("__end").over(before).alias("__end"))
    inside = rows.withColumn("__n", F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy("__p", *keys).orderBy("__o")))
    joined = inside.alias("l").join(ends.alias("r"), _same("l", "r", ["__p", *keys]))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], F.coalesce("l.__n", "r.__end")["v"].alias(name))
