"""Problem 6: a sample whose shares by category match targets, with a minimum from small categories.

Records are counted per category (one small shuffle) and the counts summed up the tree of sector, subsector and year.
Quotas are then given out top-down: the root divides the sample among the sectors, each sector its quota among its
subsectors, each of these among its targets. A node divides its quota in proportion to the shares of its children, but
gives none more than it has or less than its minimum; so what a target can't fill goes to its siblings first, only what
the siblings can't take to the cousins, and what the sector can't take to the rest. Minima are part of the sample, not
added to it: the other children give way. Every node is divided by a task of its own (no more than the children of one
node are brought together). The draw takes from each category the rows of the first ranks in the order of a hash of the
row_id (bounded_rank: a category is never brought together).

A target is unmet by what its category lacks of its share: that part of its quota is the one passed on.

Defined results: sector and subsector are compared without case and outer spaces; a record lacking one of the three
belongs to no target and is never drawn; of targets with an equal category the one with the smallest target_id draws its
rows; shares that are null, NaN or negative count as 0 and are given their minimum only; minima that exceed the sample are
cut in proportion; repeated rows are separate records; an empty table makes no target unmet (the sample has no rows);
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.llm.bounded_rank import bounded, keep_least, uniform
from lumigraph.session import persist_shared, table

SEED = "proportions"
#: One record of so many is drawn.
ONE_IN = 20


def settled(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(c, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")), F.lit(""))


def categorised(images: DataFrame, targets: DataFrame) -> DataFrame:
    """(row_id, category) of the records of any target's category; category is the smallest target_id of that category."""
    wanted = targets.groupBy(settled(F.col("sector")).alias("s"), settled(F.col("subsector")).alias("u"), F.col("wayback_year").alias("y")).agg(F.min("target_id").alias("category"))
    rows = images.select("row_id", settled(F.col("sector")).alias("s"), settled(F.col("subsector")).alias("u"), F.col("wayback_year").alias("y"))
    return rows.join(bounded(wanted), ["s", "u", "y"]).select("row_id", "category")


def divide(quota: int, share: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whole parts of a quota in proportion to shares, none above most or (if the quota allows) below least.

    The proportional parts, cut to their bounds, are raised or lowered together until they add up; whole rows lost to
    rounding go to the largest fractions, the earlier on ties.
    """
    low = np.minimum(least, most).astype(float)
    high = np.where(share > 0, most, low).astype(float)
    quota = int(min(quota, high.sum()))
    if quota <= low.sum():
        exact = low * (quota / low.sum()) if low.sum() else low
        low = np.zeros_like(low)
    else:
        lo, hi = 0.0, float((high / np.where(share > 0, share, np.inf)).max()) + 1.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.clip(mid * share, low, high).sum() < quota else (lo, mid)
        exact = np.clip(hi * share, low, high)
    parts = np.floor(exact + 1e-6)
    while (lack := int(quota - parts.sum())) != 0:
        room = (parts < high) if lack > 0 else (parts > low)
        order = [i for i in np.argsort((parts - exact) if lack > 0 else (exact - parts), kind="stable") if room[i]]
        parts[order[: abs(lack)]] += np.sign(lack)
    return parts.astype(np.int64)


def _level(children: DataFrame, parents: DataFrame, keys: list[str], id_col: str, size: int) -> DataFrame:
    """children (share, least, most, there) with the quota that their parent (keys, quota) gives them.

    short is what a child lacks of its share of the whole sample: the part that goes to others.
    """

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(id_col, kind="stable")
        share = df["share"].to_numpy(float)
        quota = divide(int(df["given"].iloc[0]), share, df["least"].to_numpy(), df["most"].to_numpy())
        return df.drop(columns="given").assign(quota=quota, short=np.maximum(share * size - df["there"].to_numpy(), 0.0))

    joined = children.join(parents.select(*keys, F.col("quota").alias("given")), keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in children.schema)
    return joined.select(*children.columns, "given").groupBy(*keys).applyInPandas(run, f"{fields}, quota bigint, short double")


def allocate(leaves: DataFrame, size: int) -> DataFrame:
    """leaves (target_id, s, u, share, least, most, there) with quota and short, of a sample of so many rows; most is what a target may draw of what is there."""
    sums = [F.sum(c).alias(c) for c in ("share", "least", "most", "there")]
    leaves = leaves.withColumn("root", F.lit(0)).withColumn("s", F.coalesce("s", F.lit(""))).withColumn("u", F.coalesce("u", F.lit("")))
    possible = leaves.withColumn("least", F.least("least", "most"))
    nodes = possible.groupBy("root", "s", "u").agg(*sums)
    sectors = nodes.groupBy("root", "s").agg(*sums)
    root = sectors.groupBy("root").agg(F.least(F.lit(size), F.floor(F.sum("share") * size + 1e-9)).cast("bigint").alias("quota"))
    given = _level(nodes, _level(sectors, root, ["root"], "s", size), ["s"], "u", size)
    return _level(leaves, given, ["s", "u"], "target_id", size).drop("root")


def planned(spark: SparkSession, images: DataFrame, targets: DataFrame, one_in: int = ONE_IN) -> tuple[DataFrame, DataFrame]:
    """(categorised rows, targets with available, wish, quota, short and unmet)."""
    rows, size = categorised(images, targets), images.count() // one_in
    counts = rows.groupBy("category").agg(F.count("*").alias("available"))
    key = [settled(F.col("sector")).alias("s"), settled(F.col("subsector")).alias("u"), F.col("wayback_year").alias("y")]
    share = F.when(F.col("target_share") > 0, F.nanvl(F.col("target_share"), F.lit(0.0))).otherwise(0.0)
    named = targets.select("target_id", *key, share.alias("share"), F.greatest(F.coalesce("min_rows", F.lit(0)), F.lit(0)).cast("bigint").alias("least"))
    first = named.groupBy("s", "u", "y").agg(F.min("target_id").alias("category"))
    same = F.col("t.s").eqNullSafe(F.col("f.s")) & F.col("t.u").eqNullSafe(F.col("f.u")) & F.col("t.y").eqNullSafe(F.col("f.y"))
    leaves = named.alias("t").join(first.alias("f"), same).select("t.*", "f.category").join(counts, "category", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    leaves = leaves.withColumn("most", F.when(F.col("category") == F.col("target_id"), F.col("available")).otherwise(0)).withColumnRenamed("available", "there")
    plan = allocate(leaves.drop("y"), size).select(
        "target_id", "category", F.col("there").alias("available"), (F.col("share") * size).alias("wish"), "quota", "short", (F.col("short") > 1e-9).alias("unmet"), (F.col("quota") >= F.col("least")).alias("least_met")
    )
    return rows, persist_shared(plan, "quotas")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target_id of the targets that can't be met."""
    _, plan = planned(spark, table(spark, sf_dir, "images_meta"), table(spark, sf_dir, "sample_targets"))
    return plan.filter("unmet").select("target_id")


def sample(spark: SparkSession, images: DataFrame, targets: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """The records drawn: row_id and the target they were drawn for (the first of those with their category)."""
    rows, plan = planned(spark, images, targets, one_in)
    n = plan.agg(F.max("available")).first()[0] or 0
    limits = plan.groupBy("category").agg(F.sum("quota").alias("most"))
    drawn = keep_least(rows.withColumn("key", uniform(SEED, F.col("row_id"))), "category", "key", "row_id", limits, "most", n)
    return drawn.select("row_id", F.col("category").alias("target_id"))


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(spark, table(spark, sf_dir, "images_meta"), table(spark, sf_dir, "sample_targets"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target with the rows it wished for, those available, its quota, what it passed on and whether its minimum is kept."""
    return planned(spark, table(spark, sf_dir, "images_meta"), table(spark, sf_dir, "sample_targets"))[1].drop("category")


QUERIES = {"p6_found": p6_found, "p6_sample": p6_sample, "p6_report": p6_report}
SQL = {
    "p6_found": """select target_id from sample_targets t left join (
      select lower(trim(sector)) as s, lower(trim(subsector)) as u, wayback_year as y, count(*) as n from images_meta group by 1, 2, 3) c
    on lower(trim(t.sector)) = s and lower(trim(t.subsector)) = u and t.wayback_year = y
    where coalesce(n, 0) < target_share * ((select count(*) from images_meta) // 20) - 1e-9"""
}
