"""Joins of records with files, labels, thresholds and each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigraph.operators import ordered


def attach_files(df: DataFrame, files: DataFrame, path: str, file_path: str = "path") -> DataFrame:
    """df with found_path: the file of exactly this path, else the first of the same name; null where there is none."""
    name = lambda c: F.regexp_extract(c, r"[^/]*$", 0)
    exact = files.select(F.col(file_path).alias(path), F.col(file_path).alias("__exact")).dropDuplicates([path])
    named = files.groupBy(name(F.col(file_path)).alias("__name")).agg(F.min(file_path).alias("__named"))
    j = df.withColumn("__name", name(F.col(path))).join(exact, path, "left").join(named, "__name", "left")
    return j.withColumn("found_path", F.coalesce("__exact", "__named")).drop("__name", "__exact", "__named")


def joined_or_fail(df: DataFrame, other: DataFrame, key: str, what: str) -> DataFrame:
    """Left join that raises an error where the other side has no row."""
    j = df.join(other.withColumn("__there", F.lit(True)), key, "left")
    ok = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit(f"{what}: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return j.filter(ok).drop("__there")


def updated_column(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """df with a column taken from updates by key; empty where they have none."""
    return df.drop(column).join(updates.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit("")))


def triplets(df: DataFrame, id_col: str, label: str, seed: int = 42) -> DataFrame:
    """(anchor, positive, negative): each row with another of its class and one of another class, by a seeded order.

    Rows are numbered per class in hash order; the partner is the next number of the class (cyclic), the negative the
    same number, cyclic, of the next class. Two equi-joins; nothing is paired with all.
    """
    ids = df.select(F.col(id_col).alias("id"), F.col(label).alias("c"))
    n = ordered.ranked(ids, ["c"], [F.xxhash64(F.lit(seed), F.col("id")), F.col("id")], "__rn").withColumn("__rn", F.col("__rn") - 1)
    sizes = df.groupBy(F.col(label).alias("c")).agg(F.count("*").alias("size"))
    order = Window.orderBy("c")  # one row per class
    sizes = sizes.withColumn("next", F.coalesce(F.lead("c").over(order), F.first("c").over(order))).withColumn("next_size", F.coalesce(F.lead("size").over(order), F.first("size").over(order)))
    a = n.join(F.broadcast(sizes), "c").filter("size > 1 and next <> c")
    pos = n.select(F.col("c"), F.col("__rn").alias("__p"), F.col("id").alias("positive"))
    neg = n.select(F.col("c").alias("next"), F.col("__rn").alias("__n"), F.col("id").alias("negative"))
    a = a.withColumn("__p", (F.col("__rn") + 1) % F.col("size")).withColumn("__n", F.col("__rn") % F.col("next_size"))
    return a.join(pos, ["c", "__p"]).join(neg, ["next", "__n"]).select(F.col("id").alias("anchor"), "positive", "negative")


def with_each(df: DataFrame, name: str, values: list) -> DataFrame:
    """Each row once for every one of a few values."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def summed(maps: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Counts of several tables added up by key."""
    out = maps[0]
    for m in maps[1:]:
        out = out.unionByName(m)
    return out.groupBy(*keys).agg(F.sum(value).alias(value))


def image_reference(candidates: list[Column], index: Column) -> Column:
    """The first reference that is there, else index:N."""
    blank = [F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates]
    return F.coalesce(*blank, F.concat(F.lit("index:"), index.cast("string")))
