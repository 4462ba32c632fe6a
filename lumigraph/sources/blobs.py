"""Key to bytes tables (parquet): put, get, list, merge, verify, and CSV texts out of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.schemas import BLOBS


def put_files(spark: SparkSession, folder: str, store: str, base: str) -> None:
    """All files below folder under keys relative to base, written beside what the store has."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    key = F.expr(f"substring_index(path, '{base.rstrip('/')}/', -1)")
    files.select(key.alias("key"), F.col("content").alias("value")).write.mode("append").parquet(store)


def blobs(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(BLOBS).parquet(store)


def get(spark: SparkSession, store: str, key: str) -> bytes | None:
    r = blobs(spark, store).filter(F.col("key") == key).select("value").head(1)
    return bytes(r[0][0]) if r else None


def keys(spark: SparkSession, store: str) -> DataFrame:
    return blobs(spark, store).select("key").distinct()


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old entries but for those that new replaces, and all new ones."""
    return old.join(new.select("key").distinct(), "key", "left_anti").unionByName(new)


def verify(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, status): same, different, only_left or only_right, by MD5 of the values."""
    a, b = (x.select("key", F.md5("value").alias(n)) for x, n in ((left, "l"), (right, "r")))
    return a.join(b, "key", "full").select("key", F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").when(F.col("l") == F.col("r"), "same").otherwise("different").alias("status"))


def csv_rows(store: DataFrame, key: str, schema: str, sep: str = ",") -> DataFrame:
    """Rows of a CSV text that is a value of the store."""
    lines = store.filter(F.col("key") == key).select(F.posexplode(F.split(F.decode("value", "UTF-8"), r"\r?\n")).alias("pos", "line")).filter("pos > 0 and line <> ''")
    return lines.select(F.from_csv("line", schema, {"sep": sep}).alias("r")).select("r.*")


def csv_closure(spark: SparkSession, store: DataFrame, roots: list[str], column: int = 0, max_depth: int | None = None) -> DataFrame:
    """(key, depth): values that are CSV files name further keys in a column; all keys reached from the roots, at any depth if none is given."""
    from lumigraph.operators.crawl import reachable

    rows = store.filter(F.col("key").endswith(".csv")).select("key", F.explode(F.split(F.decode("value", "UTF-8"), r"\r?\n")).alias("line"))
    edges = rows.select(F.col("key").alias("parent"), F.trim(F.split("line", ",")[column]).alias("child")).filter("child <> ''")
    seeds = spark.createDataFrame([(r,) for r in roots], "url string")
    return reachable(edges, seeds, max_depth).withColumnRenamed("url", "key")
