"""Archive index scans as a Python data source: one partition per site and year, filters turned into parameters.

The fetcher is an option (module:function) so that tests and offline runs read recorded answers; it gets the parameters
and gives the lines of one page of the index and the key to resume with. Pages are read until there is no such key.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from lumigraph.operators import ordered
from lumigraph.schemas import SNAPSHOTS


@dataclass
class SiteYear(InputPartition):
    url: str
    year: int


class CdxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.year, self.at_least, self.at_most = options, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if f.attribute == ("year",) and isinstance(f, EqualTo):
                self.year = int(f.value)
            elif f.attribute == ("year",) and isinstance(f, GreaterThanOrEqual):
                self.at_least = int(f.value)
            elif f.attribute == ("year",) and isinstance(f, LessThanOrEqual):
                self.at_most = int(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        urls = [u for u in self.options["urls"].split() if u]
        years = range(int(self.options["from"]), int(self.options["to"]) + 1)
        wanted = [y for y in years if self.year in (None, y) and (self.at_least is None or y >= self.at_least) and (self.at_most is None or y <= self.at_most)]
        return [SiteYear(u, y) for u in urls for y in wanted] or [SiteYear("", 0)]

    def read(self, partition: SiteYear) -> Iterator[tuple]:
        if not partition.url:
            return
        module, name = self.options["fetcher"].split(":")
        fetch = getattr(importlib.import_module(module), name)
        limit, got, met, resume = int(self.options.get("limit", 0)), 0, set(), None
        given = {"url": partition.url, "from": partition.year, "to": partition.year, "collapse": self.options.get("collapse"), "filter": self.options.get("filter"), "limit": limit or None}
        while True:
            lines, resume = fetch({**given, "resumeKey": resume})
            for ts, original in lines:
                if limit and got >= limit:
                    return
                got += 1
                yield ts, partition.year, original, f"https://web.archive.org/web/{ts}id_/{original}"
            if not resume or limit and got >= limit:
                return
            if resume in met:
                raise ValueError(f"the index of {partition.url} gives the key {resume} again")
            met.add(resume)


class CdxSource(DataSource):
    """Options: urls (separated by spaces), from, to, fetcher, limit per site and year, collapse, filter (such as statuscode:200)."""

    @classmethod
    def name(cls) -> str:
        return "cdx"

    def schema(self) -> str:
        return SNAPSHOTS

    def reader(self, schema) -> CdxReader:
        return CdxReader(dict(self.options))


def read_cdx(spark: SparkSession, urls: list[str], first: int, last: int, fetcher: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CdxSource)
    return spark.read.format("cdx").options(urls=" ".join(urls), **{"from": str(first), "to": str(last)}, fetcher=fetcher, **options).load()


def nearest(snapshots: DataFrame, wanted: DataFrame, key: str = "original", ts: str = "timestamp", at: str = "wanted_ts") -> DataFrame:
    """The snapshot nearest in time to each wanted (key, at); the earlier on ties; none for keys without one.

    Both sides are put in ranges of key and time, and each wanted time looks at the snapshot before and behind it, in
    its range or at the ends of the ranges beside it: the work is a sort, however many of both a key has.
    """
    t = lambda c: F.unix_timestamp(F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss")))
    there = snapshots.select(F.col(key).alias("k"), F.col(ts).alias("ts"), t(F.col(ts)).alias("t")).filter("t is not null and k is not null").groupBy("k", "t").agg(F.min("ts").alias("ts")).withColumn("ask", F.lit(0))
    asked = wanted.select(F.col(key).alias("k"), F.col(at).alias("at"), t(F.col(at)).alias("t")).filter("t is not null and k is not null").distinct().withColumn("ask", F.lit(1))
    rows = ordered.placed(there.unionByName(asked, allowMissingColumns=True), ["k"], [F.col("t"), F.col("ask"), F.col("at")])
    snap = F.when(F.col("ask") == 0, F.struct("t", "ts"))
    ends = rows.groupBy("k", "__p").agg(F.min(snap).alias("first"), F.max(snap).alias("last"))
    by_range = Window.partitionBy("k").orderBy("__p")  # a row for each range of a key
    ends = ends.select(
        "k", "__p", F.last("last", ignorenulls=True).over(by_range.rowsBetween(Window.unboundedPreceding, -1)).alias("last_before"), F.first("first", ignorenulls=True).over(by_range.rowsBetween(1, Window.unboundedFollowing)).alias("first_behind")
    )
    inside = Window.partitionBy("__p", "k").orderBy("t", "ask", "at")
    seen = rows.withColumn("before", F.last(snap, ignorenulls=True).over(inside)).withColumn("behind", F.first(snap, ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing)))
    seen = seen.filter("ask = 1").join(ends, ["k", "__p"]).withColumn("before", F.coalesce("before", "last_before")).withColumn("behind", F.coalesce("behind", "first_behind"))
    gap = lambda c: F.abs(F.col(f"{c}.t") - F.col("t"))
    found = F.when(F.col("behind").isNull() | (gap("before") <= gap("behind")), F.col("before.ts")).otherwise(F.col("behind.ts"))
    return seen.select(F.col("k").alias(key), F.col("at").alias(at), found.alias("nearest_ts")).filter("nearest_ts is not null")
