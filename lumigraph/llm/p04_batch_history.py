"""Problem 4: every new batch checked against all accepted history, without reading the history's records again.

Multi-key sorted neighbourhood. A record has one key for its file hash and one for its picture address, each 128 bits of
a hash of the text. The history is kept as sorted runs of the keys of accepted records in the shared folder, split into
key ranges: the keys are evenly spread, so equal slices of the key space are their quantiles, and the slices become
more as the history grows (ROWS_PER_RANGE). Runs are bucketed by range, so a batch is brought to the ranges and the
history is never shuffled; only ranges that the batch touches are read. In each range the sorted batch is merged into
the sorted runs, and each new key is compared with the window of neighbours before it: the stretch of its own sort
key. Keys of accepted records become a new run; runs are merged into new ranges when there are too many or when the
ranges have become too large.

A later job opens the history again by its folder. Manifests name the runs that count.

Defined results: records without a readable crawl_date are neither cases nor history; void hashes (anything but 64 hex
digits, one repeated digit, or the hash of no bytes) and null or blank addresses match nothing; records of one day are
never compared; repeated row_ids get one verdict; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import random
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumigraph.llm.p01_format_duplicates import letters_and_digits, unescaped
from lumigraph.session import drop_shared, persist_shared, shared_dir, table

#: Size labels, file formats, and query fields that choose a rendition or serve caches and campaigns.
SIZE_LABELS = "thumb|thumbnail|small|medium|large|xlarge|original|orig|full|fullsize|scaled|preview|mini|tiny|hd"
FORMATS = "jpe?g|jpe|png|webp|gif|avif|tiff?|bmp|heic|jfif"
RENDITION_FIELDS = "w|h|width|height|q|quality|fmt|format|fm|size|dpr|maxwidth|maxheight"
CACHE_FIELDS = "cb|cachebust(?:er)?|cache|nocache|ts|timestamp|time|t|v|ver|version|rnd|rand|utm[a-z]*|gclid|fbclid|msclkid|mc[ce]id|campaign"
#: SHA-256 of no bytes.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

#: Keys that a range should hold, and runs from which on they are merged.
ROWS_PER_RANGE = 250_000
MAX_RUNS = 12
#: Batches loaded at once where a table holds many.
DAYS_PER_LOAD = 20
#: Touched ranges up to which they are listed to prune the others; a batch that touches more reads all.
MAX_LISTED_RANGES = 10_000


def day_of(c: Column) -> Column:
    """The day of a crawl_date in any notation, as yyyymmdd; null where it can't be read."""
    y = F.regexp_extract(c, r"^\s*(\d{4})\D?(\d{2})\D?(\d{2})", 0)
    d = F.regexp_extract(c, r"^\s*(\d{2})[./-](\d{2})[./-](\d{4})", 0)
    digits = F.when(y != "", F.regexp_replace(y, r"\D", "")).when(d != "", F.regexp_replace(d, r"^\s*(\d{2})\D(\d{2})\D(\d{4})$", "$3$2$1"))
    return F.when(F.try_to_timestamp(digits, F.lit("yyyyMMdd")).isNotNull(), digits.cast("int"))


def clean_hash(c: Column) -> Column:
    """A SHA-256 in lower case, or null where it is void."""
    h = F.lower(F.regexp_replace(c, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", ""))
    return F.when(h.rlike("^[0-9a-f]{64}$") & ~h.rlike(r"^(.)\1*$") & (h != EMPTY_SHA256), h)


def picture_address(c: Column) -> Column:
    """The address of the picture itself: archive prefix, rendition, cache and campaign parts taken away, the rest as in problem 1."""

    def key(u: Column) -> Column:
        u = F.regexp_replace(F.lower(u), r"(?s)^.*?[^a-z0-9]web[^a-z0-9]+\d{4,14}(?:[a-z]{2})?[^a-z0-9]+(?=https?[^a-z0-9])", "")
        base = F.regexp_extract(u, r"(?s)^[^?]*", 0)
        base = F.regexp_replace(base, r"(?<=[^a-z0-9])\d{2,5}x\d{2,5}(?=[^a-z0-9]|$)", "")
        base = F.regexp_replace(base, rf"[^a-z0-9]+(?:{FORMATS})[^a-z0-9]*$", "")
        base = F.regexp_replace(base, rf"(?:[^a-z0-9]+(?:{SIZE_LABELS}|\d{{1,2}}x))+[^a-z0-9]*$", "")
        fields = F.transform(
            F.split(F.regexp_extract(u, r"(?s)\?(.*)$", 1), "[&;?#]+"),
            lambda f: F.regexp_replace(F.regexp_replace(f, r"[^\p{L}\p{M}\p{N}=]+", ""), rf"^(?:{RENDITION_FIELDS}|{CACHE_FIELDS})=.*$", ""),
        )
        return F.concat(letters_and_digits(base), F.array_join(F.array_sort(F.transform(fields, letters_and_digits)), ""))

    k = F.transform(F.array(unescaped(c)), key)[0]
    return F.when(k != "", k)


def range_of(k: Column, ranges: int) -> Column:
    """The slice of the key space, of so many equal ones, that a key lies in; slices ascend with the key."""
    top = F.shiftright(k, 32) + F.lit(1 << 31)  # 0 .. 2**32 - 1, in the order of the key
    return F.shiftright(top * F.lit(ranges), 32).cast("int")


def entries(df: DataFrame, id_col: str = "row_id", date: str = "crawl_date", hash_col: str = "file_hash", url: str = "image_url") -> DataFrame:
    """(id, day, k1, k2): one row per key of every dated record, the key as 128 bits; records without a key have k1 null."""
    keyed = df.select(F.col(id_col).alias("id"), day_of(F.col(date)).alias("day"), F.array(F.concat(F.lit("h"), clean_hash(F.col(hash_col))), F.concat(F.lit("a"), picture_address(F.col(url)))).alias("keys"))
    return (
        keyed.filter("day is not null")
        .select("id", "day", F.explode_outer(F.array_compact("keys")).alias("key"))
        .select("id", "day", F.when(F.col("key").isNotNull(), F.xxhash64("key")).alias("k1"), F.when(F.col("key").isNotNull(), F.xxhash64(F.lit("second"), F.reverse("key"))).alias("k2"))
    )


def _merge(new: pa.Table, old: pa.Table) -> pa.Table:
    """The keys (k1, k2) of one range of a sorted batch that are among the range's history.

    Both are merged in the order of k1, history first among equals; each new key is compared with its neighbours
    before it, as far back as they have its k1.
    """
    k1 = np.concatenate([old["k1"].to_numpy(), new["k1"].to_numpy()])
    k2 = np.concatenate([old["k2"].to_numpy(), new["k2"].to_numpy()])
    is_new = np.r_[np.zeros(len(old), bool), np.ones(len(new), bool)]
    order = np.argsort(k1, kind="stable")  # a merge sort: sorted stretches are merged, not sorted again
    k1, k2, is_new = k1[order], k2[order], is_new[order]
    at, hit, back = np.flatnonzero(is_new), np.zeros(len(k1), bool), 1
    while True:
        at = at[at >= back]
        at = at[k1[at] == k1[at - back]]
        if not len(at):
            break
        hit[at] |= ~is_new[at - back] & (k2[at] == k2[at - back])
        back += 1
    return pa.table({"k1": k1[hit], "k2": k2[hit]})


class History:
    """Sorted runs of the keys of accepted records; a path that holds a history is read again.

    Each change writes the next manifest under another name and renames it, so that a broken job leaves the last whole
    history (rows of runs that no manifest names are passed over), and of two jobs that change one history at once the
    later fails.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}").rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._fs = self._hadoop.fs.Path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        found = self._fs.globStatus(self._hadoop.fs.Path(f"{self.path}/_manifest-*")) or []
        self.version = max((int(f.getPath().getName().rpartition("-")[2]) for f in found), default=0)
        self.state = {"epoch": "", "ranges": 0, "runs": [], "n_keys": 0, "former": ""}
        if self.version:
            stream = self._fs.open(self._hadoop.fs.Path(self._manifest(self.version)))
            try:
                self.state = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()

    @property
    def runs(self) -> list[int]:
        return self.state["runs"]

    def _manifest(self, version: int) -> str:
        return f"{self.path}/_manifest-{version:09d}"

    def _commit(self, state: dict) -> None:
        new, target = (self._hadoop.fs.Path(p) for p in (f"{self.path}/_new-{uuid.uuid4().hex}", self._manifest(self.version + 1)))
        stream = self._fs.create(new, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(new, target):
            self._fs.delete(new, False)
            raise RuntimeError(f"{self.path} was changed by another job")
        self.version, self.state = self.version + 1, state

    def _table(self, epoch: str, ranges: int) -> str:
        """The bucketed table of an epoch, made known to this session."""
        location = f"{self.path}/{epoch}"
        name = "lumigraph_history_" + hashlib.md5(location.encode()).hexdigest()
        self.spark.sql(
            f"create table if not exists {name} (k1 bigint, k2 bigint, range int, run bigint) using parquet clustered by (range) sorted by (k1, k2) into {ranges} buckets location '{location}'"
        )
        return name

    def keys(self, ranges: list[int] | None = None) -> DataFrame | None:
        """(k1, k2, range) of all history, or of some ranges only: the files of other ranges are not opened."""
        if not self.runs:
            return None
        name = self._table(self.state["epoch"], self.state["ranges"])
        self.spark.catalog.refreshTable(name)
        df = self.spark.table(name).filter(F.col("run").isin(self.runs))
        return (df if ranges is None else df.filter(F.col("range").isin(ranges))).select("k1", "k2", "range")

    def _write(self, keys: DataFrame, epoch: str, ranges: int, kept: list[int], former: str = "") -> None:
        """keys as a new sorted run beside the kept ones; former is the epoch that this one replaces."""
        run, seen = random.getrandbits(62), Observation()
        name = self._table(epoch, ranges)
        rows = keys.select("k1", "k2", range_of(F.col("k1"), ranges).alias("range"), F.lit(run).alias("run")).repartition(ranges, "range")
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.insertInto(name)
        before = self.state["n_keys"] if kept else 0
        self._commit({"epoch": epoch, "ranges": ranges, "runs": [*kept, run], "n_keys": before + seen.get["n"], "former": former})

    def append(self, keys: DataFrame, n_at_most: int) -> None:
        """Accept keys (of which there are at most so many): a new run, after a compaction where it is time for one."""
        wanted = max(1, -(-(self.state["n_keys"] + n_at_most) // ROWS_PER_RANGE))
        if not self.runs:
            self._write(keys, f"epoch-{uuid.uuid4().hex}", wanted, [])
            return
        if len(self.runs) >= MAX_RUNS or wanted > 2 * self.state["ranges"]:
            self.compact(n_at_most)
        self._write(keys, self.state["epoch"], self.state["ranges"], self.runs, self.state["former"])

    def compact(self, room: int = 0) -> None:
        """Merge all runs into one, with as many ranges as the keys (and so many further ones) need.

        The files replaced are kept until the next compaction, for readers that have begun with them.
        """
        if self.runs:
            old = self.state
            self._write(self.keys().select("k1", "k2"), f"epoch-{uuid.uuid4().hex}", max(1, -(-(old["n_keys"] + room) // ROWS_PER_RANGE)), [], old["epoch"])
            if old["former"]:
                drop_shared(self.spark, f"{self.path}/{old['former']}")

    def matches(self, keys: DataFrame) -> DataFrame | None:
        """Those of the distinct keys (k1, k2) that the history holds; null without a history."""
        if not self.runs:
            return None
        ranges = self.state["ranges"]
        new = keys.select("k1", "k2", range_of(F.col("k1"), ranges).alias("range"))
        touched = [r[0] for r in new.select("range").distinct().limit(MAX_LISTED_RANGES + 1).collect()] if ranges > 1 else [0]
        old = self.keys(touched if len(touched) <= MAX_LISTED_RANGES else None)
        return new.groupBy("range").cogroup(old.groupBy("range")).applyInArrow(_merge, "k1 bigint, k2 bigint")

    def load(self, batches: DataFrame) -> DataFrame:
        """Check the entries of one or more batches later than the history, accept the rest; gives the ids of repeats."""
        return self.load_written(persist_shared(batches, "batches"))

    def load_written(self, batches: DataFrame) -> DataFrame:
        """load() for entries that are cheap to read again."""
        keyed = batches.filter("k1 is not null")
        distinct = persist_shared(keyed.groupBy("k1", "k2").agg(F.min("day").alias("lo"), F.max("day").alias("hi")), "batch-keys")
        n, first, last = distinct.agg(F.count("*"), F.min("lo"), F.max("hi")).first()
        if not n:
            return batches.select("id").limit(0)
        hits, repeats = self.matches(distinct), None
        if hits is not None:
            # a key that much of the batch holds is one row of the hits: adaptive execution may split the batch's side
            repeats = persist_shared(keyed.join(hits, ["k1", "k2"], "left_semi").select("id").distinct(), "repeats")
            keyed = keyed.join(repeats, "id", "left_anti")
        if first < last:
            # a key met on one day only decides nothing; a record without any other key is accepted
            met_again = keyed.join(distinct.filter("lo < hi").select("k1", "k2"), ["k1", "k2"])
            within = self._decide(persist_shared(met_again.select("id", "day", "k1", "k2", F.lit(0).alias("state")), "open"))
            keyed = keyed.join(within, "id", "left_anti")
            repeats = within if repeats is None else repeats.unionAll(within)
        self.append(keyed.select("k1", "k2").distinct(), n)
        return batches.select("id").limit(0) if repeats is None else repeats

    def _decide(self, e: DataFrame) -> DataFrame:
        """ids of repeats among entries of several batches; state: 0 open, 1 accepted, 2 repeat.

        Between the batches of one load a record counts only once it is accepted: rounds decide all records whose
        earlier neighbours are decided, until none is left (at most one round per batch, few in practice).
        """
        while True:
            first = e.filter("state < 2").groupBy("k1", "k2").agg(F.min("day").alias("live"), F.min(F.when(F.col("state") == 1, F.col("day"))).alias("accepted"))
            seen = e.filter("state = 0").join(first, ["k1", "k2"])
            verdict = seen.groupBy("id").agg(F.max(F.col("accepted").isNotNull() & (F.col("accepted") < F.col("day"))).alias("dup"), F.min(F.col("live") >= F.col("day")).alias("free"))
            verdict = verdict.select("id", F.when(F.col("dup"), 2).when(F.col("free"), 1).otherwise(0).alias("now"))
            e = persist_shared(e.join(verdict, "id", "left").select("id", "day", "k1", "k2", F.coalesce("now", "state").alias("state")), "round")
            if not e.filter("state = 0").limit(1).count():
                return e.filter("state = 2").select("id").distinct()


def replay(history: History, all_entries: DataFrame, days: list[int], days_per_load: int) -> DataFrame:
    """ids of repeats when the batches of these days (ascending) are loaded, so many at a time."""
    out = all_entries.select("id").limit(0)
    for i in range(0, len(days), days_per_load):
        out = out.unionAll(history.load_written(all_entries.filter(F.col("day").between(days[i], days[min(i + days_per_load, len(days)) - 1]))))
    return out


def _written(records: DataFrame) -> tuple[DataFrame, list[int]]:
    """(entries with files of its own for each day, the days in order)."""
    written = persist_shared(entries(records).select("id", "k1", "k2", "day"), "entries", partition_by="day")
    return written, [r[0] for r in written.select("day").distinct().orderBy("day").collect()]


def repeats_of_history(spark: SparkSession, records: DataFrame, days_per_load: int = DAYS_PER_LOAD, path: str | None = None) -> DataFrame:
    """row_id of every record that repeats one accepted from an earlier batch; each day of crawl_date is a batch, in order.

    A table of many batches is a backfill: several are loaded at once, with the same result as one after the other.
    """
    written, days = _written(records)
    return replay(History(spark, path), written, days, days_per_load).select(F.col("id").alias("row_id"))


def repeats_of_last_batch(spark: SparkSession, records: DataFrame, days_per_load: int = DAYS_PER_LOAD) -> DataFrame:
    """row_id of the records of the last batch that repeat the history: the everyday load, one batch against persisted runs."""
    written, days = _written(records)
    history = History(spark)
    replay(history, written, days[:-1], days_per_load)
    return replay(history, written, days[-1:], 1).select(F.col("id").alias("row_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_of_history(spark, table(spark, sf_dir, "images_meta"))


def p4_last_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_of_last_batch(spark, table(spark, sf_dir, "images_meta"))


QUERIES = {"p4_found": p4_found, "p4_last_batch": p4_last_batch}
