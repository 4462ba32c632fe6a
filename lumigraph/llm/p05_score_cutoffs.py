"""Problem 5: per source the score cutoff that keeps a target fraction of its records.

Sketch-bracketed exact selection. Records are joined to their scores once and written. The sketch counts them per
source and bucket of a monotone map of the score (the logarithm in steps of 1/1024, so very small scores are told apart
like large ones); the counts are exact, so the bucket in which the target lies is guaranteed to hold the cutoff. While
a source's bracket holds more records than BOUND and more than one score, it is cut into PARTS equal parts between its
least and greatest score and counted again. Records above the bracket are counted, never sorted; only the scores
inside are ordered, and equal scores are one entry there. Ties are not split: the cutoff is the greatest score for
which at least the target is kept.

A record is a row of images_meta whose image_url has a valid score; of several results for an address the one with the
greatest result_id counts. Scores that are null, NaN or outside 0 to 1 are not valid.

Defined results: records without a sector belong to no source; sectors are compared without case and outer spaces;
target sectors without a scored record have null cutoff and nothing kept; a fraction of 0 or less keeps nothing; an
empty table leaves all targets so; repeated rows count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumigraph.llm.bounded_rank import bounded
from lumigraph.session import persist_shared, table

STEPS = 1024
#: Records of a bracket that are ordered at once, and parts that a larger one is cut into.
BOUND, PARTS = 100_000, 4096
#: Scores below count as this one in the sketch only.
FLOOR = 2.0**-200


def bucket(score: Column) -> Column:
    return F.floor(F.log2(F.greatest(score, F.lit(FLOOR))) * STEPS).cast("int")


def valid_scores(results: DataFrame) -> DataFrame:
    """(image_url, score): one valid score per address."""
    ok = results.filter("score is not null and not isnan(score) and score between 0 and 1 and image_url is not null")
    return ok.groupBy("image_url").agg(F.max_by("score", "result_id").alias("score"))


def settled_sector() -> Column:
    return F.nullif(F.lower(F.regexp_replace("sector", r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")), F.lit(""))


def scored(images: DataFrame, results: DataFrame) -> DataFrame:
    """(row_id, source, score) of the records with a score.

    The rows of an address that holds many of them are split over tasks by adaptive skew handling; the other side of
    the join has a single row per address, so a part of the rows needs no more than that row.
    """
    rows = images.filter("image_url is not null").select("row_id", "image_url", settled_sector().alias("source")).filter("source is not null")
    return rows.join(valid_scores(results), "image_url").select("row_id", "source", "score")


def brackets(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, n_scored, n_target, lo, hi, above, inside): the cutoff of a source lies from lo to hi, a stretch of inside records with so many above it."""
    count = [F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")]
    down = Window.partitionBy("source").orderBy(F.desc("b"))

    def pick(parts: DataFrame, target: str) -> DataFrame:
        """The part of each source's sketch, with columns (n, through), in which its target lies."""
        return parts.filter((F.col("through") >= F.col(target)) & (F.col("through") - F.col("n") < F.col(target)))

    sketch = records.groupBy("source", bucket(F.col("score")).alias("b")).agg(*count)
    sketch = sketch.withColumn("through", F.sum("n").over(down)).withColumn("n_scored", F.sum("n").over(Window.partitionBy("source")))
    wanted = F.greatest(F.least(F.ceil(F.col("fraction") * F.col("n_scored") - 1e-9), F.col("n_scored")), F.lit(0)).cast("bigint")
    found = pick(sketch.join(bounded(targets), "source").withColumn("n_target", wanted), "n_target")
    columns = ["source", "n_scored", "n_target", "lo", "hi", "above", "inside"]
    found = persist_shared(found.select("source", "n_scored", "n_target", "lo", "hi", (F.col("through") - F.col("n")).alias("above"), F.col("n").alias("inside")), "bracket")
    wide = (F.col("inside") > BOUND) & (F.col("lo") < F.col("hi"))
    while found.filter(wide).limit(1).count():
        b = found.filter(wide).select("source", "n_scored", "n_target", "above", F.col("lo").alias("from"), F.col("hi").alias("to"))
        part = F.least(F.floor((F.col("score") - F.col("from")) / (F.col("to") - F.col("from")) * PARTS), F.lit(PARTS - 1)).cast("int")
        inside = records.join(bounded(b.select("source", "from", "to")), "source").filter("score between from and to").groupBy("source", part.alias("b")).agg(*count)
        finer = pick(inside.join(bounded(b), "source").withColumn("through", F.col("above") + F.sum("n").over(down)), "n_target")
        finer = finer.select("source", "n_scored", "n_target", "lo", "hi", (F.col("through") - F.col("n")).alias("above"), F.col("n").alias("inside"))
        found = persist_shared(found.filter(~wide).unionByName(finer), "bracket")
    return found.select(*columns)


def cutoffs(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, n_scored, n_target, cutoff, n_kept) for every row of targets (source, fraction); records is (source, score), written before."""
    bracket = brackets(records, targets)
    inside = records.join(bounded(bracket), "source").filter("score between lo and hi").groupBy("source", "score", "above", "n_target").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("score"))
    found = (
        inside.withColumn("kept", F.col("above") + F.sum("n").over(w)).filter("kept >= n_target")
        .groupBy("source").agg(F.max("score").alias("cutoff"), F.min("kept").alias("n_kept"))
    )
    totals = records.groupBy("source").agg(F.count("*").alias("n_scored"))
    wanted = F.greatest(F.least(F.ceil(F.col("fraction") * F.col("n_scored") - 1e-9), F.col("n_scored")), F.lit(0))
    return targets.join(totals, "source", "left").join(found, "source", "left").select(
        "source", F.coalesce("n_scored", F.lit(0)).alias("n_scored"), F.coalesce(wanted, F.lit(0)).cast("bigint").alias("n_target"), "cutoff", F.coalesce("n_kept", F.lit(0)).alias("n_kept")
    )


def kept(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(row_id, source, score, cutoff): the records from their source's cutoff on."""
    cuts = persist_shared(cutoffs(records, targets).filter("cutoff is not null").select("source", "cutoff"), "cutoffs")
    return records.join(bounded(cuts), "source").filter("score >= cutoff")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "sector_targets").select(F.lower(F.trim("sector")).alias("source"), F.col("keep_fraction").alias("fraction"))
    return persist_shared(scored(table(spark, sf_dir, "images_meta"), table(spark, sf_dir, "web_classifier_results")), "scored"), targets


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(*_inputs(spark, sf_dir)).select("row_id", F.col("source").alias("sector"), "score", "cutoff")


def p5_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, targets = _inputs(spark, sf_dir)
    return cutoffs(records, targets).withColumnRenamed("source", "sector")


def p5_beside_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sector's cutoff beside each threshold of the models: how many records that threshold would keep."""
    records, targets = _inputs(spark, sf_dir)
    thresholds = table(spark, sf_dir, "genai_b120_thresholds_by_model").select("threshold").distinct()
    # each record counts for the greatest threshold it reaches; the counts are then summed over the thresholds
    listed = F.broadcast(thresholds.agg(F.array_sort(F.collect_set("threshold")).alias("ts")))  # fixed table
    reached = F.try_element_at(F.filter("ts", lambda t: t <= F.col("score")), F.lit(-1))
    steps = records.crossJoin(listed).filter(F.col("ts")[0] <= F.col("score")).groupBy("source", reached.alias("t")).agg(F.count("*").alias("n"))
    own = cutoffs(records, targets).crossJoin(F.broadcast(thresholds))
    at = own.join(steps, (own["source"] == steps["source"]) & (steps["t"] >= own["threshold"]), "left").groupBy(own["source"].alias("sector"), "threshold", "cutoff", "n_kept")
    return at.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_at_threshold"))


_SQL = r"""
with best as (select image_url, max_by(score, result_id) as score from web_classifier_results where score is not null and score::varchar <> 'nan' and score between 0 and 1 and image_url is not null group by 1),
r as (select lower(regexp_replace(sector, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')) as sector, score from images_meta join best using (image_url) where trim(sector) <> ''),
n as (select sector, count(*) as n_scored from r group by 1),
t as (select s.sector, keep_fraction, coalesce(n_scored, 0) as n_scored, greatest(least(ceil(keep_fraction * coalesce(n_scored, 0) - 1e-9), coalesce(n_scored, 0)), 0)::bigint as n_target from sector_targets s left join n on s.sector = n.sector),
k as (select r.sector, score, n_target, rank() over (partition by r.sector order by score desc) as before_, count(*) over (partition by r.sector order by score desc) as kept from r join t on r.sector = t.sector),
c as (select sector, max(score) as cutoff, min(kept) as n_kept from k where kept >= n_target and n_target > 0 group by 1),
own as (select t.sector, n_scored, n_target, cutoff, coalesce(n_kept, 0) as n_kept from t left join c on t.sector = c.sector)
"""
QUERIES = {"p5_kept": p5_kept, "p5_cutoffs": p5_cutoffs, "p5_beside_thresholds": p5_beside_thresholds}
SQL = {
    "p5_kept": _SQL.replace("select lower(regexp", "select row_id, lower(regexp") + "select row_id, r.sector, r.score, own.cutoff from r join own on r.sector = own.sector where r.score >= own.cutoff",
    "p5_cutoffs": _SQL + "select * from own",
    "p5_beside_thresholds": _SQL
    + """select own.sector, threshold, cutoff, n_kept, (select count(*) from r where r.sector = own.sector and r.score >= th.threshold) as n_at_threshold
    from own, (select distinct threshold from genai_b120_thresholds_by_model) th""",
}
