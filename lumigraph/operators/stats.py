"""Group statistics, confusion counts and curve metrics over scores.

All are single aggregations (map-side combined) or sums over counts per distinct score (ordered): nothing sorts the
scores of the whole table, or of one key, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigraph.operators import ordered


def score_stats(df: DataFrame, keys: list[str], score: str, population: bool = False) -> DataFrame:
    """n, mean, median, std, min, max and quartiles, exact; std of the sample, or of the population with 0.0 for no rows."""
    s = F.col(score)
    aggs = [F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std") if population else F.stddev_samp(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max")]
    q = ordered.quantiles(df, keys, score, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    out = df.groupBy(*keys).agg(*aggs)
    if keys:
        out = out.alias("l").join(q.alias("r"), ordered._same("l", "r", keys), "left").select(*[F.col(f"l.{c}") for c in out.columns], "q25", "median", "q75")
    else:
        out = out.crossJoin(q)  # one row each
    out = out.select(*keys, "n", "mean", "median", "std", "min", "max", "q25", "q75")
    return out.fillna(0.0, [c for c in ("mean", "median", "std", "min", "max", "q25", "q75")]) if population else out


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element at n div 2 of the sorted values, from counts per distinct value."""
    at = ordered.cumulative_counts(df, keys, value)
    return at.filter(F.col("through") > F.floor(F.col("through_total") / 2)).groupBy(*keys).agg(F.min(value).alias("upper_median"))


def fixed_domain_counts(df: DataFrame, keys: list[str], column: str, domain: list) -> DataFrame:
    """One count column per value of the domain, 0 where a value does not occur."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in domain])


def with_global(df: DataFrame, key: str, aggs: list[Column], name: str = "GLOBAL") -> DataFrame:
    """One row per key and one over all rows (not an average of averages)."""
    return df.rollup(key).agg(F.grouping(key).alias("__all"), *aggs).withColumn(key, F.when(F.col("__all") == 1, name).otherwise(F.col(key))).drop("__all")


def confusion(df: DataFrame, keys: list[str], pred: Column, gt: Column) -> DataFrame:
    """Counts and ratios of predictions against labels; null where there are no labels or a denominator is 0."""
    has = gt.isNotNull()
    c = lambda p, g: F.count_if(has & (pred == p) & (gt == g))
    base = df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(pred == 1).alias("pred_ai"), F.count_if(pred == 0).alias("pred_real"), F.count_if(has).alias("with_gt"),
        c(1, 1).alias("tp"), c(0, 1).alias("fn"), c(0, 0).alias("tn"), c(1, 0).alias("fp"), F.count_if(has & (pred == gt)).alias("correct"),
    )
    known = F.col("with_gt") > 0
    ratio = lambda a, *b: F.try_divide(F.col(a), sum((F.col(x) for x in b[1:]), F.col(b[0])))
    return base.select(
        *keys, "total", "pred_ai", "pred_real", "with_gt", ratio("correct", "with_gt").alias("accuracy"),
        *[F.when(known, F.col(a)).alias(b) for a, b in (("tp", "ai_tp"), ("fn", "ai_fn"), ("tn", "real_tn"), ("fp", "real_fp"))],
        ratio("tp", "tp", "fn").alias("ai_recall"), ratio("fn", "tp", "fn").alias("ai_fn_rate"), ratio("tn", "tn", "fp").alias("real_specificity"), ratio("fp", "tn", "fp").alias("real_fpr"),
    )


def threshold_sweep(df: DataFrame, keys: list[str], score: Column, gt: Column, thresholds: list[float]) -> DataFrame:
    """Confusion per threshold; the thresholds (a few) are exploded beside each row and combined on the map side."""
    t = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    pred = F.when(F.coalesce(F.nanvl(score, F.lit(None).cast("double")) >= F.col("threshold"), F.lit(False)), 1).otherwise(0)
    return confusion(t, [*keys, "threshold"], pred, gt)


def by_score(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """(keys, s, pos, neg, cum_pos, cum_neg, P, N): labelled counts per distinct score, summed from the greatest down."""
    counts = (
        df.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("s"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )
    c = ordered.running(counts, keys, [F.desc("s")], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}, totals=True)
    return c.withColumnsRenamed({"cum_pos_total": "P", "cum_neg_total": "N"})


def curve_metrics(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """auroc, average precision, area under precision-recall by trapezoids, and the best F1, per group."""
    c = by_score(df, keys, score, label)
    # the point before a score is what its own counts leave: no row looks at its neighbour
    pos0, neg0 = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    c = c.withColumn("precision", (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).cast("double")).withColumn("recall", F.try_divide(F.col("cum_pos"), F.col("P")).cast("double"))
    c = c.withColumn("p0", F.coalesce(F.try_divide(pos0, pos0 + neg0), F.lit(1.0))).withColumn("r0", F.coalesce(F.try_divide(pos0, F.col("P")), F.lit(0.0)))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    pairs = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos")) + F.col("neg") * F.col("pos") * 0.5)
    return c.groupBy(*keys).agg(
        F.try_divide(pairs, F.max(F.col("P") * F.col("N")).cast("double")).alias("auroc"), F.sum((F.col("recall") - F.col("r0")) * F.col("precision")).alias("avg_precision"),
        F.sum((F.col("recall") - F.col("r0")) * (F.col("precision") + F.col("p0")) / 2).alias("pr_auc_trapz"), F.max(f1).alias("f1_best"),
    )


def confusion_scores(counts: DataFrame, keys: list[str]) -> DataFrame:
    """accuracy, IoU, precision (1 if undefined), recall, F1 (0 if undefined) of columns tp, fp, tn, fn."""
    d = lambda a, *b: F.try_divide(F.col(a).cast("double"), sum((F.col(x) for x in b[1:]), F.col(b[0])))
    p, r = F.coalesce(d("tp", "tp", "fp"), F.lit(1.0)), d("tp", "tp", "fn")
    return counts.select(
        *keys, F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("accuracy"),
        d("tp", "tp", "fp", "fn").alias("iou"), p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"),
    )


def histogram(df: DataFrame, value: str, bins: int, keys: list[str] | None = None) -> DataFrame:
    """Equal-width bins between the least and greatest value, the last closed; bins without a value have 0."""
    keys = keys or []
    ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter("lo is not null")
    rows = df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))  # without keys one row of two numbers
    bin_ = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)))
    found = rows.filter(F.col(value).isNotNull()).groupBy(*keys, bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(found, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"), "lo", "hi")


def edges_histogram(value: Column, edges: list[float]) -> Column:
    """Number of the bin between edges, closed to the left, the last on both sides; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        upper = value <= edges[i + 1] if i == len(edges) - 2 else value < edges[i + 1]
        out = F.when((value >= edges[i]) & upper, i).otherwise(out)
    return out


def reduce_column(df: DataFrame, key: str, value: str, how: str, order: str, carry: list[str]) -> DataFrame:
    """One row per key: the average, spread (0 for one row) or count of a column; other columns of the first row."""
    agg = {"avg": F.avg(value), "std": F.coalesce(F.stddev_samp(value), F.lit(0.0)), "count": F.count(value)}[how]
    return df.groupBy(key).agg(agg.alias(f"{value}_{how}"), *[F.min_by(c, order).alias(c) for c in carry])


def unpivot_counts(df: DataFrame, columns: list[str], name: str = "reason", value: str = "n") -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns])).alias("x")).select("x.*").filter(F.col(value) > 0)


def success_rate(df: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Rows, successes and their share in percent, per key; 0.0 where there are no rows."""
    n, good = F.count("*"), F.count_if(ok)
    return df.groupBy(*keys).agg(n.alias("total"), good.alias("succeeded"), (n - good).alias("failed"), F.when(n > 0, F.lit(100.0) * good / n).otherwise(0.0).alias("success_percent"))


def label_names(df: DataFrame, label: str, name: str) -> DataFrame:
    """(label, name) of every label: the name that most of its rows have (the first of the alphabet on ties)."""
    n = df.filter(F.col(label).isNotNull() & F.col(name).isNotNull()).groupBy(label, name).agg(F.count("*").alias("n"))
    return n.groupBy(label).agg(F.min_by(name, F.struct(-F.col("n"), F.col(name))).alias(name))


def long_scores(sets: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """(origin, measure, value): the score columns of several tables in one long form, nulls left out."""
    out = None
    for origin, df in sets.items():
        one = df.select(F.lit(origin).alias("origin"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["origin"], columns, "measure", "value").filter("value is not null")
        out = one if out is None else out.unionByName(one)
    return out


def precision_recall_series(df: DataFrame, keys: list[str], score: Column, gt: Column, steps: int = 100) -> DataFrame:
    """(keys, threshold, precision, recall) at equally spaced thresholds from 0 to 1.

    A row counts at the greatest threshold it reaches; counts of so many steps are then summed from the top.
    """
    reached = F.least(F.floor(score * (steps - 1) + 1e-9), F.lit(steps - 1)).cast("int")
    valid = df.filter(score.isNotNull() & ~F.isnan(score) & (score >= 0) & gt.isNotNull())
    counts = valid.groupBy(*keys, reached.alias("step")).agg(F.count_if(gt == 1).alias("pos"), F.count_if(gt == 0).alias("neg"))
    every = counts.select(*keys).distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    full = every.join(counts, [*keys, "step"], "left")
    down = Window.partitionBy(*keys).orderBy(F.desc("step"))  # so many rows a key
    tp, fp = F.coalesce(F.sum("pos").over(down), F.lit(0)), F.coalesce(F.sum("neg").over(down), F.lit(0))
    summed = full.select(*keys, "step", tp.alias("tp"), fp.alias("fp"), F.sum("pos").over(Window.partitionBy(*keys)).alias("p"))
    return summed.select(*keys, (F.col("step") / F.lit(float(steps - 1))).alias("threshold"), F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(1.0)).alias("precision"), F.try_divide(F.col("tp").cast("double"), F.col("p")).alias("recall"))
