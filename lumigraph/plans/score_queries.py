"""Queries over classifier scores: group statistics, thresholds, curves, samples, set operations.

Where a query needs a label, web_classifier_results gets a stand-in one from its result_id (null for a fifth of the rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.functions import references as R
from lumigraph.functions import text as X
from lumigraph.functions import url as U
from lumigraph.operators import curves as C
from lumigraph.operators import filters as P
from lumigraph.operators import ordered
from lumigraph.operators import stats as S
from lumigraph.plans.registry import query
from lumigraph.session import table

THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
_T = "(values " + ",".join(f"({t}::double)" for t in THRESHOLDS) + ") t(threshold)"
_GT = "case when result_id % 5 = 0 then null when (result_id * 7919) % 10 < 4 then 1 else 0 end"
_OK = "score is not null and score::varchar <> 'nan' and score between 0 and 1"
_R = f"with r as (select *, {_GT} as gt from web_classifier_results), v as (select * from r where {_OK}) "


def results(spark: SparkSession, d: str) -> DataFrame:
    gt = F.when(F.col("result_id") % 5 == 0, None).when((F.col("result_id") * 7919) % 10 < 4, 1).otherwise(0)
    return table(spark, d, "web_classifier_results").withColumn("gt", gt)


def valid(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).filter("score is not null and not isnan(score) and score between 0 and 1")


@query("count_by_key", "select source, count(*) as n from web_classifier_results where source is not null group by 1")
def count_by_key(spark, d):
    return results(spark, d).filter("source is not null").groupBy("source").agg(F.count("*").alias("n"))


@query("two_key_count", "select sector, subsector, count(*) as n from images_meta group by 1, 2")
def two_key_count(spark, d):
    return table(spark, d, "images_meta").groupBy("sector", "subsector").agg(F.count("*").alias("n"))


@query("fixed_domain_counts", "select source, count(*) filter (predicted_label = 0) as n_0, count(*) filter (predicted_label = 1) as n_1 from web_classifier_results group by 1")
def fixed_domain_counts(spark, d):
    return S.fixed_domain_counts(results(spark, d), ["source"], "predicted_label", [0, 1])


_STATS = "count(score) as n, avg(score) as mean, median(score) as median, {std}(score) as std, min(score) as min, max(score) as max, quantile_cont(score, 0.25) as q25, quantile_cont(score, 0.75) as q75"


@query("score_stats_by_group", _R + "select source, " + _STATS.format(std="stddev_samp") + " from v group by 1")
def score_stats_by_group(spark, d):
    return S.score_stats(valid(spark, d), ["source"], "score")


@query("score_stats_global", _R + "select " + _STATS.format(std="stddev_pop") + " from v")
def score_stats_global(spark, d):
    return S.score_stats(valid(spark, d), [], "score", population=True)


@query("upper_median", _R + "select source, list_sort(list(score))[(len(list(score)) // 2 + 1)::int] as upper_median from v group by 1")
def upper_median(spark, d):
    return S.upper_median(valid(spark, d), ["source"], "score")


@query("rollup_global", _R + "select coalesce(source, 'GLOBAL') as source, count(*) as n, avg(score) as mean, count(*) filter (predicted_label = 1) as n_ai from v where source is not null group by rollup(source)")
def rollup_global(spark, d):
    return S.with_global(valid(spark, d).filter("source is not null"), "source", [F.count("*").alias("n"), F.avg("score").alias("mean"), F.count_if(F.col("predicted_label") == 1).alias("n_ai")])


@query("false_positive_rates", _R + "select coalesce(source, 'GLOBAL') as category, count(*) as total, count(*) filter (score >= 0.6) as false_positives, 100.0::double * count(*) filter (score >= 0.6) / count(*) as fpr_percent from v where source is not null group by rollup(source)")
def false_positive_rates(spark, d):
    v = valid(spark, d).filter("source is not null").withColumnRenamed("source", "category")
    fp = F.count_if(F.col("score") >= 0.6)
    return S.with_global(v, "category", [F.count("*").alias("total"), fp.alias("false_positives"), (F.lit(100.0) * fp / F.count("*")).alias("fpr_percent")])


_CONF = """count(*) as total, count(*) filter (p = 1) as pred_ai, count(*) filter (p = 0) as pred_real, count(gt) as with_gt, count(*) filter (p = gt)::double / nullif(count(gt), 0) as accuracy,
case when count(gt) > 0 then count(*) filter (p = 1 and gt = 1) end as ai_tp, case when count(gt) > 0 then count(*) filter (p = 0 and gt = 1) end as ai_fn, case when count(gt) > 0 then count(*) filter (p = 0 and gt = 0) end as real_tn, case when count(gt) > 0 then count(*) filter (p = 1 and gt = 0) end as real_fp,
count(*) filter (p = 1 and gt = 1)::double / nullif(count(*) filter (gt = 1), 0) as ai_recall, count(*) filter (p = 0 and gt = 1)::double / nullif(count(*) filter (gt = 1), 0) as ai_fn_rate,
count(*) filter (p = 0 and gt = 0)::double / nullif(count(*) filter (gt = 0), 0) as real_specificity, count(*) filter (p = 1 and gt = 0)::double / nullif(count(*) filter (gt = 0), 0) as real_fpr"""
_SWEPT = _R + f", s as (select *, case when score::varchar <> 'nan' and score >= t.threshold then 1 else 0 end as p, t.threshold as th from r, {_T}) "


@query("threshold_sweep_global", _SWEPT + f"select th as threshold, {_CONF} from s group by 1")
def threshold_sweep_global(spark, d):
    return S.threshold_sweep(results(spark, d).drop("threshold"), [], F.col("score"), F.col("gt"), THRESHOLDS)


@query("threshold_sweep_by_group", _SWEPT + f"select source, th as threshold, {_CONF} from s where source is not null group by 1, 2")
def threshold_sweep_by_group(spark, d):
    return S.threshold_sweep(results(spark, d).drop("threshold").filter("source is not null"), ["source"], F.col("score"), F.col("gt"), THRESHOLDS)


@query("confusion_by_group", _R + f"select source, {_CONF} from (select *, coalesce(predicted_label, 0) as p from r) group by 1")
def confusion_by_group(spark, d):
    return S.confusion(results(spark, d), ["source"], F.coalesce("predicted_label", F.lit(0)), F.col("gt"))


@query("cm_metrics", _R + """, c as (select source, count(*) filter (p = 1 and gt = 1) as tp, count(*) filter (p = 1 and gt = 0) as fp, count(*) filter (p = 0 and gt = 0) as tn, count(*) filter (p = 0 and gt = 1) as fn from (select *, predicted_label as p from v) group by 1),
m as (select source, (tp + tn)::double / nullif(tp + fp + tn + fn, 0) as accuracy, tp::double / nullif(tp + fp + fn, 0) as iou, coalesce(tp::double / nullif(tp + fp, 0), 1.0) as precision, tp::double / nullif(tp + fn, 0) as recall from c)
select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) as f1 from m""")
def cm_metrics(spark, d):
    p, g = F.col("predicted_label"), F.col("gt")
    counts = valid(spark, d).groupBy("source").agg(F.count_if((p == 1) & (g == 1)).alias("tp"), F.count_if((p == 1) & (g == 0)).alias("fp"), F.count_if((p == 0) & (g == 0)).alias("tn"), F.count_if((p == 0) & (g == 1)).alias("fn"))
    return S.confusion_scores(counts, ["source"])


_CURVE = _R + """, c as (select score as s, count(*) filter (gt = 1) as pos, count(*) filter (gt = 0) as neg from v where gt is not null group by 1),
k as (select *, sum(pos) over (order by s desc) as cp, sum(neg) over (order by s desc) as cn, sum(pos) over () as pp, sum(neg) over () as nn from c),
m as (select *, cp::double / (cp + cn) as pr, cp::double / nullif(pp, 0) as rc from k),
l as (select *, coalesce(lag(pr) over (order by s desc), 1.0) as p0, coalesce(lag(rc) over (order by s desc), 0.0) as r0 from m) """


@query("curve_metrics", _CURVE + "select sum(neg * (cp - pos) + neg * pos * 0.5::double) / max(pp * nn)::double as auroc, sum((rc - r0) * pr) as avg_precision, sum((rc - r0) * (pr + p0) / 2) as pr_auc_trapz, max(2 * pr * rc / nullif(pr + rc, 0)) as f1_best from l")
def curve_metrics(spark, d):
    return S.curve_metrics(valid(spark, d), [], "score", "gt")


@query("roc_points", _CURVE + "select s as score, cn::double / nullif(nn, 0) as fpr, rc as tpr from l")
def roc_points(spark, d):
    c = S.by_score(valid(spark, d), [], "score", "gt")
    return c.select(F.col("s").alias("score"), F.try_divide(F.col("cum_neg"), F.col("N")).alias("fpr"), F.try_divide(F.col("cum_pos"), F.col("P")).alias("tpr"))


@query("histogram_equal_width", _R + ", e as (select min(score) as lo, max(score) as hi from v), h as (select least(floor((score - lo) / ((hi - lo) / 25)), 24)::int as bin, count(*) as n from v, e group by 1) select b::int as bin, coalesce(n, 0) as n, lo, hi from range(25) t(b) cross join e left join h on b = bin")
def histogram_equal_width(spark, d):
    return S.histogram(valid(spark, d), "score", 25)


@query("histogram_custom", _R + "select case when score < 0.1 then 0 when score < 0.3 then 1 when score < 0.5 then 2 when score < 0.7 then 3 when score < 0.9 then 4 else 5 end as bin, count(*) as n from v group by 1")
def histogram_custom(spark, d):
    return valid(spark, d).groupBy(S.edges_histogram(F.col("score"), [0, 0.1, 0.3, 0.5, 0.7, 0.9, 1]).alias("bin")).agg(F.count("*").alias("n"))


@query("ecdf", _R + "select source, score, max(rn)::double / max(n) as share from (select source, score, row_number() over (partition by source order by score) as rn, count(*) over (partition by source) as n from v) group by 1, 2")
def ecdf(spark, d):
    return C.ecdf(valid(spark, d), "score", ["source"])


@query("score_curve", _R + "select source, result_id, row_number() over (partition by source order by score desc, result_id) as rank from v")
def score_curve(spark, d):
    return ordered.ranked(valid(spark, d).select("source", "result_id", "score"), ["source"], [F.desc("score"), F.col("result_id")]).select("source", "result_id", "rank")


@query("running_accuracy", _R + "select result_id, sum(case when predicted_label = gt then 1 else 0 end) over w::double / count(*) over w as accuracy from v where gt is not null window w as (partition by source order by result_id rows unbounded preceding)")
def running_accuracy(spark, d):
    v = valid(spark, d).filter("gt is not null").select("source", "result_id", (F.col("predicted_label") == F.col("gt")).cast("int").alias("ok"))
    return C.running(v, ["source"], "result_id", c=F.coalesce("ok", F.lit(0)), n=F.lit(1)).select("result_id", (F.col("c") / F.col("n")).alias("accuracy"))


@query("running_bce", _R + "select result_id, round(avg(-(gt * ln(greatest(1e-7, least(1 - 1e-7, score))) + (1 - gt) * ln(1 - greatest(1e-7, least(1 - 1e-7, score))))) over (partition by source order by result_id rows unbounded preceding), 6) as loss from v where gt is not null")
def running_bce(spark, d):
    v = valid(spark, d).filter("gt is not null").select("source", "result_id", C.bce(F.col("score"), F.col("gt")).alias("l"))
    return C.running(v, ["source"], "result_id", s=F.col("l"), n=F.lit(1)).select("result_id", F.round(F.col("s") / F.col("n"), 6).alias("loss"))


@query("running_log", _R + """select result_id, sum(case when predicted_label = 1 then 1 else 0 end) over w as running_ai, sum(case when predicted_label = 0 then 1 else 0 end) over w as running_real, count(gt) over w as running_with_gt,
sum(case when predicted_label = gt then 1 else 0 end) over w::double / nullif(count(gt) over w, 0) as running_accuracy from r window w as (partition by source order by result_id rows unbounded preceding)""")
def running_log(spark, d):
    p, g = F.col("predicted_label"), F.col("gt")
    one = lambda c: F.when(c, 1).otherwise(0)
    r = C.running(results(spark, d), ["source"], "result_id", running_ai=one(p == 1), running_real=one(p == 0), running_with_gt=one(g.isNotNull()), ok=one(p == g))
    return r.select("result_id", "running_ai", "running_real", "running_with_gt", F.try_divide(F.col("ok"), F.col("running_with_gt")).alias("running_accuracy"))


@query("accuracy_vs_threshold", _R + "select source, (i / 20.0::double) as threshold, avg(case when score < i / 20.0::double then 1.0 else 0.0 end) as accuracy from v, range(21) t(i) where source is not null group by 1, 2")
def accuracy_vs_threshold(spark, d):
    v = valid(spark, d).filter("source is not null").select("source", "score", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    t = F.col("i") / F.lit(20.0)
    return v.groupBy("source", t.alias("threshold")).agg(F.avg((F.col("score") < t).cast("double")).alias("accuracy"))


@query("topk_box", _R + ", k as (select source from v where source is not null group by 1 order by count(*) desc, source limit 10) select source, quantile_cont(score, 0.25) as q25, median(score) as median, quantile_cont(score, 0.75) as q75 from v where source in (select source from k) group by 1")
def topk_box(spark, d):
    v = valid(spark, d).filter("source is not null")
    top = v.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10).select("source")
    return ordered.quantiles(v.join(F.broadcast(top), "source", "left_semi"), ["source"], "score", {"q25": 0.25, "median": 0.5, "q75": 0.75})


@query("balanced_quota", "select row_id, sector from (select row_id, sector, row_number() over (partition by sector order by row_id) as rn from images_meta where sector in ('museum', 'press', 'retail')) where rn <= case sector when 'museum' then 50 when 'press' then 30 else 20 end")
def balanced_quota(spark, d):
    return C.quota(table(spark, d, "images_meta").select("row_id", "sector"), "sector", {"museum": 50, "press": 30, "retail": 20}, "row_id")


@query("spread_k", "with x as (select row_id, wayback_year, row_number() over (partition by wayback_year order by row_id) - 1 as i, count(*) over (partition by wayback_year) as n from images_meta where wayback_year is not null) select row_id, wayback_year from x where n <= 5 or i in (select round_even(j * (n - 1) / 4.0::double, 0)::bigint from range(5) t(j))")
def spread_k(spark, d):
    return C.spread(table(spark, d, "images_meta").filter("wayback_year is not null").select("row_id", "wayback_year"), "wayback_year", "row_id", 5)


@query("systematic_sample", "with x as (select row_id, source, row_number() over (partition by source order by row_id) - 1 as i, greatest(count(*) over (partition by source) // 100, 1) as step from images_meta) select row_id, source from x where i % step = 0 and i // step < 100")
def systematic_sample(spark, d):
    return C.every_nth(table(spark, d, "images_meta").select("row_id", "source"), "source", "row_id", 100)


@query("hash_sample")
def hash_sample(spark, d):
    return C.hash_sample(table(spark, d, "images_meta").select("row_id"), "row_id", 0.1)


@query("uniform_sample")
def uniform_sample(spark, d):
    return C.sample_n(table(spark, d, "images_meta").select("row_id"), "row_id", 100)


@query("stable_sort_topk", _R + "select source, result_id, score from v where source is not null order by source, score desc, result_id limit 100")
def stable_sort_topk(spark, d):
    return valid(spark, d).filter("source is not null").select("source", "result_id", "score").orderBy("source", F.desc("score"), "result_id").limit(100)


@query("top_sites", "select website_url, count(*) as n from images_meta where website_url is not null group by 1 order by 2 desc, 1 limit 15")
def top_sites(spark, d):
    return table(spark, d, "images_meta").filter("website_url is not null").groupBy("website_url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "website_url").limit(15)


@query("month_collapse", "select original, substr(snapshot_ts, 1, 6) as month, min(snapshot_ts) as first_ts from snapshots where length(snapshot_ts) >= 6 group by 1, 2")
def month_collapse(spark, d):
    return table(spark, d, "snapshots").filter("length(snapshot_ts) >= 6").groupBy("original", F.substring("snapshot_ts", 1, 6).alias("month")).agg(F.min("snapshot_ts").alias("first_ts"))


@query("adjacent_dedup", "select snapshot_id from (select snapshot_id, snapshot_year as y, lag(snapshot_year) over (partition by original order by snapshot_ts, snapshot_id) as b from snapshots where snapshot_year is not null) where b is null or b <> y")
def adjacent_dedup(spark, d):
    s = table(spark, d, "snapshots").filter("snapshot_year is not null").withColumn("o", F.struct("snapshot_ts", "snapshot_id"))
    return C.drop_adjacent(s, "original", "o", "snapshot_year").select("snapshot_id")


@query("yearly_summary", """select snapshot_year as year, count(*) as total, count(distinct original) as n_sites, min(snapshot_ts) as first_ts, max(snapshot_ts) as last_ts from snapshots where snapshot_year is not null group by 1""")
def yearly_summary(spark, d):
    return table(spark, d, "snapshots").filter("snapshot_year is not null").groupBy(F.col("snapshot_year").alias("year")).agg(F.count("*").alias("total"), F.countDistinct("original").alias("n_sites"), F.min("snapshot_ts").alias("first_ts"), F.max("snapshot_ts").alias("last_ts"))


@query("union_by_name", "select image_url, 'images' as origin from images_meta union all by name select image_url, 'results' as origin from web_classifier_results")
def union_by_name(spark, d):
    a, b = table(spark, d, "images_meta").select("image_url", F.lit("images").alias("origin")), table(spark, d, "web_classifier_results").select(F.lit("results").alias("origin"), "image_url")
    return a.unionByName(b)


@query("url_set_union", "select image_url as url from images_meta where image_url is not null union select source_page from web_classifier_results where source_page is not null")
def url_set_union(spark, d):
    return table(spark, d, "images_meta").selectExpr("image_url as url").union(table(spark, d, "web_classifier_results").selectExpr("source_page as url")).filter("url is not null").distinct()


@query("url_set_difference", "select distinct image_url from web_classifier_results where image_url is not null and image_url not in (select image_url from images_meta where image_url is not null)")
def url_set_difference(spark, d):
    r, i = table(spark, d, "web_classifier_results"), table(spark, d, "images_meta")
    return r.filter("image_url is not null").select("image_url").distinct().join(i.select("image_url"), "image_url", "left_anti")


@query("token_subset", "select row_id from (select row_id, list_filter(string_split_regex(lower(trim(img_title, ' ')), '\\s+'), lambda x: x <> '') as t from images_meta where img_title is not null) where len(t) > 0 and len(list_filter(t, lambda x: x not in ('image','img','photo','picture','thumbnail','art','untitled','null','undefined'))) = 0")
def token_subset(spark, d):
    t = F.filter(F.split(F.lower(F.trim("img_title")), r"\s+"), lambda x: x != "")
    generic = F.array(*map(F.lit, [*X.GENERIC_TOKENS, "null", "undefined"]))
    return table(spark, d, "images_meta").filter("img_title is not null").filter((F.size(t) > 0) & (F.size(F.array_except(t, generic)) == 0)).select("row_id")


@query("gt_resolution", "select result_id, case lower(coalesce(predicted_label_name, 'none')) when 'ai' then '1' when 'real' then '0' else coalesce(predicted_label_name, cast(predicted_label as varchar)) end as label, case when predicted_label_name is not null then '0' when predicted_label is not null then '1' else 'none' end as source from web_classifier_results")
def gt_resolution(spark, d):
    g = X.resolve_label([F.col("predicted_label_name"), F.col("predicted_label").cast("string")], {"ai": "1", "real": "0"})
    return results(spark, d).select("result_id", g.alias("g")).select("result_id", "g.label", "g.source")


@query("int_or_null", "select row_id, case when regexp_matches(trim(substr(wayback_timestamp, 1, 8), ' '), '^[+-]?\\d+$') then trim(substr(wayback_timestamp, 1, 8), ' ')::bigint end as day from images_meta")
def int_or_null(spark, d):
    return table(spark, d, "images_meta").select("row_id", X.int_or_null(F.substring("wayback_timestamp", 1, 8)).alias("day"))


@query("sigmoid_label", _R + "select result_id, round(1 / (1 + exp(-(score * 4 - 2))), 9) as p, case when 1 / (1 + exp(-(score * 4 - 2))) >= 0.6 then 1 else 0 end as label from v")
def sigmoid_label(spark, d):
    p = X.sigmoid(F.col("score") * 4 - 2)
    return valid(spark, d).select("result_id", F.round(p, 9).alias("p"), X.label_of(p, 0.6).alias("label"))


@query("label_with_nan", "select result_id, case when score is not null and score::varchar <> 'nan' and score >= 0.6 then 1 else 0 end as label from web_classifier_results")
def label_with_nan(spark, d):
    return results(spark, d).select("result_id", X.label_of(F.col("score"), 0.6).alias("label"))


@query("reduce_column", _R + "select source, coalesce(stddev_samp(score), 0.0) as score_std, min_by(image_url, result_id) as image_url from v where source is not null group by 1")
def reduce_column(spark, d):
    return S.reduce_column(valid(spark, d).filter("source is not null"), "source", "score", "std", "result_id", ["image_url"])


@query("reason_counts", "select reason, n from (select count(*) filter (score is null) as is_null, count(*) filter (score::varchar = 'nan') as is_nan, count(*) filter (score < 0) as below, count(*) filter (score > 1 and score::varchar <> 'nan') as above from web_classifier_results) unpivot (n for reason in (is_null, is_nan, below, above)) where n > 0")
def reason_counts(spark, d):
    s = F.col("score")
    one = results(spark, d).agg(F.count_if(s.isNull()).alias("is_null"), F.count_if(F.isnan(s)).alias("is_nan"), F.count_if(s < 0).alias("below"), F.count_if((s > 1) & ~F.isnan(s)).alias("above"))
    return S.unpivot_counts(one, ["is_null", "is_nan", "below", "above"])


@query("model_thresholds_sum", "select threshold, sum(total) as total, sum(ai_tp) as ai_tp, sum(ai_fn) as ai_fn, sum(ai_tp)::double / sum(with_gt) as accuracy from genai_b120_thresholds_by_model group by 1")
def model_thresholds_sum(spark, d):
    t = table(spark, d, "genai_b120_thresholds_by_model")
    return t.groupBy("threshold").agg(F.sum("total").alias("total"), F.sum("ai_tp").alias("ai_tp"), F.sum("ai_fn").alias("ai_fn"), (F.sum("ai_tp") / F.sum("with_gt")).alias("accuracy"))


@query("wide_to_long", "select image_model, threshold, label, n from (select image_model, threshold, pred_ai, pred_real from genai_b120_thresholds_by_model) unpivot (n for label in (pred_ai, pred_real))")
def wide_to_long(spark, d):
    return table(spark, d, "genai_b120_thresholds_by_model").unpivot(["image_model", "threshold"], ["pred_ai", "pred_real"], "label", "n")


@query("sorted_distinct", "select image_model, list_sort(list_distinct(list(threshold)))[1] as thresholds from genai_b120_thresholds_by_model group by 1")
def sorted_distinct(spark, d):
    return table(spark, d, "genai_b120_thresholds_by_model").groupBy("image_model").agg(F.array_sort(F.collect_set("threshold"))[0].alias("thresholds"))


@query("cosine_softmax", """with c as (select a.vec_id, list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[])) as c0,
list_dot_product(a.embedding::double[], e.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(e.embedding::double[], e.embedding::double[])) as c1
from embeddings a, (select embedding from embeddings order by vec_id limit 1) b, (select embedding from embeddings order by vec_id desc limit 1) e) select vec_id, round(exp(c0) / (exp(c0) + exp(c1)), 6) as p from c""")
def cosine_softmax(spark, d):
    e = table(spark, d, "embeddings")
    ends = e.agg(F.min_by("embedding", "vec_id").alias("b"), F.max_by("embedding", "vec_id").alias("e"))  # one row
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    cos = lambda x, y: dot(F.col(x), F.col(y)) / F.sqrt(dot(F.col(x), F.col(x)) * dot(F.col(y), F.col(y)))
    r = e.crossJoin(F.broadcast(ends)).select("vec_id", cos("embedding", "b").alias("c0"), cos("embedding", "e").alias("c1"))
    return r.select("vec_id", F.round(F.exp("c0") / (F.exp("c0") + F.exp("c1")), 6).alias("p"))


@query("link_depths", """with e as (select distinct website_url as parent, page_url as child from images_meta where website_url is not null and page_url is not null and website_url <> page_url)
select parent as url, 0 as depth from e union select child, 1 from e where child not in (select parent from e)""")
def link_depths(spark, d):
    from lumigraph.operators.crawl import reachable

    i = table(spark, d, "images_meta").filter("website_url is not null and page_url is not null and website_url <> page_url")
    edges = i.selectExpr("website_url as parent", "page_url as child").distinct()
    return reachable(edges, edges.select(F.col("parent").alias("url")), 2)


@query("path_offsets", "select row_id, coalesce(sum(length(stored_path)) over (order by row_id rows between unbounded preceding and 1 preceding), 0)::bigint as offset from images_meta")
def path_offsets(spark, d):
    return C.offsets(table(spark, d, "images_meta").select("row_id", F.length("stored_path").alias("n")), "row_id", "n").select("row_id", F.col("offset").cast("bigint").alias("offset"))


@query("directory_counts", "select regexp_replace(stored_path, '/[^/]*$', '') as dir, count(*) as n from images_meta group by 1")
def directory_counts(spark, d):
    return table(spark, d, "images_meta").groupBy(F.regexp_replace("stored_path", "/[^/]*$", "").alias("dir")).agg(F.count("*").alias("n"))


@query("host_counts", "select lower(regexp_extract(source_page, '^[a-z]+://([^/?#]*)', 1)) as host, count(*) as n from web_classifier_results where source_page is not null group by 1")
def host_counts(spark, d):
    return results(spark, d).filter("source_page is not null").groupBy(U.netloc(F.col("source_page")).alias("host")).agg(F.count("*").alias("n"))


@query("json_props", "select event_type, count(*) as n, sum((props->>'k')::bigint) as k_sum from events group by 1")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k_sum"))


@query("tumbling_windows", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as v from events group by 1, 2")
def tumbling_windows(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")


@query("excluded_labels", "select result_id from web_classifier_results where predicted_label_name is null or predicted_label_name not in ('ai')")
def excluded_labels(spark, d):
    return P.without_labels(results(spark, d), "predicted_label_name", ["ai"]).select("result_id")


@query("balanced_rows", _R + "select result_id from r where gt is not null")
def balanced_rows(spark, d):
    return P.labelled(results(spark, d), "gt", True).select("result_id")


@query("success_rates", "select snapshot_year, count(*) as total, count(*) filter (length(snapshot_ts) = 14) as succeeded, count(*) - count(*) filter (length(snapshot_ts) = 14) as failed, 100.0::double * count(*) filter (length(snapshot_ts) = 14) / count(*) as success_percent from snapshots group by 1")
def success_rates(spark, d):
    return S.success_rate(table(spark, d, "snapshots"), ["snapshot_year"], F.length("snapshot_ts") == 14)


@query("label_names", "select predicted_label, predicted_label_name from (select predicted_label, predicted_label_name, count(*) as c from web_classifier_results where predicted_label is not null and predicted_label_name is not null group by 1, 2) qualify row_number() over (partition by predicted_label order by c desc, predicted_label_name) = 1")
def label_names(spark, d):
    return S.label_names(results(spark, d), "predicted_label", "predicted_label_name")


@query("long_scores", """select 'results' as origin, 'score' as measure, score as value from web_classifier_results where score is not null union all select 'results', 'threshold', threshold from web_classifier_results where threshold is not null
union all select 'models', 'score', accuracy from genai_b120_thresholds_by_model where accuracy is not null union all select 'models', 'threshold', threshold from genai_b120_thresholds_by_model where threshold is not null""")
def long_scores(spark, d):
    models = table(spark, d, "genai_b120_thresholds_by_model").select(F.col("accuracy").alias("score"), "threshold")
    return S.long_scores({"results": results(spark, d).select("score", "threshold"), "models": models}, ["score", "threshold"])


@query("precision_recall_series", _R + """, t as (select i, i / 99.0::double as threshold from range(100) t(i)),
g as (select distinct source from v where gt is not null),
c as (select g.source, t.i, count(*) filter (gt = 1 and floor(score * 99 + 1e-9) >= t.i) as tp, count(*) filter (gt = 0 and floor(score * 99 + 1e-9) >= t.i) as fp, count(*) filter (gt = 1) as p from g, t, v where v.source is not distinct from g.source and gt is not null group by 1, 2)
select source, i / 99.0::double as threshold, coalesce(tp::double / nullif(tp + fp, 0), 1.0) as precision, tp::double / nullif(p, 0) as recall from c where source is not null""")
def precision_recall_series(spark, d):
    return S.precision_recall_series(valid(spark, d).filter("source is not null"), ["source"], F.col("score"), F.col("gt"))


@query("sorted_json", "select event_id, case when json_valid(props) then '{\"a\":[' || (props->>'k') || '],\"id\":' || event_id || '}' end as props from events")
def sorted_json(spark, d):
    text = F.concat(F.lit('{"id": '), "event_id", F.lit(', "a": [ '), F.get_json_object("props", "$.k"), F.lit(" ]}"))
    return table(spark, d, "events").select("event_id", R.sorted_json(text).alias("props"))
