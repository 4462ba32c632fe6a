"""Problem 2: contributors of too many records held to a share or a count, keeping the better records more often.

Quality-weighted reservoir sampling without replacement: each record draws u and has the exponential key -ln(u) / weight
(the order of u ** (1 / weight)), the weight being its quality; the cap-size best keys of a contributor stay
(bounded_rank: no contributor's records are brought together).

A contributor is the site of website_url, as settled by the table of sites. Records of unknown sites belong to their
organization_name: the one site that the table has for it, else the name itself, in the sector of its sites or, without
any, of most of its records. The cap of a sector is the greatest c for which min(n, c) records per contributor leave none
more than the sector's share of what is left; it is solved from the histogram of the contributors' sizes, which has few
rows however many contributors there are. Where a sector has too few contributors for that (share times contributors
below one) the share is taken of all its records instead, and the report says so.

Defined results: records whose site and organisation are unknown belong to no contributor and stay; so do those of
sectors without a share; widths and heights that are null, zero or negative count as the least quality; equal keys are
settled by the smaller row_id; repeated rows are separate records; an empty table gives an empty result; of further
columns none is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumigraph.llm.bounded_rank import bounded, exponential, keep_least, uniform
from lumigraph.session import persist_shared, table

SEED = "caps"
#: Pixels from which an image has full quality, and the least weight of a record.
FULL_QUALITY_PIXELS, LEAST_WEIGHT = 1920 * 1080, 0.05
#: Records a contributor may have where the cap is a count.
MOST = 500


def site_key(c: Column) -> Column:
    """The address of a site without scheme, www, query, fragment, closing slashes and letter case."""
    u = F.lower(F.regexp_replace(c, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", ""))
    return F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"^[a-z]+:/+", ""), r"^www\.", ""), r"(?:[?#].*)?$|/+(?:[?#].*)?$", ""), F.lit(""))


def quality(width: Column, height: Column, alt: Column, title: Column) -> Column:
    """Between LEAST_WEIGHT and 1: detected size, and a tenth each for an alternative text and a title."""
    w, h = F.greatest(F.coalesce(width, F.lit(0)), F.lit(0)).cast("double"), F.greatest(F.coalesce(height, F.lit(0)), F.lit(0)).cast("double")
    told = lambda c: F.when(F.length(F.trim(c)) > 0, 0.1).otherwise(0.0)
    return F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(1.0), w * h / FULL_QUALITY_PIXELS) * 0.8 + told(alt) + told(title))


def organisation_key(c: Column) -> Column:
    """A name without letter case and runs of white space; null where blank."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), r"[\s\x{00A0}]+", " ")), F.lit(""))


def contributions(images: DataFrame, sites: DataFrame, seed: str = SEED) -> DataFrame:
    """(row_id, sector, site, key) of every record; site is the contributor and sector the one settled for it (null: unknown)."""
    settled = sites.select(site_key(F.col("url")).alias("s"), organisation_key(F.col("organization_name")).alias("org"), F.col("sector").alias("of_site"))
    known = settled.filter("s is not null").groupBy("s").agg(F.min("of_site").alias("of_site"), F.lit(True).alias("known"))
    weight = quality(F.col("detected_width"), F.col("detected_height"), F.col("img_alt_text"), F.col("img_title"))
    rows = images.select(
        "row_id", site_key(F.col("website_url")).alias("s"), exponential(uniform(seed, F.col("row_id")), weight).alias("key"), organisation_key(F.col("organization_name")).alias("org"), F.col("sector").alias("own")
    )
    rows = rows.join(bounded(known), "s", "left")
    unknown = rows.filter("known is null and org is not null")
    of_sites = settled.filter("org is not null and s is not null").groupBy("org").agg(F.min("s").alias("only"), F.countDistinct("s").alias("n_sites"), F.mode("of_site", True).alias("of_sites"))
    of_records = unknown.groupBy("org", "own").count().groupBy("org").agg(F.min_by("own", F.struct(F.col("own").isNull(), -F.col("count"), "own")).alias("of_records"))
    names = persist_shared(of_records.join(of_sites, "org", "left").select(
        "org", F.coalesce("of_sites", "of_records").alias("to_sector"), F.when(F.col("n_sites") == 1, F.col("only")).otherwise(F.concat(F.lit("organisation: "), "org")).alias("to_site")
    ), "organisations")
    name = F.when(F.col("known").isNull(), F.col("org"))
    rows = rows.withColumn("org", name).join(bounded(names), "org", "left")
    return rows.select("row_id", F.when(F.col("known"), F.col("of_site")).otherwise(F.col("to_sector")).alias("sector"), F.when(F.col("known"), F.col("s")).otherwise(F.col("to_site")).alias("site"), "key")


def caps(counts: DataFrame, shares: DataFrame) -> DataFrame:
    """(sector, cap, met) from the records per contributor (sector, site, n) and the greatest shares (sector, share); null cap: none is needed.

    Contributors of one size are one row of a histogram: a sector of N records has at most sqrt(2 N) different sizes.
    """
    up, whole = Window.partitionBy("sector").orderBy("n"), Window.partitionBy("sector")
    s = (
        counts.groupBy("sector", "n").agg(F.count("*").alias("with_n")).join(bounded(shares), "sector")
        .withColumn("through", F.sum(F.col("n") * F.col("with_n")).over(up)).withColumn("rank", F.sum("with_n").over(up)).withColumn("next", F.lead("n").over(up))
        .withColumn("m", F.sum("with_n").over(whole)).withColumn("total", F.sum(F.col("n") * F.col("with_n")).over(whole)).withColumn("greatest", F.max("n").over(whole))
    )
    # contributors up to this size stay whole, the m - rank greater ones are cut to c: c <= share * (through + (m - rank) * c)
    left = F.col("m") - F.col("rank")
    exact = F.try_divide(F.col("share") * F.col("through"), 1 - F.col("share") * left) + F.lit(1e-9)
    c = F.floor(exact)
    fits = (F.col("share") * left < 1) & (exact >= F.col("n")) & (F.col("next").isNull() | (exact < F.col("next") + 1))
    return s.groupBy("sector").agg(
        F.when(F.max("greatest") <= F.max(F.col("share") * F.col("total")), None)
        .when(F.max(F.col("share") * F.col("m")) < 1 - 1e-12, F.max(F.floor(F.col("share") * F.col("total"))))
        .otherwise(F.coalesce(F.max(F.when(fits, c)), F.lit(0))).cast("bigint").alias("cap"),
        ((F.max(F.col("share") * F.col("m")) >= 1 - 1e-12) | (F.max("greatest") <= F.max(F.col("share") * F.col("total")))).alias("met"),
    )


def count_caps(counts: DataFrame, most: int) -> DataFrame:
    """The same form of caps for one largest number of records per contributor."""
    return counts.select("sector").distinct().select("sector", F.lit(most).cast("bigint").alias("cap"), F.lit(True).alias("met"))


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = persist_shared(contributions(table(spark, sf_dir, "images_meta"), table(spark, sf_dir, "sites")), "contributions")
    shares = table(spark, sf_dir, "sector_targets").select("sector", F.col("site_max_share").alias("share")).filter("share is not null")
    counts = persist_shared(rows.groupBy("sector", "site").agg(F.count("*").alias("n")), "counts")
    return rows, counts, persist_shared(caps(counts.filter("site is not null"), shares), "caps")


def capped(rows: DataFrame, counts: DataFrame, sector_caps: DataFrame) -> DataFrame:
    """The records that stay, of rows (row_id, sector, site, key)."""
    over = counts.filter("site is not null").join(bounded(sector_caps), "sector").filter("cap is not null and n > cap").groupBy("site").agg(F.min("cap").alias("most"))
    limits = persist_shared(over, "limits")
    n = counts.agg(F.max("n")).first()[0] or 0
    marked = rows.join(bounded(limits.select("site", F.lit(True).alias("over"))), "site", "left")
    kept = keep_least(marked.filter("over").drop("over"), "site", "key", "row_id", limits, "most", n)
    return marked.filter("over is null").drop("over").unionByName(kept)


def p2_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capped(*_planned(spark, sf_dir)).select("row_id", "sector", "site")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contributor with its records, the cap of its sector and the number kept."""
    _, counts, sector_caps = _planned(spark, sf_dir)
    return counts.filter("site is not null").join(bounded(sector_caps), "sector", "left").select(
        "sector", "site", F.col("n").alias("n_records"), "cap", "met", F.least("n", F.coalesce("cap", "n")).alias("n_kept")
    )


def p2_capped_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records when no contributor may have more than MOST of them."""
    rows, counts, _ = _planned(spark, sf_dir)
    return capped(rows, counts, count_caps(counts.filter("site is not null"), MOST)).select("row_id", "sector", "site")


_SQL = r"""
with all_sites as (select regexp_replace(regexp_replace(lower(url), '^[a-z]+:/+(www\.)?', ''), '/+$', '') as site, sector, nullif(trim(regexp_replace(lower(organization_name), '[\s\x{00A0}]+', ' ', 'g')), '') as org from sites),
known as (select site, min(sector) as sector from all_sites group by 1),
rows as (select row_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(website_url, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')), '^[a-z]+:/+', ''), '^www\.', ''), '[?#].*$', ''), '/+$', ''), '') as k,
  nullif(trim(regexp_replace(lower(organization_name), '[\s\x{00A0}]+', ' ', 'g')), '') as org, sector as own,
  power((('0x' || substr(md5('caps|' || row_id), 1, 8))::ubigint::double + 0.5) / 4294967296.0, 1 / greatest(0.05::double, least(1.0::double,
    greatest(coalesce(detected_width, 0), 0)::double * greatest(coalesce(detected_height, 0), 0)::double / 2073600) * 0.8::double
    + case when length(trim(img_alt_text)) > 0 then 0.1::double else 0::double end + case when length(trim(img_title)) > 0 then 0.1::double else 0::double end)) as key from images_meta),
joined as (select row_id, org, own, key, site, sector from rows left join known on k = site),
per_org as (select org, min(site) as only_, count(distinct site) as n_sites, min(sector) as lo, max(sector) as hi from all_sites where org is not null group by 1),
votes as (select org, own, count(*) as c from joined where site is null and org is not null group by 1, 2),
voted as (select org, own from votes qualify row_number() over (partition by org order by own is null, c desc, own) = 1),
modes as (select org, sector from (select org, sector, count(*) as c from all_sites where org is not null group by 1, 2) where sector is not null qualify row_number() over (partition by org order by c desc, sector) = 1),
names as (select v.org, coalesce(modes.sector, v.own) as to_sector, case when n_sites = 1 then only_ else 'organisation: ' || v.org end as to_site from voted v left join per_org on v.org = per_org.org left join modes on v.org = modes.org),
r as (select row_id, key, case when j.site is not null then j.sector else to_sector end as sector, coalesce(j.site, to_site) as site from joined j left join names on j.org = names.org and j.site is null),
counts as (select sector, site, count(*)::bigint as n from r where site is not null group by 1, 2),
s as (select c.sector, site, n, site_max_share as share, sum(n) over up as through, row_number() over up as rank, lead(n) over up as nxt, count(*) over (partition by c.sector) as m,
  sum(n) over (partition by c.sector) as total, max(n) over (partition by c.sector) as greatest_n from counts c join sector_targets t on c.sector = t.sector window up as (partition by c.sector order by n, site)),
caps as (select sector, case when max(greatest_n) <= max(share * total) then null when max(share * m) < 1 - 1e-12 then max(floor(share * total))
  else coalesce(max(case when share * (m - rank) < 1 and share * through / (1 - share * (m - rank)) + 1e-9 >= n and (nxt is null or share * through / (1 - share * (m - rank)) + 1e-9 < nxt + 1) then floor(share * through / (1 - share * (m - rank)) + 1e-9) end), 0) end::bigint as cap,
  (max(share * m) >= 1 - 1e-12 or max(greatest_n) <= max(share * total)) as met from s group by sector)
"""
QUERIES = {"p2_capped": p2_capped, "p2_capped_count": p2_capped_count, "p2_report": p2_report}
SQL = {
    "p2_capped": _SQL
    + "select row_id, sector, site from (select r.*, cap, row_number() over (partition by r.site order by key desc, row_id) as rn from r left join caps on r.sector = caps.sector) where site is null or cap is null or rn <= cap",
    "p2_capped_count": _SQL + "select row_id, sector, site from (select r.*, row_number() over (partition by site order by key desc, row_id) as rn from r) where site is null or rn <= 500",
    "p2_report": _SQL + "select counts.sector, site, n as n_records, cap, met, least(n, coalesce(cap, n)) as n_kept from counts left join caps using (sector)",
}
