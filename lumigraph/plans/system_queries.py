"""Queries that run HTML extraction, scoring, file round trips and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumigraph.functions import html, scoring
from lumigraph.operators import crawl
from lumigraph.plans.registry import query
from lumigraph.session import shared_dir, table
from lumigraph.sources import blobs, cdx, files, sinks
from lumigraph.streaming import running


def pages(spark, d):
    """A page per image record: a figure with the image in one of three forms, links up, down, out and unquoted.

    Signs with a meaning in HTML are written as character references, so every record has its page.
    """
    def written(c):
        for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(sign), F.lit(reference))
        return F.coalesce(c, F.lit(""))

    name = written(F.col("stored_filename"))
    body = F.concat(
        F.lit("<html><head><title>"), name, F.lit('</title></head><body><figure><img src="'), written(F.col("image_url")), F.lit('" width="'), F.coalesce("detected_width", F.lit(0)),
        F.lit('"><figcaption>'), name, F.lit('</figcaption></figure><a href="/news/'), "row_id", F.lit('?x=1#y">n</a> <a class="b" href="mailto:x@h.example">m</a> <a href=/x/../up/'), "row_id",
        F.lit('>u</a> <A title="t" HREF=\'/q?a=1&amp;b=2\'>q</A></body></html>'),
    )
    return table(spark, d, "images_meta").select("row_id", F.col("page_url").alias("url"), body.alias("html"), "image_url", "stored_filename")


_SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_ADDRESS = f"regexp_replace(image_url, '^{_SPACE}|{_SPACE}$', '', 'g')"
_NAME = f"trim(regexp_replace(coalesce(stored_filename, ''), '{_SPACE}', ' ', 'g'))"
_SHOWN = f"coalesce({_ADDRESS}, '') <> '' and not regexp_matches({_ADDRESS}, '^(data|blob|javascript):')"
_ORIGIN = "regexp_extract(page_url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*', 0)"


@query("page_images", f"select 'img' as kind, 'figure' as parent_tag, count(*) as n, count(distinct {_NAME}) as n_contexts from images_meta where {_SHOWN}")
def page_images(spark, d):
    return html.page_images(pages(spark, d)).groupBy("kind", "parent_tag").agg(F.count("*").alias("n"), F.countDistinct("context").alias("n_contexts"))


@query("page_facts", f"select count(*) as n_pages, count(*) filter ({_SHOWN}) as n_images, 4 * count(*) as n_links, count(distinct {_NAME}) as n_titles from images_meta")
def page_facts(spark, d):
    return html.page_facts(pages(spark, d)).agg(F.count("*").alias("n_pages"), F.sum("n_images").alias("n_images"), F.sum("n_links").alias("n_links"), F.countDistinct("title").alias("n_titles"))


@query("page_links", f"select page_url as url, {_ORIGIN} || p as link, starts_with(p, '/news/') as is_priority from images_meta, (values ('/news/', true), ('/up/', true), ('/q', false)) t(q, with_id), lateral (select q || case when with_id then row_id::varchar else '' end as p) where regexp_matches(page_url, '^https?://')")
def page_links(spark, d):
    return crawl.page_links(pages(spark, d)).select("url", "link", "is_priority")


@query("frontier_queue", "select distinct page_url as url from images_meta where page_url is not null and page_url not in (select website_url from images_meta where website_url is not null)")
def frontier_queue(spark, d):
    visited = table(spark, d, "images_meta").filter("website_url is not null").select(F.col("website_url").alias("url"))
    return crawl.frontier_queue(pages(spark, d).filter("url is not null"), visited).select("url")


@query("pages_per_site", "select row_id from (select row_id, row_number() over (partition by website_url order by wayback_year desc nulls last, row_id) as rn from images_meta where website_url is not null) where rn <= 10")
def pages_per_site(spark, d):
    i = table(spark, d, "images_meta").filter("website_url is not null").select("row_id", "website_url", "wayback_year")
    return crawl.within_budget(i, "website_url", [F.desc_nulls_last("wayback_year"), "row_id"], 10).select("row_id")


@query("hash_scorer", "select url, round(s, 9) as score, case when s >= 0.6 then 1 else 0 end as predicted_label, case when s >= 0.6 then 'ai' else 'real' end as predicted_label_name from (select url, ('0x' || substr(md5(url), 1, 8))::ubigint::double / 4294967296.0 as s from sites)")
def hash_scorer(spark, d):
    return scoring.score(table(spark, d, "sites").select("url"), "url").select("url", F.round("score", 9).alias("score"), "predicted_label", "predicted_label_name")


@query("csv_round_trip", "select url, sector, subsector, organization_name from sites")
def csv_round_trip(spark, d):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(table(spark, d, "sites"), path, sep=",")
    return files.read_sites(spark, path)


@query("grouped_files", "select sector as file_group, count(*) as n from sites group by 1")
def grouped_files(spark, d):
    path = f"{shared_dir(spark)}/grouped-{uuid.uuid4().hex}"
    sinks.write_grouped(table(spark, d, "sites"), "sector", path)
    return spark.read.option("header", True).csv(path).groupBy(F.col("group").alias("file_group")).agg(F.count("*").alias("n"))


@query("blob_verify", "select url as key, case when length(url) % 3 = 0 then 'different' else 'same' end as status from sites where length(url) % 5 <> 0 union all select url, 'only_left' from sites where length(url) % 5 = 0")
def blob_verify(spark, d):
    s = table(spark, d, "sites").select(F.col("url").alias("key"), F.encode("organization_name", "UTF-8").alias("value"))
    other = s.filter(F.length("key") % 5 != 0).withColumn("value", F.when(F.length("key") % 3 == 0, F.encode(F.concat(F.decode("value", "UTF-8"), F.lit("!")), "UTF-8")).otherwise(F.col("value")))
    return blobs.verify(s, other)


@query("nearest_snapshot", """with w as (select distinct original from snapshots), s as (select original, snapshot_ts, abs(epoch(strptime(snapshot_ts, '%Y%m%d%H%M%S')) - epoch(timestamp '2020-06-15 12:00:00')) as d from snapshots where length(snapshot_ts) = 14)
select original, min_by(snapshot_ts, struct_pack(d := d, t := snapshot_ts)) as nearest_ts from s group by 1""")
def nearest_snapshot(spark, d):
    s = table(spark, d, "snapshots").filter("length(snapshot_ts) = 14").select("original", F.col("snapshot_ts").alias("timestamp"))
    wanted = table(spark, d, "snapshots").select("original").distinct().withColumn("wanted_ts", F.lit("20200615120000"))
    return cdx.nearest(s, wanted).select("original", "nearest_ts")


@query("stream_windows", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2")
def stream_windows(spark, d):
    base, schema = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", table(spark, d, "events").schema
    table(spark, d, "events").repartition(2).write.parquet(f"{base}/in")
    stream = running.file_stream(spark, f"{base}/in", schema, 2).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    running.collect_updates(stream, f"{base}/out", f"{base}/state")
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("w", "event_type").agg(F.max_by("n", "batch").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("stream_running", "select event_type, count(*) as running_n, round(sum(value), 4) as running_sum from events group by 1")
def stream_running(spark, d):
    base, events = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", table(spark, d, "events")
    events.repartition(3).write.parquet(f"{base}/in")
    stream = running.running_counters(running.file_stream(spark, f"{base}/in", events.schema), "event_type", "value")
    running.collect_updates(stream, f"{base}/out", f"{base}/state")
    last = spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.max_by(F.struct("running_n", "running_sum"), "batch").alias("s"))
    return last.select("event_type", "s.running_n", F.round("s.running_sum", 4).alias("running_sum"))
