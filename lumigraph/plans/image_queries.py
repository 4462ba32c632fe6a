"""Queries over image records: URL and text functions, rules, joins with sites, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumigraph.functions import text as X
from lumigraph.functions import url as U
from lumigraph.operators import dedup as D
from lumigraph.operators import curves, joins, ordered
from lumigraph.operators import filters as P
from lumigraph.plans.registry import query
from lumigraph.session import table

_NETLOC = r"lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1))"
_PATH = r"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_SCHEME = r"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1))"


#: An address without white space around it and line ends inside, as the functions read it.
_SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_STRIPPED = f"regexp_replace(regexp_replace(image_url, '^{_SPACE}|{_SPACE}$', '', 'g'), '[\t\r\n]', '', 'g')"


def netloc(u: str) -> str:
    return _NETLOC.replace("{u}", u)


def path(u: str) -> str:
    return _PATH.replace("{u}", u)


def scheme(u: str) -> str:
    return _SCHEME.replace("{u}", u)


def any_of(c: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


def images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "images_meta")


@query("host_extract", f"select row_id, {netloc('image_url')} as host, replace({netloc('image_url')}, 'www.', '') as bare_host from images_meta where image_url is not null")
def host_extract(spark, d):
    u = F.col("image_url")
    return images(spark, d).filter("image_url is not null").select("row_id", U.netloc(u).alias("host"), U.strip_www_anywhere(U.netloc(u)).alias("bare_host"))


@query("domain_slug", f"select row_id, regexp_replace({netloc('website_url')}, '[.\\-]', '_', 'g') as slug from images_meta")
def domain_slug(spark, d):
    return images(spark, d).select("row_id", U.domain_slug(F.col("website_url")).alias("slug"))


_SECOND = "'" + "','".join(U.SECOND_LEVEL) + "'"


@query("registrable_domain", f"""
with h as (select distinct {netloc('image_url')} as host from images_meta where image_url is not null),
p as (select host, list_filter(string_split(regexp_replace(host, '^\\.+|\\.+$', '', 'g'), '.'), lambda x: x <> '') as parts from h)
select host, case when len(parts) = 0 then '' when len(parts) <= 2 then array_to_string(parts, '.')
  when length(parts[-1]) = 2 and parts[-2] in ({_SECOND}) then array_to_string(parts[-3:], '.') else array_to_string(parts[-2:], '.') end as domain from p""")
def registrable_domain(spark, d):
    return images(spark, d).filter("image_url is not null").select(U.netloc(F.col("image_url")).alias("host")).distinct().select("host", U.registrable_domain(F.col("host")).alias("domain"))


@query("page_canonical", r"""
select row_id, regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?', 0) || case when """ + path("page_url") + r""" in ('', '/') then '/' else regexp_replace(""" + path("page_url") + r""", '/+$', '') end as page from images_meta""")
def page_canonical(spark, d):
    return images(spark, d).select("row_id", U.canonical_page(F.col("page_url")).alias("page"))


@query("link_normalise", f"select row_id, regexp_replace(replace(trim({_STRIPPED}, ' '), ' ', '%20'), '#[^\n]*$', '') as link from images_meta")
def link_normalise(spark, d):
    """Of every record, those with line ends in or around their address too."""
    return images(spark, d).select("row_id", U.normalise_link(U.stripped(F.col("image_url"))).alias("link"))


_TRACK = "'" + "','".join(U.TRACKING_PARAMS) + "'"
_FULL = "case when contains(original_url, '://') then original_url else 'https://' || original_url end"


@query("query_param_strip", f"""
with f as (select row_id, {_FULL} as u from images_meta where original_url <> ''),
q as (select row_id, u, array_to_string(list_transform(list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' and lower(split_part(x, '=', 1)) not in ({_TRACK})),
  lambda x: case when contains(x, '=') then x else x || '=' end), '&') as qs from f)
select row_id, {scheme('u')} || '://' || {netloc('u')} || {path('u')} || case when qs = '' then '' else '?' || qs end as url from q""")
def query_param_strip(spark, d):
    return images(spark, d).filter("original_url <> ''").select("row_id", U.normalise_url(F.col("original_url")).alias("url"))


@query("wayback_unwrap", r"""
select row_id, case when regexp_extract(image_url, 'snapshots\.example/web/\d{14}[a-z_]*/(https?://[\s\S]*)$', 1) <> '' then regexp_extract(image_url, 'snapshots\.example/web/\d{14}[a-z_]*/(https?://[\s\S]*)$', 1) else image_url end as original,
  nullif(regexp_extract(image_url, '/web/(\d{14})', 1), '') as ts from images_meta where image_url is not null""")
def wayback_unwrap(spark, d):
    u = F.col("image_url")
    return images(spark, d).filter("image_url is not null").select("row_id", U.wayback_original(u, r"snapshots\.example").alias("original"), U.wayback_timestamp(u).alias("ts"))


@query("wayback_build", "select snapshot_id, 'https://web.archive.org/web/' || snapshot_ts || 'id_/' || original as url from snapshots")
def wayback_build(spark, d):
    return table(spark, d, "snapshots").select("snapshot_id", U.wayback_build(F.col("snapshot_ts"), F.col("original")).alias("url"))


@query("link_resolve", "select row_id, case when sector is null then website_url else regexp_extract(website_url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*', 0) || '/' || sector || '/' || stored_filename end as url from images_meta where website_url like 'http%'")
def link_resolve(spark, d):
    return images(spark, d).filter("website_url like 'http%'").select("row_id", U.resolve(F.col("website_url"), F.concat(F.lit("/"), "sector", F.lit("/"), "stored_filename")).alias("url"))


_LP = f"lower(case when {path('page_url')} = '' then '/' else {path('page_url')} end)"


@query("link_priority", f"""
with x as (select row_id, page_url, {_LP} as p from images_meta where page_url is not null),
y as (select *, len(list_filter(string_split(p, '/'), lambda s: s <> '')) as depth from x)
select row_id, greatest(0, 40 + case when {any_of('p', U.LOW_PRIORITY)} then 20 else 0 end - case when {any_of('p', U.HIGH_PRIORITY)} then 15 else 0 end
  + case when depth >= 3 then -10 when depth = 2 then -5 when depth = 0 then 15 else 0 end - case when regexp_extract(page_url, '^[^?#]*\\?([^#]*)', 1) <> '' then 5 else 0 end) as priority from y""")
def link_priority(spark, d):
    return images(spark, d).filter("page_url is not null").select("row_id", U.link_priority(F.col("page_url")).alias("priority"))


def _srcset(spark, d):
    """A srcset of three sources for every record; signs that separate sources are escaped in its address."""
    w = F.greatest(F.coalesce("detected_width", F.lit(1)), F.lit(1))
    u = F.replace(F.regexp_replace(F.coalesce("image_url", F.lit("none")), r"[ \t\n\f\r]", ""), F.lit(","), F.lit("%2C"))
    return images(spark, d).select("row_id", F.concat(u, F.lit(" "), w, F.lit("w, "), u, F.lit("?2 "), w + 300, F.lit("w,"), u, F.lit("?3 2x")).alias("srcset"))


_SRCSET_FROM = "from (select row_id, replace(regexp_replace(coalesce(image_url, 'none'), '[ \\t\\n\\f\\r]', '', 'g'), ',', '%2C') as image_url, greatest(coalesce(detected_width, 1), 1) as detected_width from images_meta)"


@query("srcset_best_a", f"select row_id, case when detected_width > 2000 then image_url else image_url || '?2' end as best {_SRCSET_FROM}")
def srcset_best_a(spark, d):
    return _srcset(spark, d).select("row_id", U.srcset_best(F.col("srcset"), "a").alias("best"))


@query("srcset_best_b", f"select row_id, case when detected_width + 300 > 2000 then image_url || '?2' else image_url || '?3' end as best {_SRCSET_FROM}")
def srcset_best_b(spark, d):
    return _srcset(spark, d).select("row_id", U.srcset_best(F.col("srcset"), "b").alias("best"))


@query("srcset_best_c", f"select row_id, case when detected_width + 300 >= 1000 then image_url || '?2' else image_url || '?3' end as best {_SRCSET_FROM}")
def srcset_best_c(spark, d):
    return _srcset(spark, d).select("row_id", U.srcset_best(F.col("srcset"), "c").alias("best"))


@query("srcset_first", f"select row_id, image_url as first_url {_SRCSET_FROM}")
def srcset_first(spark, d):
    return _srcset(spark, d).select("row_id", U.srcset_first(F.col("srcset")).alias("first_url"))


@query("css_urls", "select row_id, 2::bigint as n, translate(stored_path, '()''\"', '____') as first_url from images_meta where stored_path is not null and stored_filename is not null")
def css_urls(spark, d):
    """Two addresses in a style for every record; signs that end an address are replaced."""
    p, n = (F.translate(c, "()'\"", "____") for c in ("stored_path", "stored_filename"))
    css = F.concat(F.lit('a{background:url("'), p, F.lit('")} b{background:url('), n, F.lit(")}"))
    return images(spark, d).filter("stored_path is not null and stored_filename is not null").select("row_id", F.size(U.css_urls(css)).cast("bigint").alias("n"), U.css_urls(css)[0].alias("first_url"))


@query("file_parts", f"select row_id, regexp_extract({path('page_url')}, '[^/]*$', 0) as name, lower(regexp_extract(stored_filename, '[^.](\\.[^.]+)$', 1)) as ext from images_meta")
def file_parts(spark, d):
    return images(spark, d).select("row_id", U.basename(F.col("page_url")).alias("name"), U.extension(F.col("stored_filename")).alias("ext"))


_EXT = " ".join(f"when lower({path('image_url')}) like '%{e}' then '{e}'" for e in U.IMAGE_EXTENSIONS)


@query("guess_extension", f"select row_id, case {_EXT} when contains(lower(coalesce(content_type, '')), 'png') then '.png' when contains(lower(coalesce(content_type, '')), 'webp') then '.webp' when contains(lower(coalesce(content_type, '')), 'gif') then '.gif' else '.jpg' end as ext from images_meta where image_url is not null")
def guess_extension(spark, d):
    return images(spark, d).filter("image_url is not null").select("row_id", U.guess_extension(F.col("image_url"), F.col("content_type")).alias("ext"))


_SAFE = "'" + "','".join(U.SAFE_EXTENSIONS) + "'"


@query("safe_filename", f"""
with x as (select row_id, image_url as u, regexp_replace(regexp_extract({path('image_url')}, '[^/]*$', 0), '[^A-Za-z0-9_.\\-]', '_', 'g') as name from images_meta),
y as (select *, lower(regexp_extract(name, '[^.](\\.[^.]+)$', 1)) as ext, substr(md5(u), 1, 12) as digits from x)
select row_id, case when ext in ({_SAFE}) then substr(substr(name, 1, length(name) - length(ext)), 1, 80) || '_' || digits || ext else digits || '.jpg' end as file from y""")
def safe_filename(spark, d):
    return images(spark, d).select("row_id", U.safe_filename(F.col("image_url")).alias("file"))


@query("url_keys", "select row_id, sha1(concat_ws('|', page_url, image_url, row_id)) as stem, md5(image_url) as url_hash, sha1(split_part(split_part(trim(image_url, ' '), '?', 1), '#', 1)) as canonical_key, md5(image_url || coalesce(nullif(crawl_date, ''), 'unknown')) as image_id from images_meta where image_url is not null and trim(image_url, ' ') <> ''")
def url_keys(spark, d):
    u = F.col("image_url")
    return images(spark, d).filter("image_url is not null and trim(image_url) <> ''").select("row_id", U.safe_stem(F.col("page_url"), u, F.col("row_id")).alias("stem"), F.md5(u).alias("url_hash"), U.canonical_key(u).alias("canonical_key"), X.image_id(u, F.col("crawl_date")).alias("image_id"))


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(trim(coalesce({c}, ''), ' ')), '[^a-zA-Z0-9._\\-]+', '_', 'g'), '^[._\\-]+|[._\\-]+$', '', 'g'), ''), '{f}')"


@query("partition_path", "select row_id, " + _SLUG.format(c="sector", f="unknown_sector") + " || '/' || " + _SLUG.format(c=netloc("website_url").replace("{", "{{").replace("}", "}}"), f="unknown_site").replace("{{", "{").replace("}}", "}") + " || case when source = 'wayback' and wayback_year is not null then '/wayback/' || wayback_year else '/live' end as path from images_meta")
def partition_path(spark, d):
    return images(spark, d).select("row_id", U.partition_path(F.col("sector"), U.netloc(F.col("website_url")), F.col("source"), F.col("wayback_year")).alias("path"))


_NORM = "lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'), ' '))"


@query("norm_text", "with x as (select row_id, img_title, trim(regexp_replace(coalesce(img_title, ''), '\\s+', ' ', 'g'), ' ') as t from images_meta), y as (select *, case when length(t) > 400 then rtrim(substr(t, 1, 400), ' ') || '...' else t end as cut from x) select row_id, " + _NORM.format(c="img_title") + " as title, trim(regexp_replace(regexp_replace(lower(cut), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'), ' ') as meta from y")
def norm_text(spark, d):
    return images(spark, d).select("row_id", X.normal(F.col("img_title")).alias("title"), X.normal_meta(F.col("img_title")).alias("meta"))


@query("clean_text", "with x as (select doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ') as t from documents) select doc_id, case when length(t) > 300 then rtrim(substr(t, 1, 300), ' ') || '...' else t end as head from x")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean(F.col("text")).alias("head"))


@query("slugs", "select row_id, regexp_replace(regexp_replace(lower(trim(coalesce(organization_name, ''), ' ')), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') as org from images_meta")
def slugs(spark, d):
    return images(spark, d).select("row_id", X.slug_word(F.col("organization_name")).alias("org"))


_GENERIC = "'" + "','".join(X.GENERIC_ALT) + "'"


@query("meaningful_text", f"select row_id, (length({_NORM.format(c='img_alt_text')}) >= 8 and {_NORM.format(c='img_alt_text')} not in ({_GENERIC})) as alt_ok from images_meta")
def meaningful_text(spark, d):
    return images(spark, d).select("row_id", X.meaningful(F.col("img_alt_text")).alias("alt_ok"))


@query("ui_asset_filter", f"""
with x as (select row_id, lower(concat_ws(' ', image_url, coalesce(img_alt_text, ''), coalesce(img_title, ''))) as c, lower({path('image_url')}) as p from images_meta where image_url is not null)
select row_id from x where {any_of('c', P.UI_KEYWORDS)} or p like '%.svg' or {any_of('p', ['/icons/', '/sprites/', '/logos/'])}""")
def ui_asset_filter(spark, d):
    return images(spark, d).filter("image_url is not null").filter(P.is_ui_asset(F.col("image_url"), F.col("img_alt_text"), F.col("img_title"))).select("row_id")


@query("video_thumbnail_filter", f"""
with x as (select row_id, lower(concat_ws(' ', image_url, coalesce(img_alt_text, ''), coalesce(img_title, ''), coalesce(page_url, ''))) as c, lower({path('image_url')}) as p from images_meta where image_url is not null)
select row_id from x where {any_of('c', P.VIDEO_KEYWORDS)} or regexp_matches(p, '(^|[/_-])(hqdefault|maxresdefault|mqdefault|sddefault|poster|thumbnail|thumb)($|[._-])')""")
def video_thumbnail_filter(spark, d):
    i = images(spark, d).filter("image_url is not null")
    return i.filter(P.is_video_thumbnail(F.col("image_url"), F.col("img_alt_text"), F.col("img_title"), F.col("page_url"))).select("row_id")


@query("quality_filter", "select row_id from images_meta where content_type not like 'image/svg%' and detected_width >= 180 and detected_height >= 180 and detected_width * detected_height >= 50000 and detected_width::double / greatest(detected_height, 1) between 0.33 and 3.0")
def quality_filter(spark, d):
    return images(spark, d).filter(P.passes_quality(F.col("detected_width"), F.col("detected_height"), F.col("content_type"), F.lit(4000))).select("row_id")


@query("quality_reasons", """
with x as (select row_id, detected_width as w, detected_height as h, detected_width::double * detected_height / 1e6 as mp from images_meta where detected_width is not null and detected_height is not null)
select row_id, array_to_string(list_filter([case when w < 256 or h < 256 then 'too_small' end, case when w > 8192 or h > 8192 then 'too_large' end, case when mp < 0.065 then 'insufficient_megapixels' end, case when mp > 50 then 'excessive_megapixels' end], lambda r: r is not null), '|') as reasons from x""")
def quality_reasons(spark, d):
    i = images(spark, d).filter("detected_width is not null and detected_height is not null")
    return i.select("row_id", F.array_join(P.quality_reasons(F.col("detected_width"), F.col("detected_height")), "|").alias("reasons"))


@query("size_filter", "select row_id from images_meta where detected_width between 100 and 8000 and detected_height between 100 and 8000 and detected_width * detected_height >= 10000 and lower(coalesce(content_type, '')) like 'image/%'")
def size_filter(spark, d):
    w, h = F.col("detected_width"), F.col("detected_height")
    return images(spark, d).filter(P.passes_size(w, h) & P.valid_download(F.col("content_type"), F.lit(None).cast("bigint"))).select("row_id")


_BANNERS = "(" + ",".join(f"({a},{b})" for a, b in P.BANNERS) + ")"
_BANNERS2 = "(" + ",".join(f"({a},{b})" for a, b in P.BANNERS_SCORED) + ")"
_ADTEXT = "lower(concat_ws(' ', coalesce(img_alt_text, ''), coalesce(img_title, '')))"


@query("ad_filter", f"select row_id from images_meta where {any_of(_ADTEXT, P.AD_KEYWORDS)} or coalesce((detected_width, detected_height) in {_BANNERS}, false)")
def ad_filter(spark, d):
    return images(spark, d).filter(P.is_ad([F.col("img_alt_text"), F.col("img_title")], F.col("detected_width"), F.col("detected_height"))).select("row_id")


_ADSCORE = f"""
with x as (select row_id, coalesce(image_url, '') as u, lower(concat_ws(' ', coalesce(image_url, ''), coalesce(img_alt_text, ''), coalesce(img_title, ''))) as c, detected_width as w, detected_height as h from images_meta),
y as (select *, coalesce(w <> 0 and h <> 0, false) as known, w::double / greatest(h, 1) as ratio, {netloc('u')} as host from x),
z as (select row_id, [case when {any_of('c', P.AD_TEXT_KEYWORDS)} then 'ad_keyword_match' end, case when {any_of('host', P.AD_HOSTS)} then 'ad_host_match' end, case when known and (w, h) in {_BANNERS2} then 'common_banner_size' end,
  case when known and (ratio >= 4.0 or ratio <= 0.25) then 'extreme_aspect_ratio' end, case when known and w <= 180 and h <= 120 then 'tiny_image' end, case when regexp_matches(lower(u), '[?&](utm_|gclid|fbclid|adid|campaign)=') then 'tracking_query_param' end] as r from y),
s as (select row_id, array_to_string(list_filter(r, lambda a: a is not null), '|') as reasons, list_sum(list_transform(r, lambda a: case a when 'ad_keyword_match' then 2 when 'ad_host_match' then 3 when 'common_banner_size' then 3 when null then 0 else case when a is null then 0 else 1 end end))::int as score from z)
"""


def _ad_scored(spark, d):
    i = images(spark, d)
    return i.select("row_id", P.ad_score(F.col("image_url"), [F.col("img_alt_text"), F.col("img_title")], F.col("detected_width"), F.col("detected_height")).alias("s")).select("row_id", "s.score", "s.reasons")


@query("ad_score", _ADSCORE + "select row_id, score, reasons, score >= 3 as is_ad from s")
def ad_score(spark, d):
    return _ad_scored(spark, d).withColumn("is_ad", F.col("score") >= 3)


@query("ad_blend", _ADSCORE + "select row_id, round(case when contains(reasons, 'ad_host_match') or contains(reasons, 'common_banner_size') then greatest(0.6::double * least(1.0::double, score / 6.0::double) + 0.4::double * ((row_id % 100) / 100.0::double), 0.85::double) else 0.6::double * least(1.0::double, score / 6.0::double) + 0.4::double * ((row_id % 100) / 100.0::double) end, 9) as confidence from s")
def ad_blend(spark, d):
    return _ad_scored(spark, d).select("row_id", F.round(P.ad_confidence(F.col("score"), F.col("reasons"), (F.col("row_id") % 100) / 100.0), 9).alias("confidence"))


@query("icon_heuristic", f"""
with x as (select row_id, lower(coalesce(image_url, '')) as u, lower(concat_ws(' ', coalesce(image_url, ''), coalesce(img_alt_text, ''))) as c, trim(concat_ws(' ', {_NORM.format(c='img_alt_text')}, {_NORM.format(c='img_title')}), ' ') as t from images_meta)
select row_id, {any_of('c', P.BLOCKED_KEYWORDS)} as blocked, (not (length(t) >= 20 and len(string_split_regex(t, '\\s+')) >= 3)) and (t in ({"'" + "','".join(P.ICON_TEXTS) + "'"}) or {any_of('u', P.ICON_KEYWORDS)}) as icon from x""")
def icon_heuristic(spark, d):
    return images(spark, d).select("row_id", P.is_blocked(F.col("image_url"), F.col("img_alt_text")).alias("blocked"), P.is_icon(F.col("image_url"), F.col("img_alt_text"), F.col("img_title")).alias("icon"))


_EXTOF = f"lower(regexp_extract(regexp_extract({path('image_url')}, '[^/]*$', 0), '[^.](\\.[^.]+)$', 1))"
_ALLOWED = "'" + "','".join(P.ALLOWED_EXTENSIONS) + "'"


@query("valid_image_urls", f"select row_id from images_meta where image_url is not null and {scheme('image_url')} in ('http', 'https', 'data') and {_EXTOF} <> '.svg' and ({_EXTOF} = '' or {_EXTOF} in ({_ALLOWED}))")
def valid_image_urls(spark, d):
    return images(spark, d).filter("image_url is not null").filter(P.valid_image_url(F.col("image_url"))).select("row_id")


@query("image_like_urls", f"select row_id from images_meta where image_url is not null and {scheme('image_url')} in ('http', 'https') and {path('image_url')} <> '' and lower({path('image_url')}) not like '%.svg' and not {any_of('lower(image_url)', P.BLOCKED_URL_KEYWORDS)} and (regexp_matches(lower({path('image_url')}), '\\.(jpg|jpeg|png|webp|bmp|tiff|tif|gif)\\z') or {any_of(netloc('image_url'), P.IMAGE_HOSTS)})")
def image_like_urls(spark, d):
    return images(spark, d).filter("image_url is not null").filter(P.looks_like_image(F.col("image_url"))).select("row_id")


@query("site_rules", "select row_id from images_meta where (sector <> 'museum' or contains(lower(image_url), 'renditions') or contains(lower(image_url), '/media/') ) and not (sector = 'press' and contains(lower(image_url), 'thumb')) and image_url is not null and sector is not null")
def site_rules(spark, d):
    rules = spark.createDataFrame([("museum", ["renditions", "/media/"], []), ("press", [], ["thumb"])], "sector string, allow array<string>, deny array<string>")
    return P.url_rules(images(spark, d).filter("image_url is not null and sector is not null"), rules, "sector", "image_url").select("row_id")


@query("site_dimensions", "select row_id from images_meta where case when sector in ('flickr', 'flickr_commons') then least(detected_width, detected_height) >= 180 and detected_width * detected_height >= 70000 else detected_width >= 900 and detected_height >= 600 end")
def site_dimensions(spark, d):
    return images(spark, d).filter(P.meets_site_dimensions(F.coalesce("sector", F.lit("")), F.col("detected_width"), F.col("detected_height"))).select("row_id")


@query("same_site_pages", f"select row_id, regexp_replace({netloc('page_url')}, '^www\\.', '') = regexp_replace({netloc('website_url')}, '^www\\.', '') as same from images_meta where page_url is not null and website_url is not null")
def same_site_pages(spark, d):
    return images(spark, d).filter("page_url is not null and website_url is not null").select("row_id", U.same_site(U.netloc(F.col("page_url")), U.netloc(F.col("website_url"))).alias("same"))


@query("news_rows", "select row_id from images_meta where contains(lower(concat_ws(' ', coalesce(sector, ''), coalesce(subsector, ''), coalesce(organization_name, ''))), 'news')")
def news_rows(spark, d):
    return images(spark, d).filter(P.is_news(F.col("sector"), F.col("subsector"), F.col("organization_name"))).select("row_id")


@query("excluded_organizations", "select url from sites where not (contains(lower(organization_name), 'museum') or contains(lower(organization_name), 'courier'))")
def excluded_organizations(spark, d):
    return table(spark, d, "sites").filter(~P.excluded_by_name(F.col("organization_name"), ["Museum", "Courier"])).select("url")


@query("size_buckets", "select row_id, case when a < 10000 then 'tiny' when a < 50000 then 'small' when a < 200000 then 'medium' else 'large' end as bucket, printf('%.1fM', floor(a::double / 1000000)) as mp from (select row_id, detected_width * detected_height as a from images_meta where detected_width > 0 and detected_height > 0)")
def size_buckets(spark, d):
    i = images(spark, d).filter("detected_width > 0 and detected_height > 0")
    return i.select("row_id", X.size_bucket(F.col("detected_width") * F.col("detected_height")).alias("bucket"), X.megapixel_bucket(F.col("detected_width"), F.col("detected_height")).alias("mp"))


@query("upscale_tier", "with x as (select row_id, case when least(detected_width, detected_height) > 0 then 224::double / least(detected_width, detected_height) else 1.0 end as r from images_meta where detected_width is not null and detected_height is not null) select row_id, r as ratio, case when r <= 1.5 then 'LANCZOS' when r <= 3.0 then 'BICUBIC' else 'BILINEAR' end as method, r > 2.0 as concern from x")
def upscale_tier(spark, d):
    i = images(spark, d).filter("detected_width is not null and detected_height is not null")
    return i.select("row_id", X.upscale(F.col("detected_width"), F.col("detected_height")).alias("u")).select("row_id", "u.ratio", "u.method", "u.concern")


@query("upscale_impact", """
with x as (select lower(trim(sector)) as sector, case when least(detected_width, detected_height) > 0 then 224::double / least(detected_width, detected_height) else 1.0 end as r from images_meta where detected_width is not null and detected_height is not null and sector is not null)
select sector, case when r <= 1 then 'none' when r <= 2 then 'moderate' else 'strong' end as impact, count(*) as n, avg(r) as avg_ratio from x group by 1, 2""")
def upscale_impact(spark, d):
    i = images(spark, d).filter("detected_width is not null and detected_height is not null and sector is not null")
    r = X.upscale(F.col("detected_width"), F.col("detected_height"))["ratio"]
    impact = F.when(F.col("r") <= 1, "none").when(F.col("r") <= 2, "moderate").otherwise("strong")
    return i.select(F.lower(F.trim("sector")).alias("sector"), r.alias("r")).groupBy("sector", impact.alias("impact")).agg(F.count("*").alias("n"), F.avg("r").alias("avg_ratio"))


@query("aspect_classes", """
with x as (select detected_width::double / detected_height as r from images_meta where detected_width > 0 and detected_height > 0)
select case when r > 1.95 then 'panorama' when r > 1.55 then '16:9' when r > 1.2 then '4:3' when r >= 0.9 then 'square' when r > 0.6 then 'portrait' else 'tall' end as aspect, count(*) as n from x group by 1""")
def aspect_classes(spark, d):
    r = F.col("detected_width").cast("double") / F.col("detected_height")
    k = F.when(r > 1.95, "panorama").when(r > 1.55, "16:9").when(r > 1.2, "4:3").when(r >= 0.9, "square").when(r > 0.6, "portrait").otherwise("tall")
    return images(spark, d).filter("detected_width > 0 and detected_height > 0").groupBy(k.alias("aspect")).agg(F.count("*").alias("n"))


@query("text_accessibility", """
select source, count(*) as n, 100.0::double * count(*) filter (coalesce(trim(img_alt_text, ' '), '') = '') / count(*) as pct_no_alt, 100.0::double * count(*) filter (length(trim(img_alt_text, ' ')) between 1 and 4) / count(*) as pct_short,
  100.0::double * count(*) filter (length(trim(img_alt_text, ' ')) >= 10) / count(*) as pct_good, 100.0::double * count(*) filter (coalesce(trim(img_title, ' '), '') = '') / count(*) as pct_no_title from images_meta group by 1""")
def text_accessibility(spark, d):
    n, t = F.length(F.coalesce(F.trim("img_alt_text"), F.lit(""))), F.length(F.coalesce(F.trim("img_title"), F.lit("")))
    pct = lambda c: F.lit(100.0) * F.count_if(c) / F.count("*")
    return images(spark, d).groupBy("source").agg(F.count("*").alias("n"), pct(n == 0).alias("pct_no_alt"), pct((n >= 1) & (n <= 4)).alias("pct_short"), pct(n >= 10).alias("pct_good"), pct(t == 0).alias("pct_no_title"))


@query("filter_funnel", f"""
with x as (select lower(concat_ws(' ', image_url, coalesce(img_alt_text, ''), coalesce(img_title, ''))) as c, lower({path('image_url')}) as p, detected_width as w, detected_height as h, {_NORM.format(c='img_alt_text')} as t from images_meta where image_url is not null)
select coalesce(case when {any_of('c', P.UI_KEYWORDS)} or p like '%.svg' or {any_of('p', ['/icons/', '/sprites/', '/logos/'])} then 'ui' when w is null or h is null or w < 180 or h < 180 then 'quality' when length(t) < 8 or t in ({_GENERIC}) then 'no_alt' end, 'kept') as reason, count(*) as n from x group by 1""")
def filter_funnel(spark, d):
    i = images(spark, d).filter("image_url is not null")
    w, h = F.col("detected_width"), F.col("detected_height")
    reason = P.first_reason(ui=P.is_ui_asset(F.col("image_url"), F.col("img_alt_text"), F.col("img_title")), quality=w.isNull() | h.isNull() | (w < 180) | (h < 180), no_alt=~X.meaningful(F.col("img_alt_text")))
    return i.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("description_of", f"select row_id, coalesce(nullif(trim(coalesce(img_alt_text, ''), ' '), ''), nullif(trim(coalesce(img_title, ''), ' '), ''), 'Image from ' || {netloc('website_url')}) as description from images_meta where website_url is not null")
def description_of(spark, d):
    return images(spark, d).filter("website_url is not null").select("row_id", X.described(F.col("img_alt_text"), F.col("img_title"), U.netloc(F.col("website_url"))).alias("description"))


# joins with the list of sites

@query("category_progress", "select s.sector, count(*) as n_sites, coalesce(any_value(c.n), 0) as n_images from sites s left join (select sector, count(*) as n from images_meta group by 1) c on s.sector = c.sector group by 1")
def category_progress(spark, d):
    got = images(spark, d).groupBy("sector").agg(F.count("*").alias("n_images"))
    return table(spark, d, "sites").groupBy("sector").agg(F.count("*").alias("n_sites")).join(got, "sector", "left").fillna(0, ["n_images"])


@query("kept_discarded", "with t as (select sector, count(*) as total, count(*) filter (detected_width >= 256 and detected_height >= 256) as kept from images_meta where sector is not null group by 1) select sector, total, kept, greatest(total - kept, 0) as discarded, round(100.0::double * kept / total, 2) as retained_pct from t")
def kept_discarded(spark, d):
    t = images(spark, d).filter("sector is not null").groupBy("sector").agg(F.count("*").alias("total"), F.count_if((F.col("detected_width") >= 256) & (F.col("detected_height") >= 256)).alias("kept"))
    return t.select("*", F.greatest(F.col("total") - F.col("kept"), F.lit(0)).alias("discarded"), F.round(F.lit(100.0) * F.col("kept") / F.col("total"), 2).alias("retained_pct"))


@query("attempted_vs_successful", "select s.sector, count(distinct s.organization_name) as attempted, count(distinct i.organization_name) as successful, count(distinct s.organization_name) - count(distinct i.organization_name) as failed from sites s left join (select distinct organization_name from images_meta where wayback_year is not null) i on s.organization_name = i.organization_name group by 1")
def attempted_vs_successful(spark, d):
    ok = images(spark, d).filter("wayback_year is not null").select("organization_name").distinct().withColumn("ok", F.col("organization_name"))
    j = table(spark, d, "sites").select("sector", "organization_name").distinct().join(ok, "organization_name", "left")
    return j.groupBy("sector").agg(F.countDistinct("organization_name").alias("attempted"), F.countDistinct("ok").alias("successful")).withColumn("failed", F.col("attempted") - F.col("successful"))


@query("org_year_counts", "select organization_name, wayback_year, count(*) as n from images_meta where organization_name is not null and wayback_year is not null group by 1, 2")
def org_year_counts(spark, d):
    return images(spark, d).filter("organization_name is not null and wayback_year is not null").groupBy("organization_name", "wayback_year").agg(F.count("*").alias("n"))


@query("crawl_summary", "select source, count(*) as n, avg(nullif(detected_width, 0)::double * nullif(detected_height, 0)) as avg_area, count(distinct content_type) as n_formats, count(distinct website_url) as n_sites, coalesce(min(nullif(crawl_date, '')), 'unknown') as first_day, coalesce(max(nullif(crawl_date, '')), 'unknown') as last_day from images_meta group by 1")
def crawl_summary(spark, d):
    nz = lambda c: F.nullif(F.col(c), F.lit(0)).cast("double")
    day = F.nullif(F.col("crawl_date"), F.lit(""))
    return images(spark, d).groupBy("source").agg(
        F.count("*").alias("n"), F.avg(nz("detected_width") * nz("detected_height")).alias("avg_area"), F.countDistinct("content_type").alias("n_formats"), F.countDistinct("website_url").alias("n_sites"),
        F.coalesce(F.min(day), F.lit("unknown")).alias("first_day"), F.coalesce(F.max(day), F.lit("unknown")).alias("last_day"),
    )


@query("blob_verify_full_outer", "select coalesce(a.image_url, b.image_url) as image_url, case when a.image_url is null then 'only_results' when b.image_url is null then 'only_images' else 'both' end as found from (select distinct image_url from images_meta where image_url is not null) a full join (select distinct image_url from web_classifier_results where image_url is not null) b on a.image_url = b.image_url")
def blob_verify_full_outer(spark, d):
    a = images(spark, d).select("image_url").filter("image_url is not null").distinct().withColumn("a", F.lit(1))
    b = table(spark, d, "web_classifier_results").select("image_url").filter("image_url is not null").distinct().withColumn("b", F.lit(1))
    return a.join(b, "image_url", "full").select("image_url", F.when(F.col("a").isNull(), "only_results").when(F.col("b").isNull(), "only_images").otherwise("both").alias("found"))


@query("nearest_snapshot_asof", """
with s as (select original, min(snapshot_ts) as first_ts from snapshots where length(snapshot_ts) = 14 group by 1),
t as (select distinct original, snapshot_ts from snapshots where length(snapshot_ts) = 14)
select s.original, max(t.snapshot_ts) as nearest from s join t on s.original = t.original and t.snapshot_ts <= '20220101000000' group by 1""")
def nearest_snapshot_asof(spark, d):
    t = table(spark, d, "snapshots").filter("length(snapshot_ts) = 14 and snapshot_ts <= '20220101000000'")
    return t.groupBy("original").agg(F.max("snapshot_ts").alias("nearest"))


# duplicates

@query("keep_first", "select file_hash, row_id, image_url from (select *, row_number() over (partition by file_hash order by row_id) as rn from images_meta where file_hash is not null) where rn = 1")
def keep_first(spark, d):
    return D.keep_first(images(spark, d).filter("file_hash is not null").select("file_hash", "row_id", "image_url"), ["file_hash"], "row_id").select("file_hash", "row_id", "image_url")


@query("seen_before_filter", "select row_id from images_meta i where wayback_year >= 2023 and not exists (select 1 from images_meta s where s.wayback_year < 2023 and s.file_hash = i.file_hash)")
def seen_before_filter(spark, d):
    i = images(spark, d)
    return P.not_done(i.filter("wayback_year >= 2023"), i.filter("wayback_year < 2023 and file_hash is not null"), ["file_hash"]).select("row_id")


_CANON = rf"""
with x as (select row_id, {_STRIPPED} as u, detected_width as w, detected_height as h from images_meta),
a as (select *, list_filter(string_split({path('u')}, '/'), lambda p: p <> '' and not regexp_full_match(p, 'image_\d+_\d+') and not starts_with(p, 'content_image_')) as ps from x),
b as (select *, [p for p, i in ps if i = 1 or p <> ps[i - 1]] as qs from a),
c as (select *, regexp_replace(qs[-1], '([^.])\.[^.]+$', '\1') as s0 from b),
e as (select *, case when contains(s0, '.r_d.') then split_part(s0, '.r_d.', 1) else s0 end as s1 from c),
k as (select row_id, w, h, case when {scheme('u')} in ('http', 'https') then {netloc('u')} || '|' || case when len(qs) = 0 then '' else array_to_string(list_append(qs[:-2], case when regexp_matches(s1, '(-\d+)(-\d+)+$') then regexp_replace(s1, '-\d+$', '') else s1 end), '/') end else '' end as k from e)
"""


@query("canonical_key", _CANON + "select row_id, k as image_key from k")
def canonical_key(spark, d):
    """Of every record; empty for those without an address or with one that is not http."""
    return images(spark, d).select("row_id", D.canonical_image_key(U.stripped(F.col("image_url"))).alias("image_key"))


@query("canonical_key_best", _CANON + "select k as image_key, row_id from (select *, row_number() over (partition by k order by coalesce(w * h, 0) desc, coalesce(w, 0) desc, coalesce(h, 0) desc, row_id) as rn from k where k <> '') where rn = 1 union all select k, row_id from k where k = ''")
def canonical_key_best(spark, d):
    """Records without a key (no address, or one that is not http) all stay."""
    w, h = F.col("detected_width"), F.col("detected_height")
    i = images(spark, d).select(D.canonical_image_key(U.stripped(F.col("image_url"))).alias("image_key"), "row_id", "detected_width", "detected_height")
    return D.best_of_group(i, "image_key", [w * h, w, h], "row_id").select("image_key", "row_id")


@query("exact_hash_dups", "select row_id, n as group_size from images_meta join (select file_hash, count(*) as n from images_meta group by 1 having count(*) > 1) using (file_hash)")
def exact_hash_dups(spark, d):
    i = images(spark, d)
    return i.join(D.group_sizes(i.filter("file_hash is not null"), "file_hash").filter("group_size > 1"), "file_hash").select("row_id", "group_size")


@query("url_size_canonical", "select regexp_replace(split_part(image_url, '?', 1), '/\\d+(x\\d+)?', '/SIZE', 'g') as key, count(*) as n, min(row_id) as first_row from images_meta where image_url is not null group by 1")
def url_size_canonical(spark, d):
    key = F.regexp_replace(F.substring_index("image_url", "?", 1), r"/\d+(x\d+)?", "/SIZE")
    return images(spark, d).filter("image_url is not null").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


@query("signature_dups")
def signature_dups(spark, d):
    i = images(spark, d)
    sig = D.metadata_signatures(F.col("website_url"), {"alt_text": F.col("img_alt_text"), "title_text": F.col("img_title")}, F.col("detected_width"), F.col("detected_height"))
    return D.signature_owners(i.select("row_id", sig.alias("signatures")), "row_id", "signatures")


@query("dup_reason_counts", "select 'file_hash' as reason, count(*) - count(distinct file_hash) as n from images_meta where file_hash is not null union all select 'image_url', count(*) - count(distinct image_url) from images_meta where image_url is not null")
def dup_reason_counts(spark, d):
    i = images(spark, d)
    one = lambda c: i.filter(F.col(c).isNotNull()).agg((F.count("*") - F.countDistinct(c)).alias("n")).select(F.lit(c).alias("reason"), "n")
    return one("file_hash").unionByName(one("image_url"))


_BITS = """
with h as (select vec_id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as b from embeddings),
p as (select x.vec_id as a, y.vec_id as b, list_sum(list_transform(list_zip(x.b, y.b), lambda z: abs(z[1] - z[2]))) as distance from h x join h y on x.vec_id < y.vec_id)
"""


@query("hamming_pairs", _BITS + "select a, b, distance::int as distance from p where distance <= 12")
def hamming_pairs(spark, d):
    return D.near_pairs(table(spark, d, "embeddings").select("vec_id", D.sign_hash(F.col("embedding")).alias("h")), "vec_id", "h", 12)


@query("greedy_dedup")
def greedy_dedup(spark, d):
    h = table(spark, d, "embeddings").select("vec_id", D.sign_hash(F.col("embedding")).alias("h"))
    return D.greedy_near_duplicates(h, "vec_id", "h", 16).select("vec_id", "kept", "matched", "matched_distance")


@query("file_duplicates", "select row_id, row_number() over (partition by lower(stored_filename), coalesce(detected_width, -1), coalesce(detected_height, -1) order by row_id) = 1 as kept from images_meta")
def file_duplicates(spark, d):
    return D.file_duplicates(images(spark, d), "stored_filename", "detected_width", "detected_height", "row_id").select("row_id", "kept")


@query("hex_similarity", "with f as (select min_by(file_hash, row_id) as b from images_meta where length(file_hash) = 64) select row_id, 1 - list_sum(list_transform(list_zip(string_split(file_hash, ''), string_split(b, '')), lambda z: case when z[1] <> z[2] then 1 else 0 end))::double / 256 as similarity from images_meta, f where length(file_hash) = 64")
def hex_similarity(spark, d):
    i = images(spark, d).filter("length(file_hash) = 64")
    first = i.agg(F.min_by("file_hash", "row_id").alias("b"))
    return i.crossJoin(F.broadcast(first)).select("row_id", D.hex_similarity(F.col("file_hash"), F.col("b")).alias("similarity"))  # one row on the right


@query("attach_files", """with f as (select stored_path as p from images_meta where row_id % 3 = 0), x as (select row_id, case when row_id % 2 = 0 then stored_path else 'moved/' || stored_filename end as q from images_meta)
select row_id, coalesce(case when q in (select p from f) then q end, (select min(p) from f where regexp_extract(p, '[^/]*$', 0) = regexp_extract(q, '[^/]*$', 0))) as found_path from x""")
def attach_files(spark, d):
    i = images(spark, d)
    files = i.filter("row_id % 3 = 0").select(F.col("stored_path").alias("path"))
    moved = F.when(F.col("row_id") % 2 == 0, F.col("stored_path")).otherwise(F.concat(F.lit("moved/"), "stored_filename"))
    return joins.attach_files(i.select("row_id", moved.alias("q")), files, "q").select("row_id", "found_path")


@query("image_references", "select row_id, coalesce(nullif(trim(img_title, ' '), ''), nullif(trim(original_url, ' '), ''), 'index:' || row_id) as ref from images_meta")
def image_references(spark, d):
    return images(spark, d).select("row_id", joins.image_reference([F.col("img_title"), F.col("original_url")], F.col("row_id")).alias("ref"))


@query("triplets")
def triplets(spark, d):
    return joins.triplets(table(spark, d, "embeddings"), "vec_id", "label")


@query("updated_column", "select s.url, coalesce(n.n, '') as n_images from sites s left join (select website_url, cast(count(*) as varchar) as n from images_meta group by 1) n on s.url = n.website_url")
def updated_column(spark, d):
    n = images(spark, d).groupBy(F.col("website_url").alias("url")).agg(F.count("*").cast("string").alias("n_images"))
    return joins.updated_column(table(spark, d, "sites").select("url"), n, "url", "n_images")


@query("summed_counts", "select sector, count(*) as n from images_meta group by 1")
def summed_counts(spark, d):
    i = images(spark, d)
    part = lambda c: i.filter(c).groupBy("sector").agg(F.count("*").alias("n"))
    return joins.summed([part("source = 'live'"), part("source <> 'live' or source is null")], ["sector"], "n")


@query("priority_order", f"""with x as (select row_id, website_url, regexp_matches(lower({path('page_url')}), 'news|blog|press|media|gallery|about|story|article|report|publication|insight') as pr from images_meta where website_url is not null and page_url is not null)
select row_id from (select row_id, row_number() over (partition by website_url order by pr desc, row_id) as rn from x) where rn <= 5""")
def priority_order(spark, d):
    i = images(spark, d).filter("website_url is not null and page_url is not null")
    rich = P.contains_any(F.lower(U.path(F.col("page_url"))), P.PRIORITY_PATHS)
    w = Window.partitionBy("website_url").orderBy(F.desc(rich), "row_id")
    return i.select("row_id", F.row_number().over(w).alias("rn")).filter("rn <= 5").select("row_id")


@query("smallest_per_bucket", "select row_id, aspect from (select row_id, aspect, row_number() over (partition by aspect order by r, row_id) as rn from (select row_id, detected_width::double / detected_height as r, case when detected_width > detected_height then 'wide' else 'tall' end as aspect from images_meta where detected_width > 0 and detected_height > 0)) where rn <= 3")
def smallest_per_bucket(spark, d):
    i = images(spark, d).filter("detected_width > 0 and detected_height > 0").select("row_id", (F.col("detected_width").cast("double") / F.col("detected_height")).alias("r"), F.when(F.col("detected_width") > F.col("detected_height"), "wide").otherwise("tall").alias("aspect"))
    return curves.quota(i.withColumn("o", F.struct("r", "row_id")), "aspect", {"wide": 3, "tall": 3}, "o").select("row_id", "aspect")


@query("enumerated_names", "select row_id, 'image_' || printf('%06d', row_number() over (partition by website_url order by row_id)) as name from images_meta where website_url is not null")
def enumerated_names(spark, d):
    i = ordered.ranked(images(spark, d).filter("website_url is not null").select("row_id", "website_url"), ["website_url"], [F.col("row_id")])
    return i.select("row_id", F.concat(F.lit("image_"), curves.padded(F.col("rank"), 6)).alias("name"))


@query("split_by_ads", f"select is_ad, sector, count(*) as n from (select sector, {any_of(_ADTEXT, P.AD_KEYWORDS)} or coalesce((detected_width, detected_height) in {_BANNERS}, false) as is_ad from images_meta) group by 1, 2")
def split_by_ads(spark, d):
    ad = P.is_ad([F.col("img_alt_text"), F.col("img_title")], F.col("detected_width"), F.col("detected_height"))
    return images(spark, d).groupBy(ad.alias("is_ad"), "sector").agg(F.count("*").alias("n"))


@query("page_probe", "select page_url, count(*) as n_images, count(distinct image_url) as n_unique from images_meta where page_url is not null group by 1")
def page_probe(spark, d):
    return images(spark, d).filter("page_url is not null").groupBy("page_url").agg(F.count("*").alias("n_images"), F.countDistinct("image_url").alias("n_unique"))


@query("analyst_filters", "select count(*) filter (detected_width * detected_height > 500000) as heavy, count(*) filter (detected_width > 1920) as wide, count(*) filter (lower(source) = 'picture') as in_picture, count(*) filter (lower(source) = 'lazy') as lazy, count(*) filter (detected_width < 200 or detected_height < 200) as tiny from images_meta")
def analyst_filters(spark, d):
    w, h = F.col("detected_width"), F.col("detected_height")
    return images(spark, d).agg(*[F.count_if(c).alias(n) for n, c in P.analyst_filters(w * h, w, h, F.col("source"), F.col("source")).items()])


@query("dup_audit_log", """select row_id as id, 'hash' as reason, f::varchar as matched from (select row_id, min(row_id) over (partition by file_hash) as f from images_meta where file_hash is not null) where f < row_id
union all select row_id, 'url', f::varchar from (select row_id, min(row_id) over (partition by image_url) as f from images_meta where image_url is not null) where f < row_id""")
def dup_audit_log(spark, d):
    i = images(spark, d).select("row_id", "file_hash", "image_url")
    for key, name in (("file_hash", "hash"), ("image_url", "url")):
        first = i.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("row_id").alias(f"first_{name}"), F.count("*").alias("n")).filter("n > 1").drop("n")
        i = i.join(first, key, "left")
    earlier = lambda c: F.when(F.col(c) < F.col("row_id"), F.col(c))
    return D.audit_log(i, "row_id", {"hash": earlier("first_hash"), "url": earlier("first_url")})


@query("image_inputs", """select row_id, case when regexp_matches(trim(image_url, ' '), '^(?i)https?://') then 'url' when length(trim(image_url, ' ')) > 0 then 'path' end as form, case when trim(image_url, ' ') <> '' then trim(image_url, ' ') end as ref from images_meta""")
def image_inputs(spark, d):
    from lumigraph.functions import references as R

    i = images(spark, d).select("row_id", "image_url")
    return i.select("row_id", R.image_input(F.col("image_url"), i.schema["image_url"].dataType).alias("x")).select("row_id", "x.form", "x.ref")


@query("slug_dialects", f"""select row_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(coalesce(sector, ''), ' ')), '[^a-zA-Z0-9_\\-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'uncategorized') as category,
replace({netloc('website_url')}, '.', '-') || '__' || coalesce(nullif(regexp_replace(regexp_replace(lower(trim(coalesce(organization_name, ''), ' ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'site') as site,
regexp_replace(replace(lower(organization_name), ' ', '_'), '[^\\p{{L}}\\p{{N}}_]', '', 'g') as folder, regexp_replace(stored_filename, '[^\\p{{L}}\\p{{N}}\\-_]', '_', 'g') as file from images_meta""")
def slug_dialects(spark, d):
    o = F.col("organization_name")
    return images(spark, d).select("row_id", X.slug_category(F.col("sector")).alias("category"), X.slug_site(U.netloc(F.col("website_url")), o).alias("site"), X.slug_folder(o).alias("folder"), X.slug_file(F.col("stored_filename")).alias("file"))


@query("context_group_keys", f"""with x as (select row_id, lower(trim({netloc('page_url')}, ' ')) || '|' || lower(trim(split_part(coalesce(page_url, ''), '#', 1), ' ')) || '|' as head, case when row_id % 3 = 0 then '' else coalesce(stored_filename, '') end as name,
{_NORM.format(c="case when coalesce(img_title, '') <> '' then img_title else img_alt_text end")} as told from images_meta),
y as (select *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(name, '([^.])\\.[^.]+$', '\\1')), '\\.r_d\\.\\d+-\\d+(-\\d+)?$', ''), '[_-]\\d{{2,5}}x\\d{{2,5}}$', ''), '[_-]\\d{{2,5}}[_-]\\d{{2,5}}$', '') as s from x),
z as (select *, regexp_replace(s, '^[._\\-]+|[._\\-]+$', '', 'g') as sig from y)
select row_id, case when sig <> '' then coalesce(head, '|' || '|') || 'asset:' || sig when told <> '' then coalesce(head, '||') || 'ctx:' || told end as key from z""")
def context_group_keys(spark, d):
    """Every third record without a name, so that its text decides."""
    name = F.when(F.col("row_id") % 3 == 0, "").otherwise(F.col("stored_filename"))
    return images(spark, d).select("row_id", X.context_group_key(U.netloc(F.col("page_url")), F.col("page_url"), name, F.col("img_title"), F.col("img_alt_text")).alias("key"))


@query("suffix_extension", f"select row_id, case when e in ({','.join(repr(x) for x in U.IMAGE_EXTENSIONS)}) then e else coalesce(case lower(trim(split_part(coalesce(content_type, ''), ';', 1), ' ')) {' '.join(f'when {k!r} then {v!r}' for k, v in U.TYPE_EXTENSIONS.items())} end, '.jpg') end as extension from (select row_id, content_type, lower(regexp_extract(regexp_extract({path('image_url')}, '[^/]*$', 0), '[^.](\\.[^.]+)$', 1)) as e from images_meta where image_url is not null)")
def suffix_extension(spark, d):
    return images(spark, d).filter("image_url is not null").select("row_id", U.suffix_extension(F.col("image_url"), F.col("content_type")).alias("extension"))
