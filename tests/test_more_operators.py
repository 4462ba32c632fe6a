"""Crawls with budgets, sitemaps, robots rules, hash sets, picture references, text context; against brute force."""

import itertools
import random
import urllib.robotparser

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigraph.functions import html, pixels, references
from lumigraph.functions import url as U
from lumigraph.operators import crawl, dedup, skew
from lumigraph.schemas import SNAPSHOTS
from lumigraph.sources import blobs, cdx, fetch, files, sinks


def test_greedy_with_many_equal_hashes(spark, monkeypatch):
    rng = random.Random(7)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = [(i, 0 if i % 3 == 0 else rng.choice(base) ^ (1 << rng.randrange(63) if rng.random() < 0.7 else 0)) for i in rng.sample(range(1000), 300)]
    kept, want = [], {}
    for i, h in sorted(rows):
        near = [((h ^ g).bit_count(), j) for j, g in kept if (h ^ g).bit_count() <= 3]
        if near:
            want[i] = min(near)[::-1]
        else:
            kept.append((i, h))
    df = spark.createDataFrame(rows, "id bigint, h bigint")
    got = dedup.greedy_near_duplicates(df, "id", "h", 3).collect()
    assert len(got) == len(rows) and {r["id"]: (r["matched"], r["matched_distance"]) for r in got if not r["kept"]} == want


def test_near_pairs_of_a_hot_band(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 1000)
    rng = random.Random(8)
    rows = [(i, rng.getrandbits(12)) for i in range(150)]  # all share the upper bands
    want = {(i, j, (g ^ h).bit_count()) for (i, g), (j, h) in itertools.combinations(rows, 2) if (g ^ h).bit_count() <= 2}
    assert {tuple(r) for r in dedup.near_pairs(spark.createDataFrame(rows, "id bigint, h bigint"), "id", "h", 2).collect()} == want


def test_hash_sets_match_crops(spark):
    rng = np.random.default_rng(3)
    smooth = lambda: pixels.resize(rng.normal(size=(9, 9)) * 80 + 120, 64, 64)
    pictures = [smooth() for _ in range(4)]
    pictures.append(pictures[0][:48, :48])  # a recrop of the first
    sets = [pixels.crop_hashes(p) for p in pictures]
    assert all(2 <= len(s) <= 29 for s in sets) and pixels.crop_hashes(np.zeros((4, 4))) and len(pixels.crop_hashes(np.full((64, 64), 7.0))) == 1
    df = spark.createDataFrame([(i, p.shape[1], p.shape[0], p.ravel().tolist()) for i, p in enumerate(pictures)], "image_id bigint, width int, height int, pixels array<double>")
    stored = pixels.crop_hash_sets(df)
    assert {r["image_id"]: [list(h) for h in r["hashes"]] for r in stored.collect()} == dict(enumerate(sets))
    gap = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b))
    want = {}
    for i, j in itertools.permutations(range(len(sets)), 2):
        d = min(gap(a, b) for a in sets[i] for b in sets[j])
        if d <= 8:
            want[i, j] = d
    assert (0, 4) in want
    assert {(r["a"], r["b"]): r["distance"] for r in dedup.hash_set_matches(stored, stored, "image_id", "hashes", 8).collect()} == want
    with pytest.raises(ValueError):
        dedup.hash_set_matches(stored, stored, "image_id", "hashes", 40)


def test_ten_crops():
    img = np.arange(30.0).reshape(5, 6)
    v = pixels.ten_crops(img, 3)
    assert v.shape == (10, 3, 3) and (v[0] == img[:3, :3]).all() and (v[3] == img[2:, 3:]).all() and (v[5] == img[:, ::-1][:3, :3]).all()
    assert pixels.ten_crops(np.ones((2, 2)), 4).sum() == 10 * 4 and pixels.joined_views(v, True).shape == (1, 3, 30) and pixels.joined_views(v).shape == (10, 3, 3)


ROBOTS = """# rules
User-agent: *
Disallow: /private
Allow: /private/open
Disallow: /*.pdf

User-agent: otherbot
User-agent: lumibot
Disallow: /news   # for us
Disallow:
"""


def test_robots(spark):
    robots = spark.createDataFrame([("h.example", ROBOTS), ("empty.example", "")], "site string, text string")
    urls = [f"https://h.example{p}" for p in ("/", "/private", "/private/open/x", "/a.pdf", "/news/1", "/privateer?x=1")] + ["https://none.example/private"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    allowed = lambda agent: {r["url"] for r in crawl.allowed_by_robots(df, crawl.robots_rules(robots, agent)).collect()}
    assert allowed("*") == {urls[0], urls[2], urls[4], urls[6]}
    assert allowed("Lumibot/1.0") == set(urls) - {urls[4]}
    p = urllib.robotparser.RobotFileParser()
    p.parse("User-agent: *\nDisallow: /private\n".splitlines())
    simple = crawl.robots_rules(spark.createDataFrame([("h.example", "User-agent: *\nDisallow: /private\n")], "site string, text string"))
    assert {r["url"] for r in crawl.allowed_by_robots(df.filter("url like '%h.example%'"), simple).collect()} == {u for u in urls[:6] if p.can_fetch("x", u)}


def test_sitemaps(spark):
    index = "<sitemapindex><sitemap><loc>https://h.example/b.xml</loc></sitemap><sitemap><loc> https://h.example/c.xml </loc></sitemap></sitemapindex>"
    deeper = "<sitemapindex><sitemap><loc>https://h.example/d.xml</loc></sitemap><sitemap><loc>https://h.example/a.xml</loc></sitemap></sitemapindex>"
    pages = "<urlset><url><loc><![CDATA[https://h.example/p?a=1&b=2]]></loc></url><url><loc>https://www.h.example/q&amp;r</loc></url><url><loc>https://o.example/</loc></url><url><loc>https://h.example/i.JPG</loc></url></urlset>"
    maps = spark.createDataFrame([("https://h.example/a.xml", index), ("https://h.example/b.xml", deeper), ("https://h.example/c.xml", pages), ("https://h.example/d.xml", pages.replace("/p?", "/z?")), ("https://h.example/lost.xml", pages.replace("/p?", "/y?"))], "url string, xml string")
    got = crawl.sitemap_pages(maps, spark.createDataFrame([("https://h.example/a.xml",)], "url string"))
    assert {r["url"] for r in got.collect()} == {"https://h.example/p?a=1&b=2", "https://h.example/z?a=1&b=2", "https://www.h.example/q&r"}


def test_crawl_budgets(spark):
    page = lambda i: f"https://h.example/p{i:03d}"
    edges = spark.createDataFrame([(page(0), page(i)) for i in range(1, 40)] + [(page(1), page(i)) for i in range(40, 60)] + [(page(0), "https://o.example/x")], "parent string, child string")
    images = spark.createDataFrame([(page(i), k, f"https://h.example/i{i}-{k % 2}.jpg") for i in range(60) for k in range(3)], "page_url string, idx int, url string")
    pages, shown = crawl.crawl(edges, spark.createDataFrame([(page(0),)], "url string"), images, 3, 10, 7)
    got = [r["url"] for r in pages.filter("site = 'h.example'").orderBy("depth", "priority", "url").collect()]
    assert len(got) == 10 and got[0] == page(0) and pages.filter("site = 'o.example'").count() == 1
    assert shown.count() == 7 and {r["page_url"] for r in shown.collect()} <= set(got)


def recorded(given):
    """Pages of an index: 25 of two lines each, then the end; a site that never ends."""
    n = int(given["resumeKey"] or 0)
    lines = [(f"{given['from']}0101{n:06d}", given["url"])] * 2
    if given["url"] == "loop":
        return lines, "1"
    return lines, str(n + 1) if n < 24 else None


def test_archive_index_has_no_page_limit(spark):
    read = lambda *urls, **o: cdx.read_cdx(spark, list(urls), 2019, 2021, "tests.test_more_operators:recorded", **o)
    assert read("a", "b").count() == 2 * 3 * 50 and read("a", limit="7").count() == 21
    assert read("a").filter("year >= 2020 and year <= 2020").count() == 50
    with pytest.raises(Exception, match="again"):
        read("loop").count()


def test_nearest_on_a_hot_key(spark):
    rng = random.Random(4)
    ts = lambda: f"20{rng.randrange(10, 25)}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}{rng.randrange(24):02d}0000"
    from datetime import datetime

    at = lambda t: datetime.strptime(t, "%Y%m%d%H%M%S").timestamp()
    snaps = [("hot", ts()) for _ in range(900)] + [("b", ts()) for _ in range(3)] + [("b", "2020"), (None, ts())]
    asked = [("hot", ts()) for _ in range(200)] + [("b", ts()), ("none", ts()), ("b", "bad")]
    s = spark.createDataFrame([(t, int(t[:4]), k, "") for k, t in snaps], SNAPSHOTS)
    got = {(r["original"], r["wanted_ts"]): r["nearest_ts"] for r in cdx.nearest(s, spark.createDataFrame(asked, "original string, wanted_ts string")).collect()}
    good = [(k, t) for k, t in snaps if len(t) == 14]
    want = {(k, t): min((abs(at(x) - at(t)), x) for j, x in good if j == k)[1] for k, t in asked if t != "bad" and k != "none"}
    assert got == want


def test_store_closure_reaches_any_depth(spark):
    store = spark.createDataFrame([(f"{i}.csv", bytearray(f"{i + 1}.csv\n".encode())) for i in range(12)], "key string, value binary")
    assert {r["key"]: r["depth"] for r in blobs.csv_closure(spark, store, ["0.csv"]).collect()} == {f"{i}.csv": i for i in range(13)}


def test_picture_references(spark):
    pixel = "iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNkYPhfDwAChwGA60e6kgAAAABJRU5ErkJggg=="
    texts = ["https://h.example/a.png", " a/b.jpg ", f"data:image/png;base64,{pixel}", pixel, "", None]
    df = spark.createDataFrame([(t, (None if i % 2 else "p.png", bytearray(b"x") if i % 3 else None, "https://u.example")) for i, t in enumerate(texts)], "t string, s struct<path:string,bytes:binary,url:string>")
    got = df.select(references.image_input(F.col("t"), df.schema["t"].dataType).alias("x"), references.image_input(F.col("s"), df.schema["s"].dataType).alias("y")).collect()
    assert [r["x"]["form"] for r in got] == ["url", "path", "bytes", "bytes", None, None] and bytes(got[2]["x"]["content"]) == bytes(got[3]["x"]["content"])
    assert [r["y"]["form"] for r in got] == ["path", "bytes", "path", "url", "path", "bytes"]
    assert references.image_columns(df) == ["s"] and references.resolve_image_column(df.withColumnRenamed("t", "image_url")) == "image_url" and references.resolve_image_column(df) == "s"
    with pytest.raises(ValueError):
        references.resolve_image_column(df, "no")


def test_context_of_images():
    page = """<article><h2>Head  line</h2><a href=1>one</a><a href=2>two</a><p>Para</p><figure><img src=a.jpg><figcaption>Cap</figcaption></figure><div>Around <img src=b.jpg alt="Own"></div><img src=c.jpg alt=A title=B></article><p>x <img src=d.jpg></p>"""
    rows = {r["url"]: (r["resolved_alt"], r["resolved_title"]) for r in html.parse(page, "").rows()}
    assert rows == {"a.jpg": ("Cap", "Head line"), "b.jpg": ("Own", "one"), "c.jpg": ("A", "B"), "d.jpg": ("x", "")}
    assert html.best_source("a.jpg 300w, b,c.jpg 600w, d.jpg") == "b,c.jpg" and html.best_source("a.jpg 1x,b.jpg 2x") == "b.jpg" and html.best_source("a.jpg") == "a.jpg" and html.best_source(" ") == ""


def test_archive_links(spark):
    page, plain = "https://web.archive.org/web/20200101000000id_/https://o.example/a/b.html", "https://o.example/a/b.html"
    df = spark.createDataFrame([(page, "../i.png"), (page, "/web/20190101000000im_/https://x.example/y"), (plain, "i.png")], "p string, h string")
    got = [r[0] for r in df.select(U.wayback_rewrite(F.col("p"), F.col("h"))).collect()]
    assert got == ["https://web.archive.org/web/20200101000000id_/https://o.example/i.png", "https://web.archive.org/web/20190101000000im_/https://x.example/y", "https://o.example/a/i.png"]
    assert [r[0] for r in df.select(U.wayback_base(F.col("p"))).collect()] == ["https://web.archive.org/web/20200101000000id_/"] * 2 + [None]


PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x02" + b"p" * 6000


def answers(url, headers):
    """A recorded fetcher."""
    if url.endswith("boom"):
        raise TimeoutError("no answer")
    return (404, "text/html", b"") if url.endswith("lost") else (200, "image/png", PNG)


def test_fetch_gives_failures_as_rows(spark, tmp_path):
    urls = ["https://a.example/x.png"] * 3 + ["https://b.example/lost", "https://c.example/boom", "", None, " https://a.example/y.png "]
    df = spark.createDataFrame(list(enumerate(urls)), "i bigint, u string")
    got = {r["i"]: r for r in fetch.fetch(df, "u", "tests.test_more_operators:answers").collect()}
    assert len(got) == len(urls) and [got[i]["fetched"] for i in range(8)] == [True] * 3 + [False] * 4 + [True]
    assert got[3]["error"] == "status 404" and got[3]["http_status"] == 404 and got[4]["error"] == "TimeoutError: no answer" and got[5]["error"] == got[6]["error"] == "no address"
    kept = fetch.with_header(fetch.fetch(df, "u", "tests.test_more_operators:answers"))
    why = fetch.rejection(F.col("content_type"), F.col("n_bytes"), F.col("picture_width"), F.col("picture_height"))
    assert {r["i"]: r["why"] for r in kept.select("i", why.alias("why")).collect()} == {0: None, 1: None, 2: None, 7: None, 3: "content_type", 4: "content_type", 5: "content_type", 6: "content_type"}
    assert {(r["picture_format"], r["picture_width"], r["picture_height"]) for r in kept.filter("fetched").collect()} == {("png", 640, 480)}
    todo, done = fetch.pending(df, spark.createDataFrame([(0,), (3,)], "i bigint"), ["i"])
    assert todo.count() == 6 and fetch.totals(done, kept.filter("i not in (0, 3)")).first().asDict() == {"ok": 5, "failed": 3}
    stored = fetch.write_files(kept.filter("fetched").withColumn("n", F.concat(F.lit("site/image_"), "i", F.lit(".png"))), "content", "n", f"file://{tmp_path}/out")
    assert stored.count() == 4 and (tmp_path / "out/site/image_7.png").read_bytes() == PNG


def test_headers_of_pictures():
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF" + b"\0" * 10 + b"\xff\xc0\x00\x11\x08" + (33).to_bytes(2, "big") + (44).to_bytes(2, "big") + b"\0" * 20
    gif, bmp = b"GIF89a" + (5).to_bytes(2, "little") + (6).to_bytes(2, "little"), b"BM" + b"\0" * 16 + (7).to_bytes(4, "little") + (-8).to_bytes(4, "little", signed=True)
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (199).to_bytes(3, "little")
    assert [fetch.header(x) for x in (PNG, jpeg, gif, bmp, webp, b"<html>", b"", None, b"\xff\xd8\x00")] == [("png", 640, 480), ("jpeg", 44, 33), ("gif", 5, 6), ("bmp", 7, 8), ("webp", 100, 200), None, None, None, None]
    assert fetch.cookies('{"a": 1}') == {"a": "1"} and fetch.cookies('[{"name": "a", "value": "b"}, {}]') == {"a": "b"} and fetch.cookies("a=b; c=d=e") == {"a": "b", "c": "d=e"}


def test_report_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.23456, None), ("c", 2.0, 1)], "filename string, x double, n int")
    text = sinks.report("T", {"One": df, "Short": df.orderBy("filename").select("filename")}, 1)
    assert "| a\\|b | 1.235 |  |" in text and text.count("Only the first 1 rows") == 2
    sinks.write_manifest(df, f"{tmp_path}/m")
    assert spark.read.option("header", True).csv(f"{tmp_path}/m").columns == sinks.MANIFEST


def test_categories_and_archived_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/a_predictions.csv").write_text("score\n0.5\n")
    with pytest.warns(UserWarning, match="no predictions of b"):
        got = files.read_categories(spark, str(tmp_path), ["a", "b"])
    assert list(got) == ["a"] and got["a"].first()["score"] == "0.5"
    for p in ("x.example/2019/20190101000000/i.jpg", "y.example/2020/20200101000000/i.jpg", "y.example/other/i.jpg"):
        (tmp_path / "w" / p).parent.mkdir(parents=True)
        (tmp_path / "w" / p).write_bytes(b"x")
    found = files.image_files(spark, f"{tmp_path}/w")
    rows = lambda **k: {(r["host"], r["year"], r["timestamp"]) for r in files.archived(found, **k).collect()}
    assert rows() == {("x.example", 2019, "20190101000000"), ("y.example", 2020, "20200101000000")}
    assert rows(host="Y.ex") == {("y.example", 2020, "20200101000000")} and rows(years=[2019]) == {("x.example", 2019, "20190101000000")}


def test_text_keys(spark):
    from lumigraph.functions import text as X

    df = spark.createDataFrame([("H.example", "https://h.example/p#x", "photo_290x300.jpg", "T", "A"), ("h", None, "", "", " An  Alt "), (None, None, None, None, None)], "h string, p string, n string, t string, a string")
    got = [r[0] for r in df.select(X.context_group_key(*map(F.col, "hpnta"))).collect()]
    assert got == ["h.example|https://h.example/p|asset:photo", "h||ctx:an alt", None]
