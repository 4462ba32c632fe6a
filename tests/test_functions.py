from urllib.parse import urljoin, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigraph.functions import html, pixels, scoring
from lumigraph.functions import text as X
from lumigraph.functions import url as U
from lumigraph.operators import crawl, curves, dedup, filters, stats
from lumigraph.schemas import SCORE_NAMES, resolve_column, with_defaults

URLS = [
    "https://User@Host.Example:8080/a/b.JPG?x=1&utm_source=z#f", "http://www.shop.co.uk/", "//cdn.example/x.png", "/only/path", "https://h.example", "https://h.example/a//b/", "data:image/png;base64,xx", "",
    "https://h.example/p?a=1&a=2&ref=q&b", "https://web.archive.org/web/20200101000000im_/https://o.example/i.jpg",
]


def column(spark, values, f, schema="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_url_parts_like_the_standard_library(spark):
    assert column(spark, URLS, U.netloc) == [urlparse(u).netloc.lower() for u in URLS]
    assert column(spark, URLS[:6] + URLS[7:], U.path) == [urlparse(u).path for u in URLS[:6] + URLS[7:]]
    assert column(spark, URLS, U.query_string) == [urlparse(u).query for u in URLS]


@pytest.mark.parametrize("href", ["x.png", "/x", "//c.example/y", "https://z.example/q", "?p=1", "#top", "", "../up.png", "./same.png", "/a/../b/./c?x=../y", "..", ".", "../../../up.png", "c/../d/?q", "a/b/..", "/..", "x;p=1/../y"])
def test_resolve(spark, href):
    base = "https://h.example/a/b.html?q=1"
    df = spark.createDataFrame([(base, href)], "b string, h string")
    assert df.select(U.resolve(F.col("b"), F.col("h"))).first()[0] == urljoin(base, href)


def test_registrable_domain(spark):
    hosts = ["a.b.example", "shop.co.uk", "x.shop.co.uk", "example", "", ".dots.example.", "a.b.com.au"]
    assert column(spark, hosts, U.registrable_domain) == ["b.example", "shop.co.uk", "shop.co.uk", "example", "", "dots.example", "b.com.au"]


def test_normalise_and_wayback(spark):
    assert column(spark, [URLS[8], "h.example/x?utm_term=1"], U.normalise_url) == ["https://h.example/p?a=1&a=2&b=", "https://h.example/x"]
    assert column(spark, [URLS[9], URLS[1]], U.wayback_original) == ["https://o.example/i.jpg", URLS[1]]
    assert column(spark, [URLS[9], URLS[1]], U.wayback_timestamp) == ["20200101000000", None]


@pytest.mark.parametrize("dialect,expected", [("a", "b.png"), ("b", "b.png"), ("c", "a.png")])
def test_srcset_ties(spark, dialect, expected):
    assert column(spark, ["a.png 300w, b.png 300w"], lambda c: U.srcset_best(c, dialect)) == [expected]
    assert column(spark, ["a.png 1x, b.png 2x, c.png bad"], lambda c: U.srcset_best(c, dialect)) == ["b.png"]


def test_text_functions(spark):
    assert column(spark, ["  A\n b ", None], X.normal) == ["a b", ""]
    assert column(spark, ["x" * 301], X.clean) == ["x" * 300 + "..."]
    assert column(spark, ["photo_290x300.jpg", "id.r_d.18-12.webp", "a_449_221.png"], X.asset_signature) == ["photo", "id", "a"]
    assert column(spark, ["12", " -3 ", "1.5", "", None], X.int_or_null) == [12, -3, None, None, None]
    assert column(spark, [0.6, 0.59, float("nan"), None], lambda c: X.label_of(c, 0.6), "double") == [1, 0, 0, 0]


def test_column_resolution(spark):
    df = spark.createDataFrame([(1, 0.5, " ")], "id int, Prediction double, category string")
    assert resolve_column(df, SCORE_NAMES) == "Prediction"
    assert resolve_column(df, ["none"], numeric_fallback=True, ignore=("id",)) == "Prediction"
    assert with_defaults(df, {"category": "general", "extra": "x"}).first().asDict() == {"id": 1, "Prediction": 0.5, "category": "general", "extra": "x"}


PAGE = """<title>T</title><h1>Head</h1><figure><img data-src="/x.jpg"><figcaption>Caption</figcaption></figure>
<picture><source srcset="a.webp 1x, b.webp 2x"><img src=y.png alt="why" width=3></picture><p><b>open <a href="/news/1?q#f">n</a><a href="mailto:a@b">m</a><a href="f.pdf">p</a>
<div style="background:url('z.gif')"></div><video poster=v.jpg></video><meta property=og:image content=/m.jpg><noscript><img src=n.jpg></noscript><img src="data:x">"""


def test_html(spark):
    df = spark.createDataFrame([("https://h.example/a/b", PAGE), ("https://h.example/e", None)], "url string, html string")
    rows = {r["url"]: r for r in html.page_images(df).collect()}
    assert set(rows) == {f"https://h.example/{p}" for p in ("x.jpg", "a/b.webp", "a/y.png", "a/z.gif", "a/v.jpg", "m.jpg", "a/n.jpg")}
    assert rows["https://h.example/x.jpg"]["context"] == "Caption" and rows["https://h.example/a/y.png"]["declared_width"] == 3
    assert [(r["link"], r["is_priority"]) for r in crawl.page_links(df).collect()] == [("https://h.example/news/1", True)]
    assert {r["page_url"]: r["n_images"] for r in html.page_facts(df).collect()} == {"https://h.example/a/b": 7, "https://h.example/e": 0}


def test_reachable_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "parent string, child string")
    got = crawl.reachable(edges, spark.createDataFrame([("a",)], "url string"), 3).collect()
    assert {r["url"]: r["depth"] for r in got} == {"a": 0, "b": 1, "c": 2, "d": 3}


@pytest.mark.parametrize("size", [32, 48])
@pytest.mark.parametrize("radius", [4, 9])
def test_frequency_split_adds_up(size, radius):
    img = np.random.default_rng(size).normal(size=(size, size))
    low, rest = pixels.frequency_split(img, radius)
    assert abs(low + rest - img).max() < 1e-9


def test_pixels(spark):
    flat, noise = np.full((16, 24), 7.0), np.random.default_rng(1).normal(size=(16, 24))
    assert pixels.dhash(flat) == 0
    assert pixels.fourier_features(noise)["entropy"] > pixels.fourier_features(flat)["entropy"]
    assert abs(sum(pixels.fourier_features(noise)[f"band_{i}"] for i in range(5)) - 1) < 1e-9
    framed = np.pad(noise * 100, 3, constant_values=0)
    assert pixels.trim_border(framed).shape == (16, 24)
    alpha = np.zeros((20, 20))
    alpha[8:12, 8:12] = 255
    assert pixels.sticker_like(alpha) and not pixels.sticker_like(np.full((20, 20), 255))
    assert pixels.patches(noise, 8, 8, 9).shape == (5, 8, 8) or pixels.patches(noise, 8, 8, 9).shape[0] == 6
    df = spark.createDataFrame([(1, 24, 16, noise.ravel().tolist())], "image_id bigint, width int, height int, pixels array<double>")
    assert pixels.image_features(df).first()["dhash"] == int(np.uint64(pixels.dhash(noise)).view(np.int64))


def test_scorer_keeps_going(spark):
    def make():
        def run(xs):
            if "bad" in xs:
                raise ValueError("no")
            return np.array([0.9] * len(xs))

        return run

    scoring.register_scorer("test", make)
    rows = {r["x"]: r for r in scoring.score(spark.createDataFrame([("a",), ("bad",)], "x string").coalesce(1), "x", "test").collect()}
    assert rows["a"]["predicted_label_name"] == "ai" and rows["bad"]["score"] is None and "ValueError" in rows["bad"]["error"]


def test_greedy_like_a_scan(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 12)
    hashes = [int(base[rng.integers(12)] ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 5), replace=False))) for _ in range(120)]
    kept: list[int] = []
    for i, h in enumerate(hashes):
        if all(bin(h ^ hashes[j]).count("1") > 6 for j in kept):
            kept.append(i)
    df = spark.createDataFrame(list(enumerate(hashes)), "id bigint, h bigint")
    got = dedup.greedy_near_duplicates(df, "id", "h", 6)
    assert sorted(r["id"] for r in got.filter("kept").collect()) == kept
    brute = {(i, j) for i in range(120) for j in range(i + 1, 120) if bin(hashes[i] ^ hashes[j]).count("1") <= 6}
    assert {(r["a"], r["b"]) for r in dedup.near_pairs(df, "id", "h", 6).collect()} == brute


def test_curves(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)], "id int, g int, v double")
    assert curves.spread(df, "g", "id", 3).count() == 9
    assert {r["id"] for r in curves.spread(df.filter("g = 0"), "g", "id", 3).collect()} == {0, 12, 27}
    assert curves.quota(df, "g", {0: 2, 1: 5}, "id").count() == 7
    assert curves.hash_sample(df, "id", 0.5).count() == curves.hash_sample(df.repartition(7), "id", 0.5).count()
    names = spark.createDataFrame([("img10",), ("img9",), ("img1",)], "n string")
    assert [r[0] for r in names.orderBy(curves.natural_key(F.col("n"))).collect()] == ["img1", "img9", "img10"]
    stats_row = stats.score_stats(df.filter("false"), [], "v", population=True).first()
    assert stats_row["n"] == 0 and stats_row["std"] == 0.0


def test_rules(spark):
    df = spark.createDataFrame([("https://x.doubleclick.net/a.jpg?utm_source=1", "", 728, 90), ("https://h.example/cat.jpg", "A cat on a mat", 800, 600), (None, None, None, None)], "u string, a string, w int, h int")
    got = [r.asDict() for r in df.select(filters.ad_score(F.col("u"), [F.col("a")], F.col("w"), F.col("h")).alias("s")).select("s.*").collect()]
    assert got[0]["score"] == 2 + 3 + 3 + 1 and got[1]["score"] == 0 and got[2] == {"score": 0, "reasons": ""}


def test_parsers():
    assert X.parse_years("2015,2018-2020") == [2015, 2018, 2019, 2020] and X.parse_numbers("0.5,.3,0.5") == [0.3, 0.5]
    assert X.parse_label_map("Fake=1, real=0") == {"fake": "1", "real": "0"} and X.threshold_column(0.3) == "pred_t_0_3"
    assert X.resolve_split("dev", ["train", "test"]) == "test"


def test_triplets(spark):
    from lumigraph.operators.joins import triplets

    label = {i: i % 3 for i in range(30)}
    rows = triplets(spark.createDataFrame(list(label.items()), "i int, l int"), "i", "l").collect()
    assert len(rows) == 30 and all(label[r.anchor] == label[r.positive] and r.anchor != r.positive and label[r.anchor] != label[r.negative] for r in rows)


def test_more_pixels():
    img = np.random.default_rng(2).normal(size=(20, 30))
    low, noise = pixels.butterworth_split(img)
    assert abs(low + noise - img).max() < 1e-9 and pixels.log_spectrum(img).max() == 1.0 and pixels.fit_square(img, 60).shape == (60, 60)


def test_small_columns(spark):
    assert column(spark, [1.0, float("nan"), float("inf")], X.finite, "double") == [1.0, 0.0, 0.0]
    assert column(spark, ["ab"], X.code_points) == [[97, 98]] and column(spark, ["ai_generated"], X.title_label) == ["Ai Generated"]
