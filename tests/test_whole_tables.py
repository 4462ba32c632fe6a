"""The queries over whole tables against plain Python, record by record."""

import hashlib
import re
from collections import defaultdict
from urllib.parse import urljoin, urlparse

import pytest

from lumigraph.functions import html
from lumigraph.plans import catalogue, system_queries
from lumigraph.session import table

ADDRESSES = [
    "https://h.example/a.jpg?x=1&y=2", "http://h.example/p/b.png", " HTTPS://H.example/c-1-2.jpg\n", "\u00a0http://h.example/d \"e\".gif#f", "https://h.example/q?copy=1&lt=2&amp;z<b>", "ftp://h.example/x.jpg", "https://h.example/image_1_2/k.jpg#a\nb", "", None,
]


@pytest.fixture(scope="module", params=["made", "sf"])
def data(request, spark, sf, tmp_path_factory):
    """A folder of tables and the records of images_meta."""
    d = sf
    if request.param == "made":
        d = str(tmp_path_factory.mktemp("made"))
        t = table(spark, sf, "images_meta").limit(1)
        rows = [{**t.first().asDict(), "row_id": i, "image_url": u, "img_title": "A wide Title " * (i * 8), "page_url": None if i == 2 else f"https://h.example/p{i}?a&b", "website_url": None, "stored_filename": f"n{i} & <b>.jpg", "detected_width": None, "detected_height": 5 - i} for i, u in enumerate(ADDRESSES)]
        spark.createDataFrame(rows, t.schema).write.parquet(f"{d}/images_meta.parquet")
    return d, [r.asDict() for r in table(spark, d, "images_meta").collect()]


def got(spark, data, name):
    return catalogue.queries()[name](spark, data[0]).collect()


def image_address(r):
    u = (r["image_url"] or "").strip()
    return u and not u.startswith(("data:", "blob:", "javascript:")) and urljoin(r["page_url"] or "", u)


def test_pages(spark, data):
    rows = data[1]
    shown = [r for r in rows if image_address(r)]
    name = lambda r: " ".join((r["stored_filename"] or "").split())
    found = html.page_images(system_queries.pages(spark, data[0])).collect()
    assert sorted((r["page_url"] or "", r["url"]) for r in found) == sorted((r["page_url"] or "", image_address(r)) for r in shown)
    assert [tuple(r) for r in got(spark, data, "page_images")] == [("img", "figure", len(shown), len({name(r) for r in shown}))]
    assert [tuple(r) for r in got(spark, data, "page_facts")] == [(len(rows), len(shown), 4 * len(rows), len({name(r) for r in rows}))]
    origin = lambda u: re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", u)[0]
    links = [(r["page_url"], origin(r["page_url"]) + p, p[1:2] == "n") for r in rows if r["page_url"] for p in (f"/news/{r['row_id']}", f"/up/{r['row_id']}", "/q")]
    assert sorted(tuple(r) for r in got(spark, data, "page_links")) == sorted(links)
    assert sorted(r["url"] for r in got(spark, data, "frontier_queue")) == sorted({r["page_url"] for r in rows if r["page_url"]} - {r["website_url"] for r in rows})


def canonical(u):
    p = urlparse((u or "").strip())
    if p.scheme not in ("http", "https"):
        return ""
    parts = []
    for x in p.path.split("/"):
        if x and not re.fullmatch(r"image_\d+_\d+", x) and not x.startswith("content_image_") and x != (parts or [None])[-1]:
            parts.append(x)
    if not parts:
        return f"{p.netloc.lower()}|"
    stem = re.sub(r"(?<=[^.])\.[^.]+$", "", parts[-1])  # as the SQL of canonical_key has it
    stem = stem.split(".r_d.")[0]
    stem = re.sub(r"-\d+$", "", stem) if re.search(r"(?:-\d+){2,}$", stem) else stem
    return f"{p.netloc.lower()}|" + "/".join([*parts[:-1], stem])


def test_canonical_keys(spark, data):
    keys = {r["row_id"]: canonical(r["image_url"]) for r in data[1]}
    assert {r["row_id"]: r["image_key"] or "" for r in got(spark, data, "canonical_key")} == keys
    groups = defaultdict(list)
    for r in data[1]:
        w, h = r["detected_width"], r["detected_height"]
        groups[keys[r["row_id"]] or r["row_id"]].append((-(w * h if w is not None and h is not None else 0), -(w or 0), -(h or 0), r["row_id"]))
    assert sorted(r["row_id"] for r in got(spark, data, "canonical_key_best")) == sorted(min(g)[3] for g in groups.values())


def test_names_links_and_titles(spark, data):
    links = {r["row_id"]: r["link"] for r in got(spark, data, "link_normalise")}
    files = {r["row_id"]: r["file"] for r in got(spark, data, "safe_filename")}
    texts = {r["row_id"]: (r["title"], r["meta"]) for r in got(spark, data, "norm_text")}
    assert len(links) == len(files) == len(texts) == len(data[1])
    for r in data[1]:
        i, u, t = r["row_id"], r["image_url"], re.sub(r"[ \t\n\v\f\r]+", " ", r["img_title"] or "").strip(" ")
        assert links[i] == (u and re.sub(r"[\t\r\n]", "", u.strip()).replace(" ", "%20").split("#")[0])
        assert u is None and files[i] is None or hashlib.md5(u.encode()).hexdigest()[:12] in files[i]
        cut = t[:300] and (t if len(t) <= 400 else t[:400].rstrip(" ") + "...")
        assert texts[i] == (t.lower(), " ".join(re.sub(r"[^a-z0-9 ]", " ", cut.lower()).split()))


def test_signatures_need_no_size(spark, tmp_path):
    t = table(spark, "/root/testdata/sf0.001", "images_meta").limit(1)
    rows = [{**t.first().asDict(), "row_id": i, "website_url": "https://h.example", "img_title": "Harbour chart in oak", "img_alt_text": None, "detected_width": w, "detected_height": w} for i, w in ((1, None), (2, None), (3, 10))]
    spark.createDataFrame(rows, t.schema).write.parquet(f"{tmp_path}/images_meta.parquet")
    assert sorted(tuple(r) for r in catalogue.queries()["signature_dups"](spark, str(tmp_path)).collect()) == [(2, 1), (3, 1)]
