"""Problems 1 to 7 on small tables: nulls, blanks, ties, repeats, empty tables, clashing names; against brute force."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumigraph.llm import bounded_rank, repeat_filter
from lumigraph.llm import p01_format_duplicates as p1
from lumigraph.llm import p02_contributor_caps as p2
from lumigraph.llm import p03_template_residue as p3
from lumigraph.llm import p04_batch_history as p4
from lumigraph.llm import p05_score_cutoffs as p5
from lumigraph.llm import p06_target_proportions as p6
from lumigraph.llm import p07_garbled_encoding as p7

SAME = [
    "https://H.example/a b/c.jpg?x=1&y=2", "https://h.example/a%20b/c.jpg?y=2&x=1", "HTTPS://h.example/a-b//c%2Ejpg?x=1&amp;y=2", " <https://h.example/a%2520b/c.jpg?x%3D1%26y=2>", "https://h.example/a+b/./c.jpg?x=1;y=2#",
    "https://h.example/a_b/c.jpg?&x=\"1&&y=2", "https://h.example/a b/c.jpg?x=1&#38;y=2",
]
OTHER = ["http://h.example/a b/c.jpg?x=1&y=2", "https://h.example/a b/c.jpg?x=1&y=3", "https://h.example/a b/c.png?x=1&y=2", "https://www.h.example/a b/c.jpg?x=1&y=2"]


def images(spark, rows, schema="row_id bigint, image_url string, __key int, h string"):
    return spark.createDataFrame(rows, schema)


def test_p1_spellings(spark):
    rows = [(i, u, 0, "x") for i, u in enumerate(SAME + OTHER + [None, None, "", "?!"])]
    got = p1.copies_of_first(images(spark, rows), p1.canonical_address(F.col("image_url")), "row_id").collect()
    n = len(SAME) + len(OTHER)
    assert sorted(tuple(r) for r in got) == [(0, i) for i in range(1, len(SAME))] + [(n + 2, n + 3)]
    groups = {r["first_row_id"]: r["n_copies"] for r in p1.collapse(images(spark, rows), p1.canonical_address(F.col("image_url")), "row_id").collect()}
    assert groups[0] == len(SAME) and sum(groups.values()) == len(rows) and groups[n] == groups[n + 1] == 1


def test_p1_empty_and_beyond_the_filter(spark, monkeypatch):
    empty = images(spark, [])
    assert p1.copies_of_first(empty, p1.canonical_address(F.col("image_url")), "row_id").count() == 0
    # segments so small that the filter is made in many groups: the method and the result stay
    monkeypatch.setattr(repeat_filter, "plan", lambda n: (7, 4))
    rows = [(i, SAME[i % 3] if i < 9 else f"https://h.example/{i}", 0, "") for i in range(60)]
    got = {r["first_row_id"]: r["n_copies"] for r in p1.collapse(images(spark, rows), p1.canonical_address(F.col("image_url")), "row_id").collect()}
    assert got == {0: 9} | {i: 1 for i in range(9, 60)}
    assert sorted(r["copy_row_id"] for r in p1.copies_of_first(images(spark, rows), p1.canonical_address(F.col("image_url")), "row_id").collect()) == list(range(1, 9))


def test_p1_filter_groups_hold_every_hash(spark):
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 2000)
    n, groups = 130, 3
    got = spark.createDataFrame([(int(x),) for x in h], "h bigint").select("h", repeat_filter.group_of(F.col("h"), n, groups).alias("g")).collect()
    assert all(r["g"] == int(repeat_filter._segments(np.array([r["h"]]), n)[0]) % groups for r in got)
    assert repeat_filter.plan(10**10)[1] > 1 and repeat_filter.plan(0) == (1, 1)


def test_p1_hot_key_is_salted(spark, monkeypatch):
    from lumigraph.operators import skew

    rows = [(i, "https://h.example/hot" if i % 3 else f"https://h.example/{i}", 0, "") for i in range(3000)]
    df = spark.createDataFrame([(f"k{i % 3}", i) for i in range(3000)], "k string, i bigint")
    groups = df.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    assert skew.attach_group_values(df, groups, ["k"], "n", "i", rows_per_salt=100).count() == 3000
    assert p1.copies_of_first(images(spark, rows), p1.canonical_address(F.col("image_url")), "row_id").count() == 1999


def test_repeat_filter_loses_no_repeat(spark):
    rng = np.random.default_rng(0)
    h = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-(2**63), 2**63 - 1, 300).repeat(2)])
    df = spark.createDataFrame([(int(x),) for x in h], "h bigint").repartition(5)
    for n in (repeat_filter.plan(len(h))[0], 7):
        marks = repeat_filter.maybe_repeated(spark, F.col("h"), repeat_filter.repeated(df, n), n)
        got = df.withColumn("m", marks).filter("m").groupBy("h").count().collect()
        assert sum(r["count"] == 2 for r in got) == 300 and len(got) < 450


def test_keep_least_is_exact(spark):
    rng = random.Random(1)
    rows = [(f"g{rng.choice('abc')}", round(rng.random(), 2) + 0.001, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, key double, i bigint")
    limits = spark.createDataFrame([("ga", 10), ("gb", 500), ("gz", 3)], "g string, most bigint")
    got = sorted(r["i"] for r in bounded_rank.keep_least(df, "g", "key", "i", limits, "most", 2000).collect())
    want = []
    for g, n in (("ga", 10), ("gb", 500)):
        want += [i for _, i in sorted((k, i) for x, k, i in rows if x == g)[:n]]
    assert got == sorted(want)


@pytest.mark.parametrize("weight", [0.05, 1.0])
def test_buckets_stay_small_for_any_weight(spark, monkeypatch, weight):
    """Ranks of poor records (keys u ** 20) are spread over buckets like those of good ones."""
    monkeypatch.setattr(bounded_rank, "ROWS_PER_BUCKET", 100)
    n = 20_000
    keys = spark.range(n).select("id", F.lit("g").alias("g"), bounded_rank.exponential(bounded_rank.uniform("x", F.col("id")), F.lit(weight)).alias("key"))
    steps = max(bounded_rank.STEPS, n // 100)
    assert keys.groupBy(F.floor(F.log2("key") * steps)).count().agg(F.max("count")).first()[0] < 100
    limits = spark.createDataFrame([("g", 5000)], "g string, most bigint")
    got = {r["id"] for r in bounded_rank.keep_least(keys, "g", "key", "id", limits, "most", n).collect()}
    u = keys.select("id", bounded_rank.uniform("x", F.col("id")).alias("u")).collect()
    assert got == {r["id"] for r in sorted(u, key=lambda r: -r["u"] ** (1 / weight))[:5000]}


def test_p2_shares_hold(spark):
    counts = spark.createDataFrame([("s", "a", 100), ("s", "b", 30), ("s", "c", 20), ("t", "a2", 5), ("u", "x", 50), ("u", "y", 60)], "sector string, site string, n bigint")
    shares = spark.createDataFrame([("s", 0.4), ("t", 1.0), ("u", 0.3)], "sector string, share double")
    got = {r["sector"]: (r["cap"], r["met"]) for r in p2.caps(counts, shares).collect()}
    assert got["t"] == (None, True) and got["u"] == (33, False)
    c, met = got["s"]
    kept = [min(n, c) for n in (100, 30, 20)]
    assert met and max(kept) <= 0.4 * sum(kept) and min(100, c + 1) > 0.4 * sum(min(n, c + 1) for n in (100, 30, 20))
    assert p2.caps(counts.limit(0), shares).count() == 0


def test_p2_quality_prefers_better_records(spark):
    img = [(i, "https://a.example/", 1920 if i % 2 else 0, 1080, "alt", None, "extra") for i in range(400)] + [(1000, None, None, None, None, None, "")] + [(2000 + i, f"http://www.b{i}.example", 10, 10, "", "", "") for i in range(3)]
    images_ = spark.createDataFrame(img, "row_id bigint, website_url string, detected_width int, detected_height int, img_alt_text string, img_title string, site string").withColumn("organization_name", F.lit(None).cast("string")).withColumn("sector", F.lit("s"))
    sites = spark.createDataFrame([("https://www.a.example", "s", None), *[(f"https://b{i}.example", "s", "") for i in range(3)]], "url string, sector string, organization_name string")
    rows = p2.contributions(images_, sites)
    counts = rows.groupBy("sector", "site").agg(F.count("*").alias("n"))
    sector_caps = spark.createDataFrame([("s", 100, True)], "sector string, cap bigint, met boolean")
    got = {r["row_id"] for r in p2.capped(rows, counts, sector_caps).collect()}
    assert len(got) == 104 and 1000 in got and {2000, 2001, 2002} <= got
    assert sum(i % 2 for i in got if i < 400) > 80


def test_p2_unknown_sites_count_for_their_organisation(spark):
    org = {i: ("One  Museum" if i < 300 else "Two Halls" if i < 500 else "Nowhere" if i < 620 else " " if i < 640 else None) for i in range(660)}
    img = [(i, "https://one.example/" if i < 100 else None, org[i], "own", 1920, 1080, "alt", None) for i in range(660)] + [(5000 + i, "https://x.example", "X", "t", 1, 1, "", "") for i in range(10)] + [(300, None, "two halls", "own", 1, 1, "", "")]
    images_ = spark.createDataFrame(img, "row_id bigint, website_url string, organization_name string, sector string, detected_width int, detected_height int, img_alt_text string, img_title string")
    sites = spark.createDataFrame([("https://www.one.example", "s", "one museum"), ("https://two-a.example", "t", "Two Halls"), ("https://two-b.example", "t", "Two Halls"), ("https://x.example", "t", "X")], "url string, sector string, organization_name string")
    rows = p2.contributions(images_, sites)
    counts = rows.groupBy("sector", "site").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in counts.collect()} == {("s", "one.example", 300), ("t", "organisation: two halls", 201), ("own", "organisation: nowhere", 120), ("t", "x.example", 10), (None, None, 40)}
    kept = p2.capped(rows, counts, p2.count_caps(counts.filter("site is not null"), 50)).groupBy("site").count().collect()
    assert {tuple(r) for r in kept} == {("one.example", 50), ("organisation: two halls", 50), ("organisation: nowhere", 50), ("x.example", 10), (None, 40)}


RESIDUE = [
    "{{ user.name }}", "{{title | escape}}", "{% image.alt %}", "${alt}", "#{caption}", "<%= title %>", "<?= $alt ?>", "<!-- imgTitle -->", "[[caption]]", "[%title%]", "*|ALT|*", "%alt_text%", "@@title@@", "##ALT##", "__alt__", "$title$", "{caption}",
    "A cat – {{alt}}", "&#123;&#123;alt&#125;&#125;", "%7B%7Balt%7D%7D", "{0} ({1})", "Photo of %s", "null", "undefined, undefined", "NaN", "[object Object]", "Lorem ipsum dolor", "velit mollit ipsum", "xxxx xxxx xx", "asdf asdf", "test test 12",
    "Insert image caption here", "Your headline goes here", "caption TK, do not publish", "404 | Not Found", "HTTP 503 - Service Unavailable", "Bad Gateway (502)", "Page not found", "Página no encontrada", "Seite nicht gefunden!", "Your session has exp…",
    "Please enable JavaScript to view this image", "java script must be switched on to load this page", "Ce site ne fonctionne pas sans scripts.", "Cal activar JavaScript per veure la imatge", "translation missing: en.photo.caption", "gallery.item.caption.default",
]
SOUND = [
    "Set notation {a, b, c} on a blackboard", "Type specimen {9} cut by Smith", "50%–60% shade study", "Sign #9 & #12", "Lost and not found, novel cover, 1913", "Null Island on a sailor's chart", "Film script with notes", "Workshop on JavaScript for the staff",
    "<Untitled> by Smith, oil on board", "[Left] woodcut; [right] loom", "404 steps to the lighthouse", "Error bars on the chart", "A cat worth $9 and a $12 note", "Undefined shapes, oak relief", "Placeholder, sculpture by X", "12% silk: label", "", "   ", None,
]


def test_p3_residue_and_sound_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(RESIDUE + SOUND)], "i int, t string")
    got = {r["i"]: r["k"] for r in df.select("i", p3.residue_kind(F.col("t")).alias("k")).collect()}
    assert [RESIDUE[i] for i in range(len(RESIDUE)) if got[i] is None] == []
    assert [SOUND[i] for i in range(len(SOUND)) if got[len(RESIDUE) + i] is not None] == []


def test_p3_rows(spark):
    df = spark.createDataFrame([(1, "null", "A cat", "k"), (2, None, "A dog", "k"), (1, "null", "A cat", "k")], "row_id bigint, img_alt_text string, img_title string, kind string")
    assert sorted(tuple(r)[:2] for r in p3.fields_with_residue(df, p3.FIELDS).collect()) == [(1, "img_alt_text")] * 2
    assert [r["row_id"] for r in p3.without_residue(df, p3.FIELDS).collect()] == [2]
    long = "Every word of this tutorial is sound. " * 40 + "Write `{{name}}` in a template."
    one = spark.createDataFrame([(long,)], "t string").select(p3.residue_kind(F.col("t"))).first()[0]
    assert one is None


MESSAGES = [
    "Página no encontrada", "Página não encontrada", "Pàgina no trobada", "Accès refusé : la session a expiré!", "Später erneut versuchen", "Страница не найдена", "Доступ запрещён", "Внутренняя ошибка", "Введите описание", "Включите JavaScript",
    "Η σελίδα δεν βρέθηκε", "Δεν επιτρέπεται η πρόσβαση", "Εσωτερικό σφάλμα", "Εισαγάγετε περιγραφή", "Ενεργοποιήστε την JavaScript", "Page not found", "Insérez la légende ici", "Escriba aquí", "S’ha produït un error",
]


def test_p3_messages_in_any_case(spark):
    """Capitals (with and without accents), sentence case and decomposed letters, alone and beside real text."""
    forms = [f for m in MESSAGES for f in (m, m.upper(), p3.bare(m.lower()).upper(), m.lower(), unicodedata.normalize("NFD", m.upper()))]
    texts = [t for f in forms for t in (f, f + " - Μουσείο / Museum")]
    got = spark.createDataFrame([(t,) for t in texts], "t string").filter(p3.residue_kind(F.col("t")).isNull()).collect()
    assert [r["t"] for r in got] == []


@settings(max_examples=100, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
@pytest.mark.parametrize("kind, pattern", [("placeholder", p3.PLACEHOLDER), ("value", p3.VALUES), ("filler", p3.FILLER), ("error", p3.ERRORS), ("scripts", p3.SCRIPTS)])
def test_p3_triggers_hold_of_what_patterns_make(kind, pattern, data):
    plain = re.sub(r"\\p\{([LMN])\}|\\p\{([PS])\}", lambda m: "a-z" if m[1] else "!-/", pattern.replace(r"\p{L}*", "[a-z]*").replace(r"\p{L}+", "[a-z]+").replace(r"\p{L}{", "[a-z]{"))
    plain = re.sub(r"\(\?<!\\\.\(.*?\)\)", "", plain)  # look-behinds of several widths
    text = data.draw(st.from_regex(plain.replace("(?iu)", "(?i)")))
    assert any(t in p3.bare(text.lower()) for t in p3.TRIGGERS[kind]), text


def test_p3_cases_that_triggers_lost(spark):
    lost = ["Erro interno do servidor", "Foto: erro interno", "elit, sed do", "Duis aute", "sed quis nisi", "esse anim", "sit enim elit", "HTTP 503", "Error 404", "Sitzung ist abgelaufen"]
    got = spark.createDataFrame([(t,) for t in lost], "t string").filter(p3.residue_kind(F.col("t")).isNull()).collect()
    assert [r["t"] for r in got] == []


def test_p3_wider_signs_and_cut_parts(spark):
    bad = [
        "{{ image title }}", "{% if photo %}", "<?php echo $title; ?>", "{{#each images}}", "{{items[0].title}}", "{{título}}", "Oak relief {{ подпись | default: 'x' }}", "${photo.titles[0]}", "<%= item[:alt] %>", "##título##", "{{ image tit", "{% if pho", "<?php echo $ti",
        "Portrait of a man | Please enable JavaSc", "Oak relief – Seite nicht gefu…", "Accès refusé : la sess | Musée",
    ]
    sound = ["{{1, 2}} on a slate", "Sets {a, b} and {c}", "Portrait of a man | Please", "Fish – page in a book", "Cost <5 % and >3 %", "50% off {%"]
    got = {r["t"]: r["k"] for r in spark.createDataFrame([(t,) for t in sound + bad], "t string").select("t", p3.residue_kind(F.col("t")).alias("k")).collect()}
    assert [t for t in sound if got[t]] == [] and [t for t in bad if not got[t]] == []


def test_p3_mentions_in_short_texts(spark):
    sound = ["How to use {{name}} in templates", "Screenshot of the {{user}} syntax tutorial", "Slide: `{% if %}` on a screen", "A page about the placeholder {{title}}", 'Tutorial slide showing "{{name}}" on a wall', "The ${user} variable: how to write ${user}"[26:]]
    bad = ["{{template}}", "The template maker Smith – {{alt}}", "{{alt}} – The template maker Smith", '"{{title}}"', 'Photo "{{title}}" by Smith', "{{alt}} How to use {{name}} in templates", "Syntax, oak relief {{caption}}"]
    got = {r["t"]: r["k"] for r in spark.createDataFrame([(t,) for t in sound + bad], "t string").select("t", p3.residue_kind(F.col("t")).alias("k")).collect()}
    assert [t for t in sound if got[t]] == [] and [t for t in bad if not got[t]] == []


def test_p3_context_and_density_at_any_length(spark):
    """One rule for all lengths: a mention is none in a short text, a message alone is one in a long field too."""
    filler = "The old mill by the river was measured and drawn by the survey in 1925. "
    sound = [
        'A neon sign reading "Page not found" above a bar', 'Screenshot of "Access denied" on an old terminal', 'Poster saying "lorem ipsum dolor sit amet"', "Use `{{ name }}` here", "```\n{{ a }} {{ b }}\n``` is a template", "<code>${user}</code> explained",
        filler * 60 + "Then the session expired and we left.", filler * 60 + "{{ alt }}", filler * 60 + "lorem ipsum dolor",
    ]
    bad = ["Page not found", filler + "{{ alt }}", filler + "Page not found.", "{{ a }} " * 300, "lorem ipsum dolor sit amet " * 100, "Template Viacrutern failed t...", "template wiacelei failed to rend…", "Status code 500, Internal Server ...", "Old bridge at dusk. Your session has exp…"]
    got = {r["t"]: r["k"] for r in spark.createDataFrame([(t,) for t in sound + bad], "t string").select("t", p3.residue_kind(F.col("t")).alias("k")).collect()}
    assert [t[-60:] for t in sound if got[t]] == [] and [t[-60:] for t in bad if not got[t]] == []


#: Messages written for this test, none of them in the lists of the module.
UNSEEN = [
    "Error 503: the gateway is having a rest", "HTTP 418", "Sorry, that page could not be loaded just now", "Access denied. You tried a locked door", "You do not have permission to look at this picture", "Fatal error in picture.php", "TypeError: width is undefined",
    "Kindly enable JavaScript before you go on", "Our map requires JavaScript", "JavaScript seems to be disabled", "JavaScript was turned off", "This gallery won't work like that", "Um JavaScript aktivieren zu können", "Merci d'activer JavaScript", "Active el JavaScript, por favor",
    "Página no encontrada en el archivo", "Cette page introuvable", "Seite nicht gefunden auf dem Server", "{{ entry.caption|upper }}", "{% block alt %}", "${picture.alt}", "<%= picture.alt %>", "[[alt_text]]", "%picture_title%", "Lorem ipsum velit", "Your caption goes here", "Insert a caption", "Please try again later or call us",
    "Imagen no disponible", "Ficheiro não encontrado.", "Image indisponible", "Das Bild konnte nicht geladen werden", "Изображение не найдено", "Η εικόνα δεν βρέθηκε", "画像が見つかりません", "Document has been removed", "Photo is currently unavailable", "Aquesta imatge no disponible!",
]


def test_p3_messages_not_in_the_lists(spark):
    df = spark.createDataFrame([(t,) for t in UNSEEN], "t string").select("t", p3.residue_kind(F.col("t")).alias("k"))
    assert not {p3.bare(t) for t in UNSEEN} & {p3.bare(b) for b in p3.BEGINNINGS}
    missed = [r["t"] for r in df.filter("k is null").collect()]
    assert len(missed) <= 0.1 * len(UNSEEN), missed


def test_p3_triggers_lose_nothing(spark):
    """The search for fixed pieces gives what the patterns alone give."""
    df = spark.read.parquet("/root/testdata/sf0.01/images_meta.parquet").select(F.explode(F.array("img_alt_text", "img_title")).alias("t")).filter("t is not null").distinct()
    plain = F.regexp_replace("t", r"[\s\x{00A0}\x{200B}\x{FEFF}]+", " ")
    alone = plain.rlike(p3.PLACEHOLDER) | plain.rlike(p3.VALUES) | plain.rlike(p3.REPEATED) | plain.rlike(p3.FILLER) | plain.rlike(p3.ERRORS) | plain.rlike(p3.SCRIPTS)
    assert df.filter(alone & p3.residue_kind(F.col("t")).isNull()).count() == 0


def test_p4_against_a_scan(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        d = rng.randrange(12)
        day = rng.choice([f"2024-01-{d + 1:02d}", f"2024/01/{d + 1:02d}", f"202401{d + 1:02d}", f"2024-01-{d + 1:02d}T00:00:00", None if rng.random() < 0.1 else f"2024-01-{d + 1:02d}"])
        h = rng.choice([f"{rng.randrange(150):064x}", f" {rng.randrange(150):064X} ", None, "n/a", "0" * 64])
        u = rng.choice([f"https://h.example/{rng.randrange(150)}/large.jpg?w=9", f"https://snapshots.example/web/20200101000000im_/https://h.example/{rng.randrange(150)}/thumb.png?cb=1", None])
        rows.append((i, day, h, u, "clash"))
    df = spark.createDataFrame(rows, "row_id bigint, crawl_date string, file_hash string, image_url string, day string")
    keyed = df.select("row_id", p4.day_of(F.col("crawl_date")).alias("d"), p4.clean_hash(F.col("file_hash")).alias("h"), p4.picture_address(F.col("image_url")).alias("a")).collect()
    seen, want = set(), set()
    for day in sorted({r["d"] for r in keyed if r["d"]}):
        batch = [r for r in keyed if r["d"] == day]
        new = [r for r in batch if not ({r["h"], r["a"]} - {None}) & seen]
        want |= {r["row_id"] for r in batch} - {r["row_id"] for r in new}
        seen |= {k for r in new for k in (r["h"], r["a"]) if k}
    assert {r[0] for r in p4.repeats_of_history(spark, df).collect()} == want
    last = max(r["d"] for r in keyed if r["d"])
    assert {r[0] for r in p4.repeats_of_last_batch(spark, df).collect()} == {r["row_id"] for r in keyed if r["d"] == last} & want
    monkeypatch.setattr(p4, "ROWS_PER_RANGE", 200)
    monkeypatch.setattr(p4, "MAX_RUNS", 3)
    monkeypatch.setattr(p4, "MAX_LISTED_RANGES", 5)
    assert {r[0] for r in p4.repeats_of_history(spark, df, 1).collect()} == want
    assert p4.repeats_of_history(spark, df.limit(0)).count() == 0


def test_p4_compacts(spark, monkeypatch):
    monkeypatch.setattr(p4, "MAX_RUNS", 2)
    h = p4.History(spark)
    for i in range(4):
        h.append(spark.createDataFrame([(i, i)], "k1 bigint, k2 bigint"), 1)
    assert len(h.runs) <= 2 and sorted(r["k1"] for r in h.keys().collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("a,b,same", [
    ("https://h.example/renditions/800x600/x_001.jpg?utm_source=f", "https://h.example/renditions/150x150/x-001.webp?cb=9", True), ("https://h.example/img?id=1&w=3&h=4&fmt=png&q=8", "HTTPS://h.example/img?q=70&id=1&fmt=jpg", True),
    ("https://h.example/a-1@2x.jpg", "https://h.example/a-1_thumb.png?w=1", True), ("https://h.example/a 1 scaled.jpg", "https://h.example/a-1.jpg", True), ("https://h.example/img?id=1", "https://h.example/img?id=2", False),
    ("https://g.example/a.jpg", "https://h.example/a.jpg", False), ("https://snapshots.example/web/20200101000000im_/https://h.example/a.jpg", "https://h.example/a.jpg", True),
])
def test_p4_addresses(spark, a, b, same):
    x, y = spark.createDataFrame([(a, b)], "a string, b string").select(p4.picture_address(F.col("a")), p4.picture_address(F.col("b"))).first()
    assert (x == y) == same


@pytest.mark.parametrize("bound", [5, 100_000])
def test_p5_against_sorting(spark, monkeypatch, bound):
    rng = random.Random(5)
    monkeypatch.setattr(p5, "BOUND", bound)
    monkeypatch.setattr(p5, "PARTS", 4)
    rows = [(rng.choice("ab"), rng.choice([1e-9, 3e-9, 0.5, rng.random(), 1.0, 0.0]), rng.randrange(1, 4)) for _ in range(500)]
    rows += [("c", 0.9999 + rng.random() / 10_000, 1) for _ in range(300)] + [("d", 1.0, 60)]  # all in one bucket of the sketch
    records = spark.createDataFrame([(s, x, i) for s, x, n in rows for i in range(n)], "source string, score double, row_id bigint")
    targets = spark.createDataFrame([("a", 0.35), ("b", 0.9), ("none", 0.5), ("c", 0.5), ("d", 0.1)], "source string, fraction double")
    got = {r["source"]: r for r in p5.cutoffs(records, targets).collect()}
    assert p5.brackets(records, targets).filter("lo < hi").agg(F.coalesce(F.max("inside"), F.lit(0))).first()[0] <= bound
    for s, f in (("a", 0.35), ("b", 0.9), ("c", 0.5), ("d", 0.1)):
        flat = sorted((x for g, x, n in rows if g == s for _ in range(n)), reverse=True)
        k = -(-int(f * len(flat) * 1000) // 1000)
        k = int(np.ceil(f * len(flat) - 1e-9))
        assert got[s]["cutoff"] == flat[k - 1] and got[s]["n_kept"] == sum(x >= flat[k - 1] for x in flat) and got[s]["n_scored"] == len(flat)
    assert got["none"]["cutoff"] is None and got["none"]["n_kept"] == 0


def test_p5_unusable_scores(spark):
    images_ = spark.createDataFrame([(1, "u", " A "), (2, "u", "a"), (3, "v", None), (4, None, "a"), (5, "w", "a")], "row_id bigint, image_url string, sector string")
    results = spark.createDataFrame([(1, "u", 0.2), (2, "u", 0.7), (3, "u", float("nan")), (4, "w", None), (5, "w", 1.5)], "result_id bigint, image_url string, score double")
    assert sorted(tuple(r) for r in p5.scored(images_, results).collect()) == [(1, "a", 0.7), (2, "a", 0.7)]


def _allocated(spark, targets, size):
    df = spark.createDataFrame(targets, "target_id bigint, s string, u string, share double, least bigint, most bigint").withColumn("there", F.col("most"))
    got = p6.allocate(df, size).collect()
    assert all(abs(r["short"] - max(0, r["share"] * size - r["there"])) < 1e-9 for r in got)
    return {r["target_id"]: r["quota"] for r in got}


def test_p6_allocation(spark):
    t = [(1, "a", "x", 0.5, 0, 10), (2, "a", "x", 0.1, 0, 100), (3, "a", "y", 0.2, 0, 100), (4, "b", "z", 0.2, 30, 100)]
    assert _allocated(spark, t, 100) == {1: 10, 2: 43, 3: 17, 4: 30}  # 40 rows that 1 lacks go to its sibling; 4 keeps its minimum within the 100
    assert _allocated(spark, [(1, "a", "x", 0.5, 0, 900), (2, "b", "x", 0.49, 0, 900), (3, "c", "x", 0.01, 50, 900)], 100) == {1: 25, 2: 25, 3: 50}
    assert _allocated(spark, [(1, "a", "x", 0.5, 80, 900), (2, "b", "x", 0.5, 80, 900)], 100) == {1: 50, 2: 50}  # minima beyond the sample are cut
    assert _allocated(spark, [(1, "a", "x", 0.5, 0, 5), (2, None, None, 0.5, 0, 7)], 100) == {1: 5, 2: 7}
    assert _allocated(spark, [], 10) == {}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 30), st.integers(0, 300)), min_size=1, max_size=8), st.integers(0, 500))
def test_p6_division(children, quota):
    share, least, most = (np.array(x) for x in zip(*children))
    got = p6.divide(quota, share / 100, least, most)
    low, high = np.minimum(least, most), np.where(share > 0, most, np.minimum(least, most))
    assert got.sum() == min(quota, high.sum()) and (got <= high).all() and (quota < low.sum() or (got >= low).all())
    if quota >= low.sum():  # none that could take more has less for its share than another that could give
        for i in range(len(share)):
            for j in range(len(share)):
                if share[i] and share[j] and got[i] < high[i] and got[j] > low[j]:
                    assert got[i] >= got[j] * share[i] / share[j] - 1 - share[i] / share[j] - 1e-6


def test_p6_sample_against_ranks(spark):
    rows = [(i, "museum", "art" if i % 3 else "sea", 2020 + i % 2) for i in range(3000)]
    images_ = spark.createDataFrame(rows, "row_id bigint, sector string, subsector string, wayback_year int")
    targets = spark.createDataFrame([(1, "museum", "art", 2020, 0.9, 1), (2, "museum", "sea", 2021, 0.1, 60)], "target_id bigint, sector string, subsector string, wayback_year int, target_share double, min_rows int")
    _, plan = p6.planned(spark, images_, targets)
    quota = {r["target_id"]: r["quota"] for r in plan.collect()}
    assert quota == {1: 90, 2: 60}
    u = {r[0]: r[1] for r in images_.select("row_id", bounded_rank.uniform(p6.SEED, F.col("row_id"))).collect()}
    want = set()
    for t, (sub, year) in {1: ("art", 2020), 2: ("sea", 2021)}.items():
        want |= {(i, t) for i in sorted((i for i, _, s, y in rows if (s, y) == (sub, year)), key=u.get)[: quota[t]]}
    assert {tuple(r) for r in p6.sample(spark, images_, targets).collect()} == want


def test_p6_rows(spark):
    rows = [(i, " Museum " if i % 2 else "museum", "Art", 2020, "category") for i in range(400)] + [(500, None, "art", 2020, ""), (501, "museum", "art", None, "")]
    images_ = spark.createDataFrame(rows, "row_id bigint, sector string, subsector string, wayback_year int, s string")
    targets = spark.createDataFrame([(1, "museum", "art", 2020, 0.5, 1), (2, "none", "art", 2020, 0.5, 1)], "target_id bigint, sector string, subsector string, wayback_year int, target_share double, min_rows int")
    rows_, plan = p6.planned(spark, images_, targets)
    got = {r["target_id"]: r for r in plan.collect()}
    assert rows_.count() == 400 and got[1]["quota"] == 20 and got[2]["unmet"] and not got[1]["unmet"]
    assert p6.planned(spark, images_.limit(0), targets)[1].filter("unmet").count() == 0


GARBLED = {
    "FundaciÃ³n AÃ±il": "Fundación Añil", "ColeÃƒÂ§ÃƒÂ£o": "Coleção", "balcĂłn": "balcón", "f├╝r BÃ¼hne": None, "B√ºhnenplakat": "Bühnenplakat", "РћРєРЅРѕ": "Окно", "Studie ьber Gebдude": "Studie über Gebäude", "Ãðàâþðà èç äóáà": "Гравюра из дуба",
    "ÂÜñêá êáé": "Βάρκα και", "тБУЛТБЫЕООБС": "Раскрашенная", "Fr¸he Radierung": "Frühe Radierung", "br�l�e": None, "l&#195;&#161;mina": "lámina", "\x8f¬\x82³\x82È": "小さな", "¿§¤¢¤»¤¿": "色あせた", "Ausschnitt für HofgemÃ¤lde": "Ausschnitt für Hofgemälde",
}
CORRECT = ["Fundación Añil", "Â vowel chart", "IRMÃ À JANELA", "«CAFÉ» à Paris", "Þór and Æsa", "−24 °C", "Größe: 22 cm × 100 cm", "½ loom, ¼ scale", "Гравюра из дуба", "Βάρκα και", "色あせた", "Łódź and Dvořák", "€595 ticket", "plain", "", None, "¿Qué? ¡Olé!"]


def test_p7_cases():
    for text, original in GARBLED.items():
        found, restored = p7.repair(text)
        assert found, text
        if original is not None:
            assert restored == original
    assert [t for t in CORRECT if p7.repair(t)[0]] == []


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1250", "iso8859-2", "cp437", "cp850", "mac_roman", "cp1251"])
def test_p7_round_trip(codec):
    for text in ("La fotografía señala el año", "Über die Größe der Brücke", "A tradição da canção"):
        try:
            garbled = text.encode("utf-8").decode(codec)
        except UnicodeDecodeError:
            continue
        assert p7.repair(garbled) == (True, text)


@pytest.mark.parametrize("text,right,wrong", [
    ("中文", "gb18030", "latin-1"), ("中国的照片", "gb18030", "latin-1"), ("繁體中文", "big5", "latin-1"), ("繁體中文的照片", "big5", "cp1252"), ("한국어 사진", "euc_kr", "cp1252"), ("ПРИВЕТ МИР", "cp1251", "cp1252"),
    ("Γέφυρα στην πόλη", "cp1253", "cp1252"), ("日本の写真", "euc_jp", "latin-1"), ("Фото моста", "koi8-r", "cp1252"),
])
def test_p7_gives_no_wrong_original(text, right, wrong):
    found, restored = p7.repair(text.encode(right).decode(wrong))
    assert found and restored in (text, None)


def test_p7_restored_is_right_where_given():
    """Held-out accuracy: correct texts put through confusions of encodings; what is restored must be right, nearly always."""
    given = right_ = 0
    for text in ("La fotografía señala el año", "Über die Größe der Brücke", "A tradição da canção", "Вид на старый мост", "Γέφυρα στην πόλη", "Détail d'une façade à Évreux", "Vista de l'església d'ací", "Ночной рынок у реки"):
        for right, wrong in itertools.product(("utf-8", "cp1252", "cp1251", "cp1253", "mac_roman", "koi8-r"), ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850")):
            try:
                garbled = text.encode(right).decode(wrong)
            except UnicodeError:
                continue
            restored = p7.repair(garbled)[1] if garbled != text else None
            given, right_ = given + (restored is not None), right_ + (restored == text)
    assert given > 50 and right_ >= 0.95 * given


def test_p7_lost_bytes_are_traces_only():
    assert p7.repair("Museo de historia y geografÃa") == (True, None)


def test_p7_rows(spark):
    df = spark.createDataFrame([(1, "aÃ±o", None, "x"), (2, "", "año", "x"), (1, "aÃ±o", None, "x")], "row_id bigint, img_alt_text string, organization_name string, text string")
    assert [(r["row_id"], r["field_name"], r["restored"]) for r in p7.garbled_fields(df, p7.FIELDS).collect()] == [(1, "img_alt_text", "año")] * 2
    assert p7.garbled_fields(df.limit(0), p7.FIELDS).count() == 0


def test_p4_history_opened_again(spark, tmp_path, monkeypatch):
    """Batches loaded by one job each, into a history known by its path only, give what one job gives; whole before and after compaction."""
    monkeypatch.setattr(p4, "MAX_RUNS", 2)
    rng = random.Random(44)
    rows = [(i, f"2024010{i // 20 + 1}", f"{rng.randrange(40):064x}".replace("0", "a", 1), f"https://h.example/{rng.randrange(60)}.jpg") for i in range(100)]
    df = spark.createDataFrame(rows, "row_id bigint, crawl_date string, file_hash string, image_url string")
    want = {r["row_id"] for r in p4.repeats_of_history(spark, df).collect()}
    got = set()
    for day in range(1, 6):
        history = p4.History(spark, f"file://{tmp_path}/h")
        assert (history.version > 0) == (day > 1)
        got |= {r["id"] for r in history.load(p4.entries(df.filter(F.col("crawl_date") == f"2024010{day}"))).collect()}
    assert got == want and want
    one, other = p4.History(spark, f"file://{tmp_path}/h"), p4.History(spark, f"file://{tmp_path}/h")
    assert len(one.runs) <= 2
    keys = one.keys().select("k1", "k2").limit(1)
    one.append(keys, 1)
    with pytest.raises(RuntimeError):
        other.append(keys, 1)


def test_p4_merge_compares_windows():
    new = pa.table({"k1": [5, 5, 7, 9, -3], "k2": [1, 2, 7, 0, 4]})
    old = pa.table({"k1": [5, 5, 5, 8, -3], "k2": [2, 3, 9, 7, 4]})
    assert sorted(zip(*(c.to_pylist() for c in p4._merge(new, old).columns))) == [(-3, 4), (5, 2)]
    assert p4._merge(new, old.slice(0, 0)).num_rows == p4._merge(new.slice(0, 0), old).num_rows == 0


def test_p4_reads_touched_ranges_only(spark, monkeypatch):
    """A batch of one key reads the same number of history rows from a history ten times as large, and doesn't shuffle them."""
    monkeypatch.setattr(p4, "ROWS_PER_RANGE", 100)
    read = []
    for n in (2_000, 20_000):
        rng = np.random.default_rng(n)
        k = rng.integers(-(2**63), 2**63 - 1, (n, 2))
        h = p4.History(spark)
        h.append(spark.createDataFrame([(int(a), int(b)) for a, b in k], "k1 bigint, k2 bigint"), n)
        one = spark.createDataFrame([(int(k[7][0]), int(k[7][1])), (1, 1)], "k1 bigint, k2 bigint")
        assert [tuple(r) for r in h.matches(one).collect()] == [(int(k[7][0]), int(k[7][1]))]
        touched = [r[0] for r in one.select(p4.range_of(F.col("k1"), h.state["ranges"])).distinct().collect()]
        read.append(h.keys(touched).count())
        plan = h.matches(one)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(range") == 1 and "Bucketed: true" in plan
    assert read[1] < 2 * read[0] and read[1] < 1000


def test_p4_ranges_are_slices_of_equal_keys(spark):
    rng = np.random.default_rng(5)
    k = sorted(int(x) for x in rng.integers(-(2**63), 2**63 - 1, 4000))
    got = [r[0] for r in spark.createDataFrame([(x,) for x in [-(2**63), *k, 2**63 - 1]], "k bigint").select(p4.range_of(F.col("k"), 10)).collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] == 9 and max(got.count(i) for i in range(10)) < 500
