"""Problems 8 to 10 on small tables, against brute force."""

import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumigraph.llm import p08_container_packing as p8
from lumigraph.llm import p09_evaluation_leaks as p9
from lumigraph.llm import p10_shared_spans as p10
from lumigraph.llm import text_seeds

WORDS = "the old loom stands beside a harbour chart and nobody measured it after the war because light fell on copper slate oak linen brass".split()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8), st.integers(1, 30))
def test_p8_fill_is_the_best(sizes, room):
    counts = np.bincount(sizes, minlength=31)
    used = p8._best_fill(counts, sorted(set(sizes), reverse=True), room)
    assert all(counts[k] >= v for k, v in used.items())
    assert sum(k * v for k, v in used.items()) == max(sum(c) for r in range(len(sizes) + 1) for c in itertools.combinations(sizes, r) if sum(c) <= room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=0, max_size=200))
def test_p8_containers_hold(sizes):
    s = np.array(sizes, dtype=np.int64)
    c = p8.pack(s, 50)
    load = np.bincount(c, weights=s) if len(s) else np.zeros(0)
    assert (load <= 50).all() and (load > 0).all() and len(load) <= max(1, 2 * -(-int(s.sum()) // 50))


def test_p8_rows(spark):
    sizes = spark.createDataFrame([(1, 300), (2, 0), (3, 100), (4, 28), (4, 28)], "doc_id bigint, n_tokens bigint")
    kinds = spark.createDataFrame([("a", 128), ("bad", 0)], "container_kind string, capacity_tokens int")
    rows = p8.packed(sizes, kinds).collect()
    assert sum(r["n_tokens"] for r in rows) == 456 and [r["container"] for r in rows if r["doc_id"] == 2] == [None]
    assert sorted(r["n_tokens"] for r in rows if r["doc_id"] == 1) == [44, 128, 128]
    assert p8.packed(sizes.limit(0), kinds).count() == 0
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "a b " * 60_000)], "doc_id bigint, text string")
    n = {r["doc_id"]: r["n_tokens"] for r in p8.measured(texts).collect()}
    assert n[1] == n[2] == 0 and n[3] >= 120_000


def test_p9_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(WORDS, k=25)) + "?") for i in range(12)] + [(99, "too short"), (98, None)]
    docs = [(0, None), (1, "")]
    for d in range(2, 80):
        t = rng.choices(WORDS, k=60)
        if d % 3 == 0:
            w = items[rng.randrange(12)][1].split()
            k, s = rng.randrange(9, 16), rng.randrange(0, 8)
            t[20:20] = [x.upper() + rng.choice(["", ",", "\n", " –"]) for x in w[s : s + k]]
        docs.append((d, " ".join(t)))
    docs.append((5, docs[5][1]))
    want = set()
    for d, t in docs:
        line = " " + " ".join(p9.words(t or "")) + " "
        for i, x in items:
            w = p9.words(x or "")
            if any(" " + " ".join(w[j : j + 12]) + " " in line for j in range(len(w) - 11)):
                want.add((d, i))
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = p9.leaks(df, it).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and want
    assert {tuple(r) for r in p9.leaks(df, it, items_per_shard=5).collect()} == want  # several shards, one pass
    assert {tuple(r) for r in p9.leaks(df, it, items_per_shard=5, max_bytes=1).collect()} == want  # a pass for each
    assert p9.leaks(df, it.limit(0)).count() == 0 and p9.leaks(df.limit(0), it).count() == 0


def test_p9_many_items_are_one_scan(spark):
    """Thousands of items in several shards are searched in one pass over the documents."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(3000)]
    docs = [(i, " ".join(word() for _ in range(30)) + " " + " ".join(items[i * 7][1].split()[4:17])) for i in range(40)]
    it, df = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")
    got = p9.leaks(df, it, items_per_shard=500)
    assert p9.shards(it, items_per_shard=500).count() == 6
    assert {tuple(r) for r in got.collect()} == {(i, i * 7) for i in range(40)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_p8_repeated_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(p8, "CONTAINERS_PER_TASK", 10)
    sizes = spark.range(2000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit(40).cast("bigint").alias("n_tokens"))
    got = p8.packed(sizes, spark.createDataFrame([("k", 100)], "container_kind string, capacity_tokens int"))
    tasks = got.groupBy((F.col("container") / F.lit(1 << 40)).cast("int")).count().collect()
    assert len(tasks) > 20 and max(r["count"] for r in tasks) < 200 and sum(r["count"] for r in tasks) == 2000


def test_p9_joined_words():
    index = p9.Index([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")])
    assert index.verified(0, p9.words("x one two three fourfive six seven eight nine ten eleven twelve thirteen"))
    assert not index.verified(0, p9.words("one two three four five six seven eight nine ten eleven"))


def test_p10_against_brute_force(spark):
    rng = random.Random(10)
    make = lambda n: "".join(rng.choices("abcdefgh ñ", k=n))
    spans = [make(n) for n in (39, 40, 41, 60, 200)]
    texts = [(i, make(rng.randrange(0, 120)) + rng.choice(spans) + make(30) + rng.choice(spans) + make(rng.randrange(60))) for i in range(60)]
    texts += [(100, "ab" * 300), (101, "ba" * 40 + "x" + "ab" * 25), (102, None), (103, ""), (104, texts[0][1]), (104, texts[0][1]), (105, "ab" * 300)]
    want = set()
    for (i, x), (j, y) in itertools.combinations({t for t in texts if t[1]}, 2):
        if any(x[k : k + 40] in y for k in range(len(x) - 39)):
            want.add((min(i, j), max(i, j)))
    df = spark.createDataFrame([(d, t, 0) for d, t in texts], "doc_id bigint, text string, c int")
    got = p10.document_pairs(df.select("doc_id", "text"), 40).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    shares = {r["doc_id"]: r for r in p10.shared_shares(df.select("doc_id", "text"), 40).collect()}
    linked = {x for p in want for x in p}
    assert set(shares) == linked and shares[100]["shared_share"] == 1.0 and shares[100]["class_id"] == 100
    for d, t in texts[1:8]:
        if d in linked:
            cover = set()
            for e, u in texts:
                if u and e != d and u != t:
                    for k in range(len(t) - 39):
                        if t[k : k + 40] in u:
                            cover |= set(range(k, k + 40))
            assert shares[d]["shared_chars"] == len(cover)
    assert p10.document_pairs(df.limit(0).select("doc_id", "text"), 40).count() == 0


def test_p10_common_span_is_salted(spark, monkeypatch):
    monkeypatch.setattr(p10, "ROWS_PER_SALT", 10)
    rng = random.Random(11)
    common = "".join(rng.choices("abcdefgh", k=60))
    texts = [(i, "".join(rng.choices("abcdefgh", k=50)) + common + "".join(rng.choices("abcdefgh", k=50))) for i in range(70)]
    assert p10.document_pairs(spark.createDataFrame(texts, "doc_id bigint, text string"), 40).count() == 70 * 69 // 2


def test_p10_chain_is_collinear():
    anchors = [(0, 0, 5), (10, 10, 5), (20, 5, 5), (30, 30, 5), (30, 31, 5), (40, 12, 5)]
    found = p10.chains(anchors)
    assert found[0][0] == (0, 0, 5) and len(found[0]) == 3
    assert all(a[0] < b[0] and a[1] < b[1] for c in found for a, b in zip(c, c[1:])) and sorted(x for c in found for x in c) == sorted(anchors)


def test_p10_rows_come_from_the_chains(spark, monkeypatch):
    rng = random.Random(12)
    make = lambda n: "".join(rng.choices("abcdefgh", k=n))
    common = make(90)
    x, y = make(30) + common + make(30), make(50) + common[:45] + "#" + common[45:] + make(9)
    found = p10.passages(p10.aligned(*map(text_seeds.codes, (x, y)), [(30, 50, 13), (90, 111, 13)]))
    assert [[(s, m) for s, _, m in p] for p in found] == [[(30, 45), (75, 45)]]
    df = spark.createDataFrame([(1, x), (2, y), (3, make(200))], "doc_id bigint, text string")
    # which class is the first of a pair depends on its hash
    assert [tuple(r) for r in p10.fuzzy_passages(df, 40).collect()] in ([(1, 2, 30, 120, 50, 141, 2, 90)], [(2, 1, 50, 141, 30, 120, 2, 90)])
    monkeypatch.setattr(p10, "chains", lambda _: [])
    assert p10.document_pairs(df, 40).count() == 0


def test_p10_common_seed_makes_few_pairs(spark, monkeypatch):
    """Texts that share less than a span are not paired, however many they are; those that share one are all found."""
    monkeypatch.setattr(p10, "COMMON_SEED", 10)
    rng = random.Random(13)
    make = lambda n: "".join(rng.choices("abcdefgh", k=n))
    seed, span = make(28), make(40)
    texts = [(i, make(30) + (span if i % 5 == 0 else seed) + make(30)) for i in range(150)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    long = df.select(p10._text_class().alias("c"), "text")
    assert p10.seed_table(long, 40).groupBy("h").count().filter("count > 10").count() > 0
    n_sharing = 30 * 29 // 2
    assert n_sharing <= p10.class_pairs(long, 40).count() < n_sharing + 300
    assert p10.document_pairs(df, 40).count() == n_sharing


def test_p10_long_keys_fit_every_span():
    for span in (40, 100, 400, 401, 999):
        k = span // 3
        step = (span - k) // (p10.SLICES + 1)
        for left in range(span - k + 1):
            assert any(i * step <= left and (p10.SLICES - 1 - i) * step <= span - k - left for i in range(p10.SLICES))


def test_seeds_meet_in_common_spans():
    rng = random.Random(3)
    for _ in range(50):
        s = "".join(rng.choices("abcd", k=39))
        x, y = ("".join(rng.choices("abcd", k=rng.randrange(80))) + s + "".join(rng.choices("abcd", k=50)) for _ in range(2))
        d, _, h = text_seeds.seeds([x, y], 20, 20)
        assert set(h[d == 0].tolist()) & set(h[d == 1].tolist())
