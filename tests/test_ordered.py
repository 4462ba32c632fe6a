"""Sums, ranks and quantiles per key when one key holds nearly all rows and spans many ranges."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigraph.operators import curves, ordered, stats


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(rng.choice(["hot"] * 30 + ["a", None]), i, rng.choice([0.25, 0.5, rng.random()]), rng.randrange(2)) for i in rng.sample(range(10_000), 3000)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, i bigint, x double, y int")


def groups(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        out[r[0]].append(r)
    return out


def test_running_and_rank(df, rows):
    got = ordered.running(df, ["k"], [F.col("i")], {"s": F.col("y"), "n": F.lit(1)}, totals=True, ranges=9).collect()
    assert len(got) == len(rows)
    want = {}
    for own in groups(rows).values():
        s = 0
        for n, r in enumerate(own, 1):
            s += r[3]
            want[r[1]] = (s, n, len(own))
    assert {r["i"]: (r["s"], r["n"], r["n_total"]) for r in got} == want
    assert ordered.placed(df, ["k"], [F.col("i")], 9).filter("k = 'hot'").select("__p").distinct().count() >= 8


def test_previous(df, rows):
    got = {r["i"]: r["b"] for r in ordered.with_previous(df, ["k"], F.col("i"), "y", "b", 9).collect()}
    assert got == {b[1]: a and a[3] for own in groups(rows).values() for a, b in zip([None, *own], own)}


def test_quantiles(df, rows):
    got = {r["k"]: r for r in ordered.quantiles(df, ["k"], "x", {"q": 0.25, "m": 0.5, "t": 0.9}).collect()}
    for k, own in groups(rows).items():
        x = [r[2] for r in own]
        assert np.allclose([got[k]["q"], got[k]["m"], got[k]["t"]], np.quantile(x, [0.25, 0.5, 0.9]))
    assert stats.score_stats(df.limit(0), [], "x", population=True).first()["median"] == 0.0


def test_curves_of_a_hot_key(df, rows):
    own = [(r[2], r[3]) for r in rows if r[0] == "hot"]
    pos, neg = [x for x, y in own if y], [x for x, y in own if not y]
    auroc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs({r["k"]: r["auroc"] for r in stats.curve_metrics(df, ["k"], "x", "y").collect()}["hot"] - auroc) < 1e-9


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 2.0)], "k string, x double")
    assert [r["n"] for r in stats.histogram(df, "x", 4).orderBy("bin").collect()] == [1, 0, 1, 1]
    by_key = stats.histogram(df, "x", 4, ["k"]).orderBy("k", "bin").collect()
    assert [(r["k"], r["n"]) for r in by_key] == [("a", 1), ("a", 0), ("a", 0), ("a", 1), ("b", 1), ("b", 0), ("b", 0), ("b", 0)]


def test_numbers_of_any_length(spark):
    df = spark.createDataFrame([("x" + "9" * 20,), ("x" + "1" + "0" * 20,), ("x7",), ("x007",)], "n string")
    got = [r[0] for r in df.orderBy(curves.natural_key(F.col("n")), "n").collect()]
    assert got == ["x007", "x7", "x" + "9" * 20, "x" + "1" + "0" * 20]
    assert spark.range(1).select(curves.padded(F.lit(1234567), 6), curves.padded(F.lit(7), 6)).first() == ("1234567", "000007")
