"""Problem 10: long exact spans shared between texts, and how much of each text is shared.

Seeds (winnowed k-mers, a third of the wanted length each, so that a span of the wanted length always holds one) are
joined on their hash, which gives the pairs of texts worth comparing. The seeds of a pair are matched in its texts and
the matches chained in order with gap costs through a Fenwick tree: the best chain first, then the best of what is
left, until every match belongs to a chain. Each chain is aligned on the texts: its anchors are stretched to the
longest equal spans on their diagonals, and stretches that follow one another closely are one fuzzy passage. All
results are read from the aligned chains: spans of the wanted length link two texts, and the passages around such
spans are reported with their gaps.

Equal texts are one class: one member is compared for all, and results name classes; only p10_found, whose rows are
fixed as pairs of documents, expands them.

A seed that very many texts share would make all pairs of them, most for nothing if what they share is shorter than
a span. Such seeds are joined again on longer keys: in a shared span the text left and right of the seed must agree too,
and of the SLICES + 1 ways to place a key of nearly the wanted length around the seed at least one lies inside the span.

A text that repeats a seed inside itself would give a product of matches; there the matches are the equal windows of
the wanted length, each run of windows being one match.

Defined results: null and shorter texts share nothing; documents without an id are left out; equal texts share all of their length; repeated doc_ids count as
one document; an empty table gives an empty result; no part of a text is left out, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumigraph.llm import text_seeds
from lumigraph.operators.skew import salted_self_join
from lumigraph.session import persist_shared, table

MIN_SPAN = 400
#: Chaining: cost of a character between two anchors, and the widest gap inside one fuzzy passage.
GAP_COST = 0.02
PASSAGE_GAP = 60
#: Texts that share a key from which on their pairs are made by several tasks.
ROWS_PER_SALT = 2000
#: Texts that share a seed from which on longer keys around it are joined instead, and slices of such keys.
COMMON_SEED, SLICES = 200, 8
#: Matches per seed of a pair of texts from which on equal windows are matched instead.
MOST_MATCHES = 4
#: Up to so many representatives (24 bytes each) are broadcast to fetch their texts; beyond it they are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000


class Fenwick:
    """Prefix maxima of (value, index)."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(0.0, -1)] * (n + 1)

    def update(self, i: int, v: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if v > self.best[i]:
                self.best[i] = v
            i += i & -i

    def query(self, i: int) -> tuple[float, int]:
        """Best of the entries below i."""
        b = (0.0, -1)
        while i > 0:
            b = max(b, self.best[i])
            i -= i & -i
        return b


def chains(anchors: list[tuple[int, int, int]], gap_cost: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of matches (a, b, length), ascending in both places, by matched length less gap costs.

    The best chain comes first; the next one is the best of the matches that are left, and so on, so that every match
    is in one chain.
    """
    anchors = sorted(set(anchors))
    ranks = {b: r for r, b in enumerate(sorted({b for _, b, _ in anchors}))}
    tree, score, back = Fenwick(len(ranks)), [0.0] * len(anchors), [-1] * len(anchors)
    i = 0
    while i < len(anchors):
        j = i
        while j < len(anchors) and anchors[j][0] == anchors[i][0]:  # matches at one place can't follow one another
            a, b, k = anchors[j]
            v, at = tree.query(ranks[b])
            v -= gap_cost * (a + b)
            score[j], back[j] = (k + v, at) if at >= 0 and v > 0 else (k, -1)
            j += 1
        for x in range(i, j):
            a, b, _ = anchors[x]
            tree.update(ranks[b], (score[x] + gap_cost * (a + b), x))
        i = j
    out, used = [], [False] * len(anchors)
    for end in sorted(range(len(anchors)), key=lambda x: (-score[x], x)):
        if used[end]:
            continue
        own, at = [], end
        while at >= 0 and not used[at]:
            used[at] = True
            own.append(anchors[at])
            at = back[at]
        out.append(own[::-1])
    return out


def _stretch(x: np.ndarray, y: np.ndarray, a: int, b: int) -> tuple[int, int]:
    """[start, end) in x of the longest equal span of x and y through the places a and b."""
    back = min(a, b)
    d = np.flatnonzero(x[a - back : a][::-1] != y[b - back : b][::-1])
    start = a - (int(d[0]) if len(d) else back)
    ahead = min(len(x) - a, len(y) - b)
    d = np.flatnonzero(x[a : a + ahead] != y[b : b + ahead])
    return start, a + (int(d[0]) if len(d) else ahead)


def aligned(x: np.ndarray, y: np.ndarray, chain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start in x, start in y, length) of the longest equal spans through the matches of a chain, each once, in order."""
    done: dict[int, int] = {}
    out = []
    for a, b, _ in chain:
        if a >= done.get(a - b, -1) and x[a] == y[b]:
            s, e = _stretch(x, y, a, b)
            done[a - b] = e
            if e > s:
                out.append((s, s - (a - b), e - s))
    return out


def passages(spans: list[tuple[int, int, int]], gap: int = PASSAGE_GAP) -> list[list[tuple[int, int, int]]]:
    """The spans of an aligned chain, those together that follow one another in both texts within the gap."""
    out: list[list[tuple[int, int, int]]] = []
    for s in sorted(spans):
        if out:
            p = out[-1][-1]
            if abs(s[0] - p[0] - p[2]) <= gap and abs(s[1] - p[1] - p[2]) <= gap:
                out[-1].append(s)
                continue
        out.append([s])
    return out


def _runs(x: np.ndarray, y: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Matches of all equal windows of a length: for each window of x its first place in y, runs on one diagonal as one match."""
    hx, hy = text_seeds.kmer_hashes(x, length), text_seeds.kmer_hashes(y, length)
    common, first = np.unique(hy, return_index=True)
    i = np.flatnonzero(np.isin(hx, common))
    if not len(i):
        return []
    j = first[np.searchsorted(common, hx[i])]
    new = np.r_[True, (np.diff(i) != 1) | (np.diff(j) != 1)]
    at = np.flatnonzero(new)
    return list(zip(i[at].tolist(), j[at].tolist(), (np.diff(np.r_[at, len(i)]) + length - 1).tolist()))


def matches(x: np.ndarray, y: np.ndarray, sx: tuple[np.ndarray, np.ndarray], sy: tuple[np.ndarray, np.ndarray], min_span: int) -> list[tuple[int, int, int]]:
    """The matches (a, b, length) of two texts by their seeds (positions, hashes)."""
    k = min_span // 3
    common = np.intersect1d(sx[1], sy[1])
    ix, iy = np.isin(sx[1], common), np.isin(sy[1], common)
    px, hx, py, hy = sx[0][ix], sx[1][ix], sy[0][iy], sy[1][iy]
    product = (np.unique(hx, return_counts=True)[1] * np.unique(hy, return_counts=True)[1]).sum()
    if product > MOST_MATCHES * len(common):
        return _runs(x, y, min_span) + [(b, a, n) for a, b, n in _runs(y, x, min_span)]
    order = np.argsort(hy, kind="stable")
    lo, hi = np.searchsorted(hy[order], hx, "left"), np.searchsorted(hy[order], hx, "right")
    return [(int(a), int(py[order[j]]), k) for a, f, t in zip(px, lo, hi) for j in range(f, t)]


def _text_class() -> Column:
    """128 bits of a text: equal texts are one class."""
    return F.unhex(F.md5("text"))


def seed_table(docs: DataFrame, min_span: int) -> DataFrame:
    """(h, c): the seeds of the texts of a table (c, text), each once a text."""
    k = min_span // 3

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()  # texts this task met lately, so that a common one is not sent over and over
        for b in batches:
            cs, texts = [], []
            for c, t in zip(b["c"].tolist(), b["text"].tolist()):
                if c not in seen:
                    seen.add(c)
                    cs.append(c)
                    texts.append(t)
            if len(seen) > 1_000_000:
                seen.clear()
            d, _, h = text_seeds.seeds(texts, k, k)
            if not len(d):
                continue
            own = pd.DataFrame({"h": h.view(np.int64), "d": d}).drop_duplicates()
            yield pd.DataFrame({"h": own["h"], "c": np.array(cs, object)[own["d"]]})

    return docs.select("c", "text").mapInPandas(run, "h bigint, c binary")


def long_keys(texts: DataFrame, min_span: int) -> DataFrame:
    """(h, c) of a table (c, text, hs): for the seeds hs of a text the hashes of its long keys around each of their places.

    A key spans the seed, i slices before it and SLICES - 1 - i behind; a span of min_span characters that holds the
    seed has room for at least one of these.
    """
    k = min_span // 3
    step = (min_span - k) // (SLICES + 1)
    length = k + step * (SLICES - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hs, cs = [], []
            for c, t, wanted in zip(b["c"].tolist(), b["text"].tolist(), b["hs"].tolist()):
                _, at, h = text_seeds.seeds([t], k, k)
                at = at[np.isin(h.view(np.int64), np.asarray(wanted, np.int64))]
                whole = text_seeds.kmer_hashes(text_seeds.codes(t), length)
                own = []
                for i in range(SLICES):
                    start = at - i * step
                    start = start[(start >= 0) & (start < len(whole))]
                    own.append(whole[start] ^ np.uint64(i + 1))
                own = np.unique(np.concatenate(own))
                hs.append(own.view(np.int64))
                cs += [c] * len(own)
            yield pd.DataFrame({"h": np.concatenate(hs) if hs else np.empty(0, np.int64), "c": cs})

    return texts.select("c", "text", "hs").mapInPandas(run, "h bigint, c binary")


def _pairs_of(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """(ca, cb), ca < cb, of the classes that share a key."""
    both = salted_self_join(keys.select("h", F.col("c").alias("ca")), keys.select("h", F.col("c").alias("cb")), "h", counts, "n", "ca", ROWS_PER_SALT)
    return both.filter("ca < cb").select("ca", "cb")


def class_pairs(long: DataFrame, min_span: int) -> DataFrame:
    """(ca, cb), ca < cb: classes of a table (c, text) whose texts may share a span of min_span characters."""
    seeds = persist_shared(seed_table(long, min_span).distinct(), "seeds")
    counts = persist_shared(seeds.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "seed-counts")
    common = counts.filter(F.col("n") > COMMON_SEED).select("h")
    pairs = _pairs_of(seeds.join(counts.filter(F.col("n") <= COMMON_SEED).select("h"), "h"), counts.filter(F.col("n") <= COMMON_SEED))
    if common.limit(1).count():
        wanted = seeds.join(common, "h", "left_semi").groupBy("c").agg(F.collect_list("h").alias("hs"))  # seeds of one text
        texts = long.select("c", "text").join(wanted, "c").dropDuplicates(["c"])
        keys = persist_shared(long_keys(texts, min_span).distinct(), "long-keys")
        pairs = pairs.unionAll(_pairs_of(keys, keys.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")))
    return pairs.distinct()


def classes(docs: DataFrame, min_span: int) -> DataFrame:
    """(doc_id, c): documents long enough, with the class of their text."""
    return docs.filter((F.length("text") >= min_span) & F.col("doc_id").isNotNull()).select("doc_id", _text_class().alias("c"))


SPANS = "ca binary, cb binary, a_from int, b_from int, span int, passage int, pa_from int, pa_to int, pb_from int, pb_to int"


def class_spans(docs: DataFrame, members: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """Equal spans of at least min_span between different texts, out of the aligned chains of their matches.

    (ca, cb, a_from, b_from, span) is a span, passage the number of the fuzzy passage it lies in, which reaches from
    pa_from to pa_to in the one text and from pb_from to pb_to in the other.
    """
    long = docs.filter(F.length("text") >= min_span).select("doc_id", "text", _text_class().alias("c"))
    pairs = persist_shared(class_pairs(long, min_span), "pairs")
    needed = pairs.select(F.col("ca").alias("c")).unionAll(pairs.select(F.col("cb").alias("c"))).distinct()
    reps = persist_shared(members.join(needed, "c", "left_semi").groupBy("c").agg(F.min("doc_id").alias("doc_id")), "reps")
    if reps.count() <= MAX_BROADCAST_IDS:
        reps = F.broadcast(reps)
    texts = persist_shared(docs.select("doc_id", "text").join(reps, "doc_id").dropDuplicates(["doc_id"]).select("c", "text"), "texts")
    k = min_span // 3  # of the seeds

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, tuple] = {}

        def read(c: bytes, text: str) -> tuple:
            if c not in known:
                if len(known) >= 64:
                    known.clear()
                _, at, h = text_seeds.seeds([text], k, k)
                known[c] = text_seeds.codes(text), (at, h)
            return known[c]

        for df in batches:
            rows = []
            for ca, cb, ta, tb in zip(df["ca"], df["cb"], df["ta"], df["tb"]):
                (x, sx), (y, sy) = read(ca, ta), read(cb, tb)
                found: set[tuple[int, int, int]] = set()
                n = 0
                for c in chains(matches(x, y, sx, sy, min_span)):
                    for p in passages(aligned(x, y, c)):
                        own = [s for s in p if s[2] >= min_span and s not in found]
                        found.update(own)
                        n += bool(own)
                        rows += [(ca, cb, *s, n, p[0][0], p[-1][0] + p[-1][2], p[0][1], p[-1][1] + p[-1][2]) for s in own]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SPANS.split(", ")])

    both = pairs.join(texts.select(F.col("c").alias("ca"), F.col("text").alias("ta")), "ca").join(texts.select(F.col("c").alias("cb"), F.col("text").alias("tb")), "cb")
    return both.select("ca", "cb", "ta", "tb").mapInPandas(align, SPANS)


def document_pairs(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """(doc_id_a, doc_id_b): all pairs of documents that share a span; the pairs of many equal texts are made by many tasks."""
    members = persist_shared(classes(docs, min_span).distinct(), "classes")
    linked = persist_shared(class_spans(docs, members, min_span).select("ca", "cb").distinct(), "linked")
    sizes = persist_shared(members.groupBy("c").agg(F.count("*").alias("n")), "class-sizes")
    side = lambda key, name: members.select(F.col("c").alias(key), F.col("doc_id").alias(name))
    named = salted_self_join(side("ca", "x"), linked, "ca", sizes.withColumnRenamed("c", "ca"), "n", "x", ROWS_PER_SALT)
    apart = salted_self_join(side("cb", "y"), named, "cb", sizes.withColumnRenamed("c", "cb"), "n", "y", ROWS_PER_SALT).select("x", "y")
    several = sizes.filter("n > 1")
    within = members.join(several.select("c"), "c", "left_semi")
    equal = salted_self_join(within.select("c", F.col("doc_id").alias("x")), within.select("c", F.col("doc_id").alias("y")), "c", several, "n", "x", ROWS_PER_SALT).filter("x < y").select("x", "y")
    return apart.unionAll(equal).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def fuzzy_passages(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """One row per fuzzy passage around spans, between the first documents of two classes: where it lies in both, its spans and their characters.

    class_id is the smallest doc_id of the documents with that text (p10_shares names the class of each document).
    """
    members = persist_shared(classes(docs, min_span).distinct(), "classes")
    ids = members.groupBy("c").agg(F.min("doc_id").alias("id"))
    found = class_spans(docs, members, min_span).groupBy("ca", "cb", "passage").agg(
        F.min("pa_from").alias("a_from"), F.max("pa_to").alias("a_to"), F.min("pb_from").alias("b_from"), F.max("pb_to").alias("b_to"), F.count("*").alias("n_spans"), F.sum("span").alias("span_chars")
    )
    named = found.join(ids.select(F.col("c").alias("ca"), F.col("id").alias("class_id_a")), "ca").join(ids.select(F.col("c").alias("cb"), F.col("id").alias("class_id_b")), "cb")
    return named.select("class_id_a", "class_id_b", "a_from", "a_to", "b_from", "b_to", "n_spans", "span_chars")


def shared_shares(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """One row per document with a span: its class, documents with an equal text, other texts it is linked to, characters and share found elsewhere."""
    members = persist_shared(classes(docs, min_span).distinct(), "classes")
    spans = persist_shared(class_spans(docs, members, min_span), "spans")
    sides = spans.select(F.col("ca").alias("c"), F.col("cb").alias("other"), F.col("a_from").alias("s"), (F.col("a_from") + F.col("span")).alias("e")).unionAll(
        spans.select(F.col("cb").alias("c"), F.col("ca").alias("other"), F.col("b_from").alias("s"), (F.col("b_from") + F.col("span")).alias("e"))
    )
    # the union of intervals as a sum of steps: +1 at each start, -1 at each end, summed per place before any sort
    steps = sides.select("c", F.col("s").alias("at"), F.lit(1).alias("d")).unionAll(sides.select("c", F.col("e").alias("at"), F.lit(-1).alias("d")))
    w = Window.partitionBy("c").orderBy("at")
    cover = steps.groupBy("c", "at").agg(F.sum("d").alias("d")).select("c", "at", F.sum("d").over(w).alias("open"), F.lead("at").over(w).alias("to"))
    covered = cover.filter("open > 0 and to is not null").groupBy("c").agg(F.sum(F.col("to") - F.col("at")).alias("covered"))
    links = sides.groupBy("c").agg(F.countDistinct("other").alias("n_links"))
    sizes = members.groupBy("c").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_equal"))
    facts = sizes.join(covered, "c", "left").join(links, "c", "left").filter("n_equal > 1 or n_links > 0")
    lengths = docs.select("doc_id", F.length("text").alias("n_chars")).dropDuplicates(["doc_id"])
    shared = F.when(F.col("n_equal") > 1, F.col("n_chars")).otherwise(F.col("covered"))
    return (
        members.join(facts, "c").join(lengths, "doc_id")
        .select("doc_id", "class_id", "n_equal", F.coalesce("n_links", F.lit(0)).alias("n_links"), shared.cast("bigint").alias("shared_chars"), F.round(shared / F.col("n_chars"), 6).alias("shared_share"))
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_shares(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares, "p10_passages": p10_passages}
SQL = {
    "p10_found": """with w as (select distinct doc_id, hash(substring(text, i, 400)) as h from documents, range(1, length(text) - 398) t(i) where length(text) >= 400),
    s as (select h from w group by 1 having count(*) > 1), v as (select w.* from w join s using (h))
    select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from v a join v b on a.h = b.h and a.doc_id < b.doc_id""",
    "p10_shares": """with d as (select doc_id, text, md5(text) as c from documents where length(text) >= 400), sizes as (select c, min(doc_id) as class_id, count(distinct doc_id) as n_equal, min(length(text)) as n_chars from d group by 1),
    w as (select distinct c, i, hash(substring(text, i, 400)) as h from (select distinct c, text from d), range(1, length(text) - 398) t(i)),
    s as (select h from w group by 1 having count(distinct c) > 1), v as (select w.* from w join s using (h)),
    covered as (select c, sum(least(400, coalesce(nxt - i, 400)))::bigint as covered from (select c, i, lead(i) over (partition by c order by i) as nxt from v) group by 1),
    ch as (select distinct c, h from v), links as (select a.c, count(distinct b.c) as n_links from ch a join ch b on a.h = b.h and a.c <> b.c group by 1)
    select doc_id, class_id, n_equal, coalesce(n_links, 0)::bigint as n_links, case when n_equal > 1 then n_chars else covered end::bigint as shared_chars, round(case when n_equal > 1 then n_chars else covered end::double / n_chars, 6) as shared_share
    from (select distinct doc_id, c from d) join sizes using (c) left join covered using (c) left join links using (c) where n_equal > 1 or n_links > 0""",
}
