"""Problem 9: evaluation items leaking into a corpus, wholly or in part.

A BM25 inverted index of the items is built once; its postings are cut into blocks of items, and for each term and
block the greatest weight is kept. Each stretch of min_words words of a corpus text is a query, and every item above
its threshold is retrieved: the threshold of an item is the least score that any min_words consecutive words of it
reach on the item itself, times SLACK, so no leak scores below it. Weights are divided by the threshold, which makes
it 1 for all items and lets bounds be shared. As in block-max WAND a query is dropped when the sum of its terms'
greatest weights stays below the threshold, then block by block by the blocks' greatest weights, and only the postings
of blocks that remain are scored; the bounds of all queries of a batch are computed together as sliding sums.
Retrieved items are verified on the text: min_words consecutive words, letter case, punctuation and spacing aside.

Items are spread over shards of bounded size; each shard's index is built and packed by a task of its own and written
to the shared folder. Packed shards are broadcast together up to MAX_BROADCAST_BYTES, counted before; the corpus is read
once and its texts are split into words once for all of them. Only where all shards together are larger is it read once
more for each further group of shards.

Defined results: null texts leak nothing; documents without an id are left out; items of fewer words than min_words can't leak; repeated documents and items
give one row per pair of ids; an empty table on either side gives an empty result; whole texts are read.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.llm.bounded_rank import bounded
from lumigraph.session import persist_shared, table

MIN_WORDS = 12
#: BM25 constants.
K1, B = 1.2, 0.75
#: Part of the threshold that a passage must reach; below 1 to allow for words joined or split differently.
SLACK = 0.75
#: Items, and characters of items, that a shard of the index holds.
ITEMS_PER_SHARD, CHARS_PER_SHARD = 5_000, 5_000_000
#: Bytes of packed shards that are broadcast together.
MAX_BROADCAST_BYTES = 64 << 20
BLOCKS = 96
#: Tokens whose bounds are computed together.
CHUNK = 1 << 15
#: Queries whose block bounds are computed together.
QUERIES_AT_ONCE = 2048

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: The same words where no character is a combining mark; the standard library is faster.
_PLAIN_WORD, _MARK = re.compile(r"[^\W_]+"), re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u1fff\u20d0-\u20ff\u2c00-\uabff\ufe20-\ufe2f\U00010000-\U0010ffff]")


def words(text: str) -> list[str]:
    text = text.lower()
    return (_PLAIN_WORD if text.isascii() or not _MARK.search(text) else _WORD).findall(text)


class Index:
    """BM25 postings of items with the greatest weight per term and per block of items."""

    def __init__(self, items: list[tuple[int, str]], n: int = MIN_WORDS, slack: float = SLACK):
        docs = [(i, w) for i, w in ((i, words(t)) for i, t in items if t) if len(w) >= n]
        self.n, self.ids = n, [i for i, _ in docs]
        average = sum(len(w) for _, w in docs) / max(1, len(docs))
        df = Counter(t for _, w in docs for t in set(w))
        self.vocabulary = {t: k for k, t in enumerate(sorted(df))}
        self.size = max(1, -(-len(docs) // BLOCKS))
        blocks = -(-len(docs) // self.size) if docs else 0
        self.block_max = np.zeros((len(df) + 1, blocks), np.float32)  # the last row is for words outside the index
        self.postings: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        self.words = [w for _, w in docs]
        for d, (_, w) in enumerate(docs):
            tf, length = Counter(w), K1 * (1 - B + B * len(w) / average)
            weight = {t: np.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + length) for t, f in tf.items()}
            least = slack * min(sum(weight[t] for t in set(w[j : j + n])) for j in range(len(w) - n + 1))
            for t, x in weight.items():
                k, b = self.vocabulary[t], d // self.size
                self.postings[k, b].append((d, x / least))
                self.block_max[k, b] = max(self.block_max[k, b], x / least)
        self.postings = dict(self.postings)
        self.term_max = self.block_max.max(axis=1) if blocks else np.zeros(len(df) + 1, np.float32)

    def retrieve(self, terms: np.ndarray) -> list[tuple[int, set[int]]]:
        """(start of a query, its items above the threshold) for all stretches of n of an array of term numbers (-1: not indexed)."""
        n = self.n
        if len(terms) < n or not self.ids:
            return []
        sums = np.cumsum(np.r_[0.0, self.term_max[terms].astype(np.float64)])
        left = np.flatnonzero(sums[n:] - sums[:-n] >= 1 - 1e-6)
        out = []
        for at in range(0, len(left), QUERIES_AT_ONCE):
            starts = left[at : at + QUERIES_AT_ONCE]
            own = terms[starts[:, None] + np.arange(n)]
            bounds = self.block_max[own].sum(axis=1)  # repeated terms count again, which only raises a bound
            hits: dict[int, set[int]] = {}
            for q, b in zip(*(x.tolist() for x in np.nonzero(bounds >= 1 - 1e-6))):
                score: dict[int, float] = defaultdict(float)
                for t in set(own[q].tolist()):
                    for d, x in self.postings.get((t, b), ()):
                        score[d] += x
                found = {d for d, x in score.items() if x >= 1 - 1e-6}
                if found:
                    hits.setdefault(q, set()).update(found)
            out += [(int(starts[q]), found) for q, found in hits.items()]
        return out

    def verified(self, item: int, own: list[str]) -> bool:
        """Whether the words hold n consecutive words of the item, also if words are joined or split differently."""
        line, w = " " + " ".join(own) + " ", self.words[item]
        grams = [" ".join(w[j : j + self.n]) for j in range(len(w) - self.n + 1)]
        if any(f" {g} " in line for g in grams):
            return True
        joined, edges, at = "".join(own), set(), 0
        for w in own:
            edges.add(at)
            at += len(w)
        edges.add(at)
        for g in grams:
            g = g.replace(" ", "")
            p = joined.find(g)
            while p >= 0:
                if p in edges and p + len(g) in edges:
                    return True
                p = joined.find(g, p + 1)
        return False


def shards(items: DataFrame, min_words: int = MIN_WORDS, items_per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """(shard, data): the packed indexes of all items, written."""
    rows = items.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n_shards = max(1, -(-n // items_per_shard), -(-chars // CHARS_PER_SHARD))

    def build(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["item_id", "text"])
        data = zlib.compress(pickle.dumps(Index(list(zip(df["item_id"].tolist(), df["text"].tolist())), min_words)), 1)
        return pd.DataFrame({"shard": [int(df["shard"].iloc[0])], "data": [data]})

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(n_shards)).cast("int"))
    return persist_shared(sharded.groupBy("shard").applyInPandas(build, "shard int, data binary"), "shards")


def leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, items_per_shard: int = ITEMS_PER_SHARD, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id) for every document that holds min_words consecutive words of an item."""
    packed, groups, held = shards(items, min_words, items_per_shard), [], 0
    for r in packed.select("shard", F.length("data").alias("n")).orderBy("shard").collect():  # one small row a shard
        if not groups or held + r["n"] > max_bytes:
            groups.append([])
            held = 0
        groups[-1].append(r["shard"])
        held += r["n"]
    out = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    for g in groups:
        out = out.unionAll(_search(docs, [bytes(r["data"]) for r in packed.filter(F.col("shard").isin(g)).orderBy("shard").collect()], min_words))
    return out.distinct()


def _search(docs: DataFrame, packed: list[bytes], min_words: int) -> DataFrame:
    """The leaks of the items of packed shards into all documents, in one pass over them."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indexes = [pickle.loads(zlib.decompress(data)) for data in shared.value]
        gap = np.full(min_words, -1)
        for df in batches:
            found: list[tuple[int, int]] = []
            held: list[tuple[int, list[str], int]] = []
            size = 0

            def flush() -> None:
                if not held:
                    return
                starts = [s for _, _, s in held]
                for index in indexes:
                    number = index.vocabulary.get
                    terms = np.concatenate([x for _, own, _ in held for x in (np.array([number(w, -1) for w in own], np.int64), gap)])
                    candidates: dict[tuple[int, int], None] = {}
                    for at, hits in index.retrieve(terms):
                        d = int(np.searchsorted(starts, at, "right")) - 1
                        candidates.update(dict.fromkeys((d, i) for i in hits))
                    for d, i in candidates:
                        if index.verified(i, held[d][1]):
                            found.append((held[d][0], index.ids[i]))

            for doc, text in zip(df["doc_id"].tolist(), df["text"].tolist()):
                own = words(text) if text else []
                if len(own) < min_words:
                    continue
                held.append((doc, own, size))
                size += len(own) + min_words
                if size > CHUNK:
                    flush()
                    held, size = [], 0
            flush()
            yield pd.DataFrame(found, columns=["doc_id", "item_id"])

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, item_id bigint")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_item_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the number of documents it leaked into."""
    items = table(spark, sf_dir, "eval_items")
    n = persist_shared(p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n")), "leaked")
    return items.join(bounded(n), "item_id", "left").select("item_id", "task_name", "held_out", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_documents"))


_SQL_FOUND = r"""
with w as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') as ws from eval_items),
g as (select distinct item_id, array_to_string(ws[j : j + 11], ' ') as gram from w, range(1, len(ws) - 10) as t(j)),
d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') as ws from documents),
dg as (select doc_id, array_to_string(ws[j : j + 11], ' ') as gram from d, range(1, len(ws) - 10) as t(j)),
hits as (select distinct doc_id, item_id from dg join g using (gram))
"""
QUERIES = {"p9_found": p9_found, "p9_item_report": p9_item_report}
SQL = {
    "p9_found": _SQL_FOUND + "select doc_id, item_id from hits",
    "p9_item_report": _SQL_FOUND
    + "select item_id, task_name, held_out, coalesce(n, 0) as n_documents from eval_items left join (select item_id, count(*) as n from hits group by item_id) using (item_id)",
}
