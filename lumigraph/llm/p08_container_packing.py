"""Problem 8: texts packed into containers of a fixed number of tokens.

Texts are measured once with a public tokenizer. A text larger than the container is cut into full containers and a
rest; every other text stays whole. The pieces are spread evenly over tasks by a hash, and each task packs its own by
minimum bin slack: a container is opened with the largest piece left, and the multiset of remaining lengths that comes
closest to the room left is found by a subset-sum dynamic program over bit sets (one bit per sum, shifted once per
length and power of two of its count) and traced back to counts. A pattern is used again as often as its counts last,
so the work follows the number of different lengths (at most the capacity), not the number of pieces. A task leaves
one container partly filled at its end; tasks are given CONTAINERS_PER_TASK containers' worth of tokens, so this is a small
part. There are at most MAX_TASKS tasks a kind of container: beyond that tasks become larger (their memory is some 40 bytes
a piece), nothing else changes.

Defined results: documents without an id are left out; null and empty texts have no tokens and take no room: they come out with no container; repeated rows
are separate items; an empty table gives an empty result; ties between patterns go to the longer pieces first.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.session import persist_shared, table

#: Folder of the public tokenizers, and the one that measures by default.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens that a task packs for each container kind, as a multiple of the capacity, and at least.
CONTAINERS_PER_TASK = 2_000
#: Tasks of a kind of container at most.
MAX_TASKS = 100_000
#: Longest run of characters given to the tokenizer at once; longer texts are cut between words there.
RUN = 100_000


@cache
def _encoding(data: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def measured(docs: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every text."""
    with open(f"{tokenizers}/{vocabulary}", "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # under 1 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(shared.value, PATTERN).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [_length(encode, t) for t in b["text"]]})

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, n_tokens bigint")


def _length(encode, text: str | None) -> int:
    if not text:
        return 0
    n, at = 0, 0
    while at < len(text):
        end = at + RUN
        if end < len(text):
            cut = text.rfind(" ", at + 1, end)
            end = cut if cut > at else end
        n += len(encode(text[at:end]))
        at = end
    return n


def _best_fill(counts: np.ndarray, lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of lengths (descending, with counts) whose sum comes closest to room from below."""
    target, reach = 1 << room, 1
    mask = (target << 1) - 1
    steps: list[tuple[int, int, int]] = []  # (sums reachable before, length, how many at once)
    for x in lengths:
        if x > room:
            continue
        left, power = min(int(counts[x]), room // x), 1
        while left > 0:
            take = min(power, left)
            steps.append((reach, x, take))
            reach |= (reach << (x * take)) & mask
            if reach & target:
                break
            left -= take
            power *= 2
        if reach & target:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for before, x, take in reversed(steps):
        if not before >> at & 1:
            used[x] += take
            at -= x * take
    return dict(used)


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A container number for every size (all between 1 and capacity)."""
    out = np.empty(len(sizes), np.int64)
    order = np.argsort(sizes, kind="stable")
    counts = np.bincount(sizes, minlength=capacity + 1)
    ends = np.cumsum(counts)  # items of a size are handed out from the end of their stretch of order
    number = 0
    present = [int(x) for x in np.flatnonzero(counts)[::-1] if x]
    while present:
        first = present[0]
        counts[first] -= 1
        pattern = _best_fill(counts, present, capacity - first) if first < capacity else {}
        counts[first] += 1
        pattern[first] = pattern.get(first, 0) + 1
        times = min(int(counts[x]) // n for x, n in pattern.items())
        for x, n in pattern.items():
            taken = order[ends[x] - n * times : ends[x]]
            out[taken] = number + np.tile(np.arange(times), n)
            ends[x] -= n * times
            counts[x] -= n * times
        number += times
        if any(not counts[x] for x in pattern):
            present = [x for x in present if counts[x]]
    return out


def packed(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, capacity_tokens, doc_id, piece, n_tokens, container) of items (doc_id, n_tokens) for every kind of container.

    container is a number that is unique within a kind; null for items without tokens. containers is a small fixed table.
    """
    kinds = [(r["container_kind"], r["capacity_tokens"]) for r in containers.filter("capacity_tokens > 0").collect()]
    # numbered once and written, so that the items of a repeated id are spread like any others and a lost task deals the same again
    sizes = persist_shared(sizes.select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("item")), "sizes")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    out = None
    for kind, capacity in kinds:
        cuts = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
        pieces = sizes.select("item", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), cuts)).alias("piece")).select(
            F.xxhash64("item", "piece").alias("spread"), "doc_id", "piece", F.least(F.lit(capacity), F.col("n_tokens") - (F.col("piece") - 1) * capacity).cast("bigint").alias("n_tokens")
        )
        n_tasks = max(1, min(MAX_TASKS, total // (capacity * CONTAINERS_PER_TASK)))

        def run(batches: Iterator[pd.DataFrame], capacity: int = capacity) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            parts = [b for b in batches if len(b)]
            if not parts:
                return
            df = pd.concat(parts, ignore_index=True)
            base = TaskContext.get().partitionId() << 40
            some = df["n_tokens"].to_numpy() > 0
            number = pd.Series(pd.NA, index=df.index, dtype="Int64")
            number[some] = base + pack(df["n_tokens"].to_numpy()[some], capacity)
            yield df.assign(container=number)

        own = pieces.repartition(n_tasks, "spread").drop("spread").mapInPandas(run, "doc_id bigint, piece int, n_tokens bigint, container bigint")
        own = own.select(F.lit(kind).alias("container_kind"), F.lit(capacity).alias("capacity_tokens"), "doc_id", "piece", "n_tokens", "container")
        out = own if out is None else out.unionAll(own)
    return out if out is not None else sizes.sparkSession.createDataFrame([], "container_kind string, capacity_tokens int, doc_id bigint, piece int, n_tokens bigint, container bigint")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(measured(table(spark, sf_dir, "documents")), table(spark, sf_dir, "containers"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of container: how many were used, their tokens, and the fewest that could hold them."""
    p = p8_packed(spark, sf_dir)
    return p.groupBy("container_kind", "capacity_tokens").agg(
        F.countDistinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.ceil(F.sum("n_tokens") / F.col("capacity_tokens")).alias("n_least")
    ).withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))


QUERIES = {"p8_packed": p8_packed, "p8_fill": p8_fill}
