"""Partition-merged Bloom filters of hashes seen once and seen repeatedly.

Every task packs the 64-bit hashes it reads into a pair of bit sets per segment of the hash space: ``once`` has the
bits of all hashes, ``twice`` those of hashes met again. Pairs of one segment are merged in a stream,
``twice |= t | (once & o); once |= o``: a hash found by two tasks has all its bits in ``once & o``, so no repeat is
lost, and only the compressed bit sets travel, never the rows. A hash outside the merged ``twice`` is certainly unique.

Segments grow in number with the rows (BITS_PER_ROW bits each). They are handled in groups of SEGMENTS_PER_GROUP, the
filter of one group being built, broadcast and tested by itself, so what is held at once is bounded at any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT_BITS = 1 << 23
SEGMENT_BYTES = SEGMENT_BITS // 8
#: Segments of 1 MB whose merged filters are broadcast together.
SEGMENTS_PER_GROUP = 64
#: Bits of a filter for each row, and bit positions for each hash.
BITS_PER_ROW, POSITIONS = 16, 4
HASHES_PER_CHUNK = 1 << 20


def _positions(h: np.ndarray, k: int = POSITIONS) -> np.ndarray:
    """k bit positions for each hash, by double hashing; shape (len(h), k)."""
    u = h.astype(np.uint64)
    a = u & np.uint64(0xFFFFFFFF)
    b = ((u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) | np.uint64(1)
    return np.stack([((a + np.uint64(i) * b) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64) for i in range(k)], axis=1)


def _segments(h: np.ndarray, n: int) -> np.ndarray:
    return ((h.astype(np.uint64) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _bits(positions: np.ndarray) -> np.ndarray:
    b = np.zeros(SEGMENT_BITS, dtype=np.uint8)
    b[positions] = 1
    return np.packbits(b)


def _pack(positions: np.ndarray) -> bytes:
    """A bit set, as gaps where that is shorter; the first byte tells which."""
    p = np.unique(positions)
    if len(p) * 4 < SEGMENT_BYTES:
        return b"g" + zlib.compress(np.diff(p, prepend=0).astype(np.uint32).tobytes(), 1)
    return b"b" + zlib.compress(_bits(p).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data[1:])
    if data[:1] == b"b":
        return np.frombuffer(raw, dtype=np.uint8)
    return _bits(np.cumsum(np.frombuffer(raw, dtype=np.uint32), dtype=np.int64))


def plan(n_rows: int) -> tuple[int, int]:
    """(segments, groups of segments) for so many rows."""
    n = max(1, -(-n_rows * BITS_PER_ROW // SEGMENT_BITS))
    return n, -(-n // SEGMENTS_PER_GROUP)


def group_of(h: Column, n_segments: int, n_groups: int) -> Column:
    """The group that the segment of a hash belongs to (the same arithmetic as _segments)."""
    return F.pmod(F.pmod(F.shiftrightunsigned(h, 32), F.lit(n_segments)), F.lit(n_groups)).cast("int")


def repeated(hashes: DataFrame, n_segments: int) -> list[tuple[int, bytes]]:
    """The merged ``twice`` bit sets of a one-column DataFrame of hashes of one group, at most SEGMENTS_PER_GROUP MB."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def emit(parts: list[np.ndarray]) -> pd.DataFrame:
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            seg = _segments(h, n_segments)
            order = np.argsort(seg, kind="stable")
            h, c, seg = h[order], c[order], seg[order]
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            rows = []
            for s, e in zip(starts, np.r_[starts[1:], len(seg)]):
                pos = _positions(h[s:e])
                rows.append((int(seg[s]), _pack(pos.ravel()), _pack(pos[c[s:e] > 1].ravel())))
            return pd.DataFrame(rows, columns=["segment", "once", "twice"])

        parts: list[np.ndarray] = []
        held = 0
        for b in batches:
            parts.append(b.iloc[:, 0].to_numpy(dtype=np.int64))
            held += len(b)
            if held >= HASHES_PER_CHUNK:
                yield emit(parts)
                parts, held = [], 0
        if held:
            yield emit(parts)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, once, twice = None, None, None
        for b in batches:
            for seg, o, t in zip(b["segment"], b["once"], b["twice"]):
                if seg != now:
                    if now is not None:
                        yield pd.DataFrame({"segment": [now], "twice": [zlib.compress(twice.tobytes(), 1)]})
                    now, once, twice = seg, np.zeros(SEGMENT_BYTES, np.uint8), np.zeros(SEGMENT_BYTES, np.uint8)
                bits = _unpack(o)
                twice |= _unpack(t) | (once & bits)
                once |= bits
        if now is not None:
            yield pd.DataFrame({"segment": [now], "twice": [zlib.compress(twice.tobytes(), 1)]})

    packed = hashes.mapInPandas(build, "segment int, once binary, twice binary")
    merged = packed.repartition(min(n_segments, SEGMENTS_PER_GROUP), "segment").sortWithinPartitions("segment").mapInPandas(merge, "segment int, twice binary")
    return [(r["segment"], bytes(r["twice"])) for r in merged.collect()]


def maybe_repeated(spark, hash_col: Column, filters: list[tuple[int, bytes]], n_segments: int) -> Column:
    """True where the hash (of the group that the filters were made of) may occur more than once."""
    shared = spark.sparkContext.broadcast(filters)
    cache: dict[int, np.ndarray] = {}

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        if not cache:
            cache.update((seg, np.frombuffer(zlib.decompress(data), np.uint8)) for seg, data in shared.value)
        v = h.to_numpy(dtype=np.int64)
        segments, pos, hit = _segments(v, n_segments), _positions(v), np.zeros(len(v), bool)
        for seg in np.unique(segments).tolist():
            if seg in cache:
                own = np.flatnonzero(segments == seg)
                bits = (cache[seg][pos[own] >> 3] >> (7 - (pos[own] & 7)).astype(np.uint8)) & 1
                hit[own] = bits.all(axis=1)
        return pd.Series(hit)

    return test(hash_col)
