"""Winnowed k-mer seeds of texts, computed for many texts at once with numpy.

Of every w consecutive k-mers the one with the least hash is a seed, so two texts with a common stretch of k + w - 1
characters share at least one seed, whatever surrounds the stretch.
"""

from __future__ import annotations

import numpy as np

_MIX1, _MIX2, _BASE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
#: Characters handled at once; small enough for the arrays to stay in the processor's cache.
CHUNK = 1 << 17
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(17, (n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE)], dtype=np.uint64)
            _powers["down"] = np.cumprod(np.r_[np.uint64(1), np.full(size, inverse)], dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kmer_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """The 64-bit hash of each k-mer of an array of code points (len(a) - k + 1 of them)."""
    n = len(a)
    if n < k:
        return np.empty(0, np.uint64)
    m = a.astype(np.uint64) * _MIX1
    m ^= m >> np.uint64(32)
    m *= _MIX1
    up, down = _power(n + 1)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum(m * up[:n], out=p[1:])
    h = (p[k:] - p[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= _MIX2
    h ^= h >> np.uint64(27)
    return h


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each w neighbours; len(x) - w + 1 values."""
    step, y = 1, x
    while step * 2 <= w:
        y = pick(y[:-step], y[step:])
        step *= 2
    return pick(y[: len(x) - w + 1], y[w - step :][: len(x) - w + 1]) if step < w else y


def seeds(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position, hash) of the seeds of all texts; shorter texts than k + w - 1 have none."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        if not held:
            return
        a = np.concatenate([c for _, c in held])
        lengths = np.array([len(c) for _, c in held])
        h = kmer_hashes(a, k)
        order = (h >> np.uint64(32)).astype(np.uint32)
        starts = np.r_[0, np.cumsum(lengths)]
        # windows that reach into the next text choose nothing
        low = _sliding(order, w, np.minimum)
        inside = np.ones(len(low), bool)
        for e in starts[1:-1]:
            inside[max(0, e - (k + w - 2)) : e] = False
        low[~inside] = 0
        padded = np.r_[np.zeros(w - 1, np.uint32), low, np.zeros(w - 1, np.uint32)]
        at = np.flatnonzero((_sliding(padded, w, np.maximum) == order) & (order > 0))
        which = np.searchsorted(starts, at, "right") - 1
        out.append((np.array([i for i, _ in held])[which], at - starts[which], h[at]))
        held.clear()

    for i, t in enumerate(texts):
        if t is None or len(t) < k + w - 1:
            continue
        c = codes(t)
        if size + len(c) > CHUNK:
            flush()
            size = 0
        held.append((i, c))
        size += len(c)
    flush()
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))
