"""Sets of word shingles, and their minima under many hash functions, for batches of texts."""

from __future__ import annotations

import numpy as np

#: Words of a shingle at most.
MOST_WORDS = 32
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, MOST_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, for n places."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        steps = np.full(size, _BASE & _MASK, np.uint64), np.full(size, _INVERSE, np.uint64)
        for s in steps:
            s[0] = 1
        _powers = tuple(np.multiply.accumulate(s) for s in steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes, the same for the same bytes."""
    up, down = _power_tables(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw], [True]])))
    start, end = edge[::2], edge[1::2]
    return range_hashes(raw, start, end)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``size`` words; with fewer words, one for all of them; none without words."""
    words = word_hashes(text or "")
    if len(words) == 0:
        return words
    if len(words) < size:
        h = np.uint64(len(words))
        for w in words:
            h = mix(np.array([h]) * _PLACE[0] + w)[0]
        return np.array([h], np.uint64)
    h = words[: len(words) - size + 1] * _PLACE[0]
    for k in range(1, size):
        h = h + words[k : len(words) - size + 1 + k] * _PLACE[k]
    return np.unique(mix(h))


class MinHash:
    """Lanes: for each of ``lanes`` hash functions, the upper 32 bits of the least hash in a set."""

    def __init__(self, lanes: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(1, 1 << 63, lanes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mask = rng.integers(0, 1 << 63, lanes, dtype=np.uint64)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of lanes for each set; none may be empty."""
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((len(sets), len(self.factor)), np.uint32)
        for k, (f, m) in enumerate(zip(self.factor, self.mask, strict=True)):
            x = (flat ^ m) * f
            out[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), starts) >> np.uint64(32)
        return out
