"""Words ``[^\\x20\\x09-\\x0D]+`` of whole texts, as 64-bit hashes, and what a Python worker keeps.

``bytes.split`` without an argument splits at exactly these six bytes and ``bytes.lower`` changes
A-Z alone. Words repeat, so each distinct word is hashed once per worker and kept in a table of
bounded size.
"""

from __future__ import annotations

import numpy as np
import xxhash

_held: dict = {}


def held(key, make):
    """What ``make`` returns, kept by the worker under ``key``. Spark reuses workers, so later tasks of
    the same operator find it; a worker keeps one such thing, and that of another operator goes."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def bounded(batches, rows: int = 512):
    """The same rows in small batches, so that what Python makes of one batch stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


class Hashes(dict):
    """word -> 64-bit hash in two generations of at most ``limit`` words: when the young one is full it
    becomes the old one, so words that go on occurring stay."""

    def __init__(self, limit: int = 1 << 17, seed: int = 0):
        self.limit, self.seed, self.old = limit, seed, {}

    def __missing__(self, word: bytes) -> int:
        h = self.old.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word, seed=self.seed)
            if len(word) > 64:
                return h
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def hashes() -> Hashes:
    return held("hashes", Hashes)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence when it is shorter."""
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(h) if len(h) < k else k, np.uint64)
    for i in range(min(k, len(h))):
        out = mix(out * _ODD + h[i : i + n])
    return np.unique(out)
