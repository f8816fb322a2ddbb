"""Words, word hashes and word shingles as NumPy arrays."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
MASK = (1 << 64) - 1
#: Odd multipliers, one for each place in a shingle, are powers of this one.
STEP = 0x9E3779B97F4A7C15


class HashCache(dict):
    """Word -> the eight bytes of its hash; emptied when it is full, so that it stays small on any text."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 60_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_digest(word.encode("utf-8", "replace"))
        return value


HASHES = HashCache()


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


def word_hashes(text: str | None) -> np.ndarray:
    return np.frombuffer(b"".join(map(HASHES.__getitem__, words_of(text))), np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash of every run of ``size`` words, in order; of all words where there are fewer; none without words."""
    n = min(size, len(hashes))
    if not n:
        return np.zeros(0, np.uint64)
    total, factor = np.full(len(hashes) - n + 1, n, np.uint64), 1
    for place in range(n):
        factor = factor * STEP & MASK
        total += hashes[place : len(hashes) - n + 1 + place] * np.uint64(factor)
    return mix(total)


def shingles_of(texts: list[np.ndarray], size: int = 5) -> list[np.ndarray]:
    """``shingles`` of each of several texts, computed in one go."""
    lengths = np.array([len(x) for x in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat = shingles(np.concatenate([*texts, np.zeros(size, np.uint64)]), size)
    return [flat[a : a + n - size + 1] if n >= size else shingles(x, size) for x, a, n in zip(texts, starts, lengths)]
