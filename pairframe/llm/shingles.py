"""Word shingles of whole texts as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
CACHED_WORDS = 400_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hash per word, kept between texts; emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


WORDS = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words between ASCII white space, A-Z lower-cased (null: none)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(WORDS.__getitem__, words), _U, len(words))


def roll(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of `width` consecutive items, in order."""
    n = len(hashes) - width + 1
    total = np.full(n, width, _U)
    with np.errstate(over="ignore"):
        for i in range(width):
            total = mix(total * _U(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return total


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, no words are none."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(roll(words, min(width, len(words))))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
