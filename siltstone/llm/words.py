"""Words, word shingles and their 64-bit hashes, many texts at a time."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64's fixed multipliers


class WordHashes(dict):
    """Stable 64-bit hash of each word, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def hash_words(words: list[str], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbouring words, in order."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for k in range(1, width):
        acc = mix(acc) + h[k : k + n]
    return mix(acc)


def shingle_set(text: str, known: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words of a text, lower-cased."""
    return np.unique(windows(hash_words(WORD.findall(text.lower()), known), width))
