"""Words as the project defines them, and numeric fingerprints of them.

A word is an unbroken run of letters and digits, compared in lower case after
composing accents (Unicode NFC).
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
CACHE_WORDS = 400_000


def fold(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


def words(text: str | None) -> list[str]:
    return WORD.findall(unicodedata.normalize("NFC", text).lower()) if text else []


class WordHashes(dict):
    """word -> stable 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = h
        return h

    def of(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of each run of ``k`` words (not distinct)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += hashes[j : n + j]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out
