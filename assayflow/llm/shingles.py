"""Word and shingle hashing on whole texts, for tasks that work on Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
#: A task forgets its word hashes beyond this many, so that its memory stays bounded.
WORDS_HELD = 200_000
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_AGAIN = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen so far."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_in(text: str | None, lower: bool = True) -> list[bytes]:
    """Words of a text as UTF-8; lower-cases A-Z alone, as bytes know no other letters."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for every run of ``width`` neighbouring words."""
    last = len(hashes) - width + 1
    out = np.full(last, width, np.uint64)
    for k in range(width):
        out ^= hashes[k : k + last]
        out *= _MULTIPLY
        out ^= out >> _HALF
        out *= _AGAIN
    return out ^ (out >> _HALF)


def shingle_set(text: str | None, held: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted different shingle hashes; a shorter text has its whole word sequence as its only shingle."""
    words = words_in(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(chained(held.of(words), min(width, len(words))))
