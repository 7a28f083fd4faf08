"""A compressed FM-index over word numbers: wavelet matrix of the transform, backward search for many patterns at once."""

from __future__ import annotations

import numpy as np

#: Suffixes are sorted by this many words, which is enough for patterns up to this length.
DEPTH = 64


class BitRank:
    """A bit vector in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        filled = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        filled[: len(bits)] = bits
        self.words = np.packbits(filled, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32)

    def ones(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        at = places >> 6
        mask = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class Wavelet:
    """Rank of any symbol in a sequence, by one bit vector per bit of the symbols."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels: list[tuple[int, int, BitRank]] = []
        rest = sequence
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (rest >> bit) & 1
            self.levels.append((bit, len(rest) - int(ones.sum()), BitRank(ones)))
            rest = np.concatenate([rest[ones == 0], rest[ones == 1]])
        every = np.arange(symbols)
        self.base = self._down(every, np.zeros(symbols, np.int64))

    def _down(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for bit, zeros, rank in self.levels:
            ones = rank.ones(places)
            places = np.where((symbols >> bit) & 1, zeros + ones, places - ones)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._down(symbols, places) - self.base[symbols]


class FMIndex:
    """Pieces of word numbers (from 1 up), each followed by the terminator 0, with an owner for each piece."""

    def __init__(self, pieces: list[np.ndarray], owners: np.ndarray, window: int):
        lengths = np.array([len(p) for p in pieces])
        self.window = window
        text = np.zeros(int((lengths + 1).sum()), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        inside = np.ones(len(text), bool)
        inside[self.starts + lengths] = False
        _, numbers = np.unique(np.concatenate(pieces), return_inverse=True)
        text[inside] = numbers + 1
        self.text = text
        self.symbols = int(text.max()) + 1
        order, short = self._sorted(text)
        self.wavelet = Wavelet(text[order - 1], self.symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))[:-1]])
        owner = np.repeat(owners, lengths + 1)[order]
        whole = self._edges(order, short, window)
        self.block = np.cumsum(whole) - 1
        self.least = np.minimum.reduceat(owner, np.flatnonzero(whole))
        less = self._edges(order, short, window - 1)
        begins = np.flatnonzero(less)
        group = np.cumsum(less) - 1
        self.low, self.high = begins[group], np.append(begins[1:], len(text))[group]

    def _sorted(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of their next DEPTH words, and the ranks of places by half as many."""
        rank, size, short = text, 1, None
        while size < DEPTH:
            after = np.zeros_like(rank)
            after[:-size] = rank[size:] + 1
            key = rank * (int(after.max()) + 1) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.empty_like(rank)
            fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank, size = fresh, size * 2
            if size == DEPTH // 2:
                short = rank
        return order, short

    def _edges(self, order: np.ndarray, short: np.ndarray, length: int) -> np.ndarray:
        """True where a suffix differs from the one before it within ``length`` words, DEPTH / 2 <= length <= DEPTH."""
        later = np.minimum(order + length - DEPTH // 2, len(order) - 1)
        same = (short[order[1:]] == short[order[:-1]]) & (short[later[1:]] == short[later[:-1]])
        return np.concatenate([[True], ~same])

    def least_owner(self, pieces: np.ndarray) -> list[np.ndarray]:
        """For each of these pieces of the index, per window start: the smallest owner of an occurrence of that window.

        All pieces are searched at once from their right ends. Once a match is a window long, its interval widens to
        that of its first ``window - 1`` words, and the next word to the left brings it to a window again, so a piece
        takes one backward step per word.
        """
        ends = np.append(self.starts[1:], len(self.text))[pieces] - 1
        lengths = ends - self.starts[pieces]
        by_length = np.argsort(-lengths, kind="stable")
        ends, lengths = ends[by_length], lengths[by_length]
        low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(self.text), np.int64)
        found: list[np.ndarray] = []
        for step in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -step, side="left"))
            low, high = low[:n], high[:n]
            if step >= self.window:
                low, high = self.low[low], self.high[low]
            symbol = self.text[ends[:n] - 1 - step]
            start = self.first[symbol]
            low, high = start + self.wavelet.rank(symbol, low), start + self.wavelet.rank(symbol, high)
            if step >= self.window - 1:
                found.append(self.least[self.block[low]])
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(pieces)
        for place, original in enumerate(by_length):
            windows = int(lengths[place]) - self.window + 1
            out[original] = np.array([found[windows - 1 - k][place] for k in range(windows)], np.int64)
        return out
