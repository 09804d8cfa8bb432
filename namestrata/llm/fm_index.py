"""A compressed full-text index over word numbers: wavelet matrix, backward search, parent step."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max


class BitRank:
    """A bit vector in 64-bit words with the ones before each word; rank by population count."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, dtype=np.uint8)])
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit per symbol and level."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.rows: list[tuple[BitRank, int]] = []
        for level in reversed(range(self.levels)):
            bits = (sequence >> level & 1).astype(bool)
            self.rows.append((BitRank(bits), int(len(bits) - bits.sum())))
            sequence = np.concatenate([sequence[~bits], sequence[bits]])
        every = np.arange(symbols)
        self.first = self._descend(every, np.zeros(symbols, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in zip(reversed(range(self.levels)), self.rows):
            ones = bits.ones(i)
            i = np.where(symbol >> level & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._descend(symbol, i) - self.first[symbol]


def joined_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (a, b)."""
    key = a * (b.max(initial=0) + 1) + b
    order = np.argsort(key)
    ordered = key[order]
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return out


def shifted(ranks: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([ranks[by:] + 1, np.zeros(min(by, len(ranks)), dtype=np.int64)])


class FMIndex:
    """Index of sequences of word numbers (from 1) for matches of up to ``width`` words.

    ``owners`` holds a document number for each sequence. Suffixes are sorted by their first
    ``width`` symbols, which backward search up to that length never looks beyond. For the
    interval of a match of ``width`` words the index knows the smallest owner.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, owners: np.ndarray, symbols: int, width: int):
        self.width, n = width, len(words) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[ends] = False
        text[inside] = words
        power, ranks = 1, {1: joined_ranks(text, np.zeros_like(text))}
        while 2 * power <= width:
            ranks[2 * power] = joined_ranks(ranks[power], shifted(ranks[power], power))
            power *= 2

        def of_length(k):
            if not k:
                return np.zeros_like(text)
            p = max(q for q in ranks if q <= k)
            return ranks[p] if p == k else joined_ranks(ranks[p], shifted(ranks[p], k - p))

        full, shorter = of_length(width), of_length(width - 1)
        order = np.argsort(full)
        self.symbols = symbols
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.tree = WaveletMatrix(text[order - 1], symbols)
        #: Interval of the suffixes that share the first width - 1 words, by position in order.
        shorter = shorter[order]
        starts = np.flatnonzero(np.concatenate([[True], shorter[1:] != shorter[:-1]]))
        number = np.cumsum(np.concatenate([[0], shorter[1:] != shorter[:-1]]))
        self.parent_low = starts[number]
        self.parent_high = np.concatenate([starts[1:], [n]])[number]
        owner = np.repeat(owners, lengths + 1)[order]
        full = full[order]
        starts = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]]))
        least = np.minimum.reduceat(owner, starts)
        self.least = np.repeat(least, np.diff(np.concatenate([starts, [n]])))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more word in front."""
        return (
            self.before[symbol] + self.tree.rank(symbol, low),
            self.before[symbol] + self.tree.rank(symbol, high),
        )

    def search(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the ``width`` words from each start; empty where a word is unknown (0)."""
        low = np.zeros(len(starts), dtype=np.int64)
        high = np.full(len(starts), len(self.least), dtype=np.int64)
        for k in reversed(range(self.width)):
            symbol = words[starts + k]
            low, high = self.extend(symbol, low, high)
            high = np.where(symbol > 0, high, low)
        return low, high

    def least_owners(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For the start of every window of ``width`` words within the queried sequences: the
        smallest owner of an indexed sequence that contains it, or NONE.

        Sequences are read from their ends in step. A match of full width drops its last word
        (the parent interval) and takes the word before it, so each window after the first
        costs one step; where a match breaks off, the next window is searched anew.
        """
        out = np.full(len(words), NONE, dtype=np.int64)
        first = np.cumsum(lengths) - lengths
        windows = lengths - self.width + 1
        order = np.argsort(-windows, kind="stable")
        order = order[windows[order] > 0]
        left = windows[order]
        at = first[order] + left - 1
        low = np.zeros(len(order), dtype=np.int64)
        high = np.zeros(len(order), dtype=np.int64)
        step = 0
        while True:
            live = int(np.searchsorted(-left, -step, side="left"))
            if not live:
                break
            at, low, high = at[:live], low[:live], high[:live]
            new = np.empty((2, live), dtype=np.int64)
            goes = high > low
            if goes.any():
                kept = low[goes]
                new[:, goes] = self.extend(words[at[goes]], self.parent_low[kept], self.parent_high[kept])
                new[1, goes] = np.where(words[at[goes]] > 0, new[1, goes], new[0, goes])
            if not goes.all():
                new[:, ~goes] = self.search(words, at[~goes])
            low, high = new
            found = high > low
            out[at[found]] = self.least[low[found]]
            at = at - 1
            step += 1
        return out
