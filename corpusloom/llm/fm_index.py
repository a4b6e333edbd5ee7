"""A compressed full-text index over words: the Burrows-Wheeler transform in a wavelet tree, searched backwards.

The order of suffixes, and so the length of a match, is bounded by ``depth`` words.
"""

from __future__ import annotations

import numpy as np


class RankBits:
    """Bits in words of 64 with the ones before each word: how many ones stand before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]))]).astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """A sequence of numbers below ``size`` as one bit vector per bit (a wavelet tree without pointers)."""

    def __init__(self, values: np.ndarray, size: int):
        self.levels: list[tuple[int, RankBits]] = []
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bits = (values >> bit) & 1 == 1
            self.levels.append((bit, RankBits(bits)))
            values = np.concatenate([values[~bits], values[bits]])
        symbols = np.arange(size)
        self.first = self.descend(symbols, np.zeros(size, np.int64))  # where each number's rows begin below

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> bit) & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before the place ``at``."""
        return self.descend(symbol, at) - self.first[symbol]


def dense(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ranks of the pairs, from 0 without gaps."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def bounded_ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each suffix by its first ``depth - 1`` and ``depth`` words, by prefix doubling; 0 stands behind the end."""

    def shifted(ranks: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([ranks[by:] + 1, np.zeros(min(by, len(ranks)), np.int64)])

    words = np.unique(text, return_inverse=True)[1]
    power, width, short, done = words, 1, np.zeros(len(text), np.int64), 0
    while done < depth - 1:
        if (depth - 1) & width:
            short = dense(short, shifted(power, done)) if done else power
            done += width
        if done < depth - 1:
            power = dense(power, shifted(power, width))
            width *= 2
    return short, dense(short, shifted(words, depth - 1)) if depth > 1 else words


class FMIndex:
    """``text``: numbers from 1 to ``size - 1``, and 0 between what must not match across. ``depth``: words of a match at most."""

    def __init__(self, text: np.ndarray, size: int, depth: int):
        self.text, self.size, self.depth = text, size, depth
        short, full = bounded_ranks(text, depth)
        self.order = np.argsort(full, kind="stable")
        edge = lambda ranks: np.flatnonzero(np.diff(ranks[self.order], prepend=-1))
        self.short_edges, self.edges = edge(short), edge(full)  # where the classes of depth - 1 and depth words begin
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.tree = WaveletTree(text[self.order - 1], size)
        self._alike: np.ndarray | None = None

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of symbol + match, from the rows of the match."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.before[symbol], 2)
        return both[: len(symbol)], both[len(symbol) :]

    def alike(self) -> np.ndarray:
        """How many words (``depth`` at most) each row has in common with the one before; -1 at both ends."""
        if self._alike is None:
            n, padded = len(self.text), np.concatenate([self.text, np.full(self.depth, -1)])
            out, live = np.zeros(n + 1, np.int64), np.arange(1, n)
            for k in range(self.depth):
                live = live[(same := padded[self.order[live] + k] == padded[self.order[live - 1] + k])] if len(live) else live
                out[live] += 1
            out[0] = out[n] = -1
            self._alike = out
        return self._alike

    def widen(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next wider range of rows that share a shorter match, and its length; -1 where all rows were in it."""
        alike = self.alike()
        length = np.maximum(alike[low], alike[high])
        low, high = low.copy(), high.copy()
        for each in np.unique(length[length >= 0]):
            edges, own = np.flatnonzero(alike < each), length == each
            low[own] = edges[np.searchsorted(edges, low[own], side="right") - 1]
            high[own] = edges[np.searchsorted(edges, high[own])]
        return low, high, length

    def matching_statistics(self, texts: np.ndarray, lengths: np.ndarray):
        """For each place of ``texts`` (a row each, ``lengths`` descending), from the last to the first: ``(place from the end,
        length of the longest match that begins there, its rows low and high)`` for the texts that reach so far.

        All texts advance together. A match of ``depth`` words first loses its last one; a match that
        cannot be extended is widened until it can, or is empty.
        """
        n = len(self.text)
        low, high, length = np.zeros(len(lengths), np.int64), np.full(len(lengths), n), np.zeros(len(lengths), np.int64)
        for back in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -back))  # lengths > back
            low, high, length = low[:live], high[:live], length[:live]
            symbol = texts[np.arange(live), lengths[:live] - 1 - back]
            full = length == self.depth
            at = np.searchsorted(self.short_edges, low[full], side="right")
            low[full], high[full] = self.short_edges[at - 1], np.append(self.short_edges, n)[at]
            length[full] -= 1
            new_low, new_high = self.extend(symbol, low, high)
            failed = np.flatnonzero(new_high <= new_low)
            while len(failed):
                low[failed], high[failed], length[failed] = self.widen(low[failed], high[failed])
                none = failed[length[failed] < 0]
                low[none], high[none], length[none], new_low[none], new_high[none] = 0, n, -1, 0, n
                failed = failed[length[failed] >= 0]
                new_low[failed], new_high[failed] = self.extend(symbol[failed], low[failed], high[failed])
                failed = failed[new_high[failed] <= new_low[failed]]
            low, high, length = new_low, new_high, length + 1
            yield back, length, low, high
