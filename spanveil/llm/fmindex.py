"""FM-index over integer sequences: suffix order, wavelet matrix over the BWT, sampled suffix positions."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of a symbol in a prefix, for whole arrays of symbols and prefixes at once."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.levels = []
        self.bits = max(1, int(top).bit_length())
        rest = symbols
        for level in range(self.bits - 1, -1, -1):
            ones = ((rest >> level) & 1).astype(bool)
            before = np.zeros(len(rest) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(rest) - int(before[-1])
            self.levels.append((level, before, zeros))
            rest = np.concatenate([rest[~ones], rest[ones]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        begin = np.zeros(len(symbol), np.int64)
        end = end.astype(np.int64)
        for level, before, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            low, high = before[begin], before[end]
            begin = np.where(one, zeros + low, begin - low)
            end = np.where(one, zeros + high, end - high)
        return end - begin


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; every 0 is a separator that differs from all others."""
    n = len(text)
    apart = int((text == 0).sum())
    rank = text.astype(np.int64) + apart
    rank[text == 0] = np.arange(apart)
    step, order = 1, np.argsort(rank, kind="stable")
    while True:
        key = rank * (n + apart + int(text.max()) + 2)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = fresh
        if rank.max() == n - 1 or step >= n:
            return order
        step *= 2
        apart = 0


class FMIndex:
    """Finds all places of many short patterns in a text of symbols 1..top, in which 0 separates segments."""

    def __init__(self, text: np.ndarray, top: int, sample: int = 16) -> None:
        order = suffix_order(text)
        self.bwt = text[order - 1]
        counts = np.bincount(text, minlength=top + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.wavelet = WaveletMatrix(self.bwt, top)
        # A walk back from any suffix ends at a sampled place: a multiple of ``sample`` or the start of a segment.
        starts = np.concatenate([[True], text[:-1] == 0])
        keep = (order % sample == 0) | starts[order]
        self.sampled = keep
        self.sample_at = np.cumsum(keep) - 1
        self.samples = order[keep]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of patterns of one length (rows); the range of suffixes of each."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.bwt), np.int64)
        alive = np.arange(len(patterns))
        for step in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, step]
            low[alive] = self.first[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.wavelet.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each suffix, by walking back to a sampled one."""
        place = np.zeros(len(rows), np.int64)
        row, steps, open_ = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(open_):
            here = row[open_]
            done = self.sampled[here]
            ended = open_[done]
            place[ended] = self.samples[self.sample_at[row[ended]]] + steps[ended]
            open_, here = open_[~done], here[~done]
            symbol = self.bwt[here]
            row[open_] = self.first[symbol] + self.wavelet.rank(symbol, here)
            steps[open_] += 1
        return place
