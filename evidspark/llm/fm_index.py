"""A compressed FM-index over word sequences, searched for many patterns at once.

The Burrows-Wheeler transform of all sequences lies in a wavelet matrix: one packed bit
vector with block counts for each bit of a symbol. A sparse table over the documents
in suffix order tells the smallest document of any interval, so a backward search can
stop where no smaller document is left.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)
        self.zeros = n - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, BitRank]] = []
        for b in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> b & 1).astype(bool)
            self.levels.append((b, BitRank(bits)))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.base = np.zeros(n_symbols, np.int64)
        self.base = self._follow(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, bits in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> b & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol occurs before place at."""
        return self._follow(symbol, at) - self.base[symbol]


def suffix_array(text: np.ndarray, is_end: np.ndarray) -> np.ndarray:
    """Order of all suffixes; every end mark is smaller than all words and differs from the others."""
    n = len(text)
    rank = text.astype(np.int64)
    ends = np.flatnonzero(is_end)
    rank += len(ends)
    rank[ends] = np.arange(len(ends))
    depth = 1
    while True:
        following = np.zeros(n, np.int64)
        following[:-depth] = rank[depth:] + 1
        key = rank * (int(rank.max()) + 2) + following
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        depth *= 2
        if new[-1] == n - 1:
            return order


class FMIndex:
    """Sequences (concatenated symbols 1.., lengths) of documents (non-negative ints)."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, documents: np.ndarray):
        n = len(symbols) + len(lengths)
        self.first = np.cumsum(lengths + 1) - (lengths + 1)
        self.lengths = lengths
        is_end = np.zeros(n, bool)
        is_end[self.first + lengths] = True
        text = np.zeros(n, np.int64)
        text[~is_end] = symbols
        self.text = text
        order = suffix_array(text, is_end)
        n_symbols = int(symbols.max()) + 1
        self.matrix = WaveletMatrix(text[order - 1], n_symbols)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        least = np.repeat(documents, lengths + 1)[order].astype(np.int32)
        self.least = [least]
        step = 1
        while step * 2 <= n:
            least = np.minimum(least[:-step], least[step:])
            self.least.append(least)
            step *= 2

    def smallest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest document of non-empty intervals."""
        out = np.empty(len(lo), np.int32)
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for level in np.unique(k):
            i = np.flatnonzero(k == level)
            table = self.least[level]
            out[i] = np.minimum(table[lo[i]], table[hi[i] - (1 << int(level))])
        return out

    def matched(self, documents: np.ndarray, window: int) -> np.ndarray:
        """Over the text's places: whether a window that starts there also occurs in a smaller document.

        Every sequence is matched from its end backwards for as long as a smaller document is
        left. The reach of that match decides all windows inside it; the search goes on at the
        last end that is still undecided.
        """
        hit = np.zeros(len(self.text) + 1, np.int32)
        end = self.lengths.copy()
        live = np.flatnonzero(end >= window)
        place = end - 1
        symbol = self.text[self.first + np.maximum(place, 0)]
        lo, hi = self.starts[symbol], self.starts[symbol + 1]
        while len(live):
            ok = lo[live] < hi[live]
            good = live[ok]
            ok[ok] = self.smallest(lo[good], hi[good]) < documents[good]
            place[live[ok]] -= 1  # now the next word to take in
            stop = ~ok | (place[live] < 0)
            done = live[stop]
            if len(done):
                fail = place[done]
                reach = end[done] - window - fail  # windows that start at fail + 1 ...
                full = reach > 0
                a = self.first[done[full]] + fail[full] + 1
                np.add.at(hit, a, 1)
                np.add.at(hit, a + reach[full], -1)
                end[done] = np.minimum(end[done] - 1, fail + window)
                again = done[(end[done] >= window) & (fail >= 0)]
                place[again] = end[again] - 1
                c = self.text[self.first[again] + place[again]]
                lo[again], hi[again] = self.starts[c], self.starts[c + 1]
            else:
                again = done
            on = live[~stop]
            if len(on):
                c = self.text[self.first[on] + place[on]]
                both = self.matrix.rank(np.concatenate([c, c]), np.concatenate([lo[on], hi[on]]))
                lo[on], hi[on] = self.starts[c] + both[: len(on)], self.starts[c] + both[len(on) :]
            live = np.concatenate([on, again])
        return np.cumsum(hit[:-1]) > 0
