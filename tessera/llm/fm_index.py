"""A compressed FM-index over integer symbols: Burrows-Wheeler transform in a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np

U = np.uint64


class WaveletMatrix:
    """rank(symbol, i) = how often the symbol is among the first i, for arrays of both."""

    def __init__(self, text: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        have = text
        for level in range(self.levels - 1, -1, -1):
            bit = (have >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.append(packed, np.zeros(-len(packed) % 8 + 8, np.uint8)).view(U)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32))
            self.zeros.append(int(len(have) - bit.sum()))
            have = np.concatenate([have[bit == 0], have[bit == 1]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (U(1) << (i & 63).astype(U)) - U(1)
        return self.counts[k][word] + np.bitwise_count(self.bits[k][word] & mask)

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks at lo and hi."""
        n = len(lo)
        at = np.concatenate([lo, hi, np.zeros(n, np.int64)])
        sym = np.concatenate([symbol, symbol, symbol])
        for k in range(self.levels):
            bit = (sym >> (self.levels - 1 - k)) & 1
            ones = self._ones(k, at)
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at[:n] - at[2 * n :], at[n : 2 * n] - at[2 * n :]


class FMIndex:
    """Index of texts (runs of symbols, none across two) for backward search of strings up to depth symbols.

    Suffixes are sorted by their first depth symbols, by doubling. before(lo) of the transform maps the range of a string of
    less than depth symbols to that of the string with one more in front.
    """

    def __init__(self, text: np.ndarray, size: np.ndarray, depth: int):
        """text: symbols from 0 to alphabet - 1, run after run; depth: 2 at least."""
        assert depth > 1
        self.depth = depth
        n, runs = len(text), len(size)
        end = np.cumsum(size) + np.arange(runs)
        t = np.zeros(n + runs + depth, np.int64)  # 0 ends each run
        inside = np.ones(n + runs, bool)
        inside[end] = False
        t[: n + runs][inside] = text + 1
        self.where = np.flatnonzero(inside)  # place in t of each symbol
        m = n + runs
        short = self._ranks(t, m, depth - 1)
        full = self._ranks(t, m, depth)
        sa = np.argsort(full, kind="stable")
        self.sa = sa
        self.transform = t[sa - 1] if m else t[:0]
        self.transform[sa == 0] = 0
        alphabet = int(t.max()) + 1 if m else 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t[:m], minlength=alphabet))])
        self.matrix = WaveletMatrix(self.transform, alphabet)
        edge = np.ones(m + 1, bool)
        edge[1:-1] = short[sa][1:] != short[sa][:-1]
        self.wide = np.flatnonzero(edge)  # ranges of strings of depth - 1 symbols
        self.of = np.cumsum(edge[:-1]) - 1
        edge = edge.copy()
        edge[1:-1] = full[sa][1:] != full[sa][:-1]
        self.narrow = np.flatnonzero(edge)
        self.of_narrow = np.cumsum(edge[:-1]) - 1

    @staticmethod
    def _ranks(t: np.ndarray, m: int, depth: int) -> np.ndarray:
        rank, h = t.copy(), 1
        while h < depth:
            longer = min(2 * h, depth)
            pair = rank[: m] * np.int64(len(t) + int(t.max()) + 2)
            pair += rank[longer - h : m + longer - h] if longer - h + m <= len(rank) else np.append(rank[longer - h :], np.zeros(longer - h + m - len(rank), np.int64))
            _, inverse = np.unique(pair, return_inverse=True)
            rank = np.zeros(len(t), np.int64)
            rank[:m] = inverse + 1
            h = longer
        return rank[:m]

    def stream(self, text: np.ndarray, size: np.ndarray):
        """Matching statistics of runs (their symbols as in the index), all runs in step from their ends backward, cut at depth.

        Yields (runs, position from the run's end, lo, hi): the range of the depth symbols that begin there, for the runs in which
        they occur. A run whose next symbols don't occur begins anew one symbol further on.
        """
        n = len(self.sa)
        at = np.cumsum(size)  # end of each run
        back = np.zeros(len(size), np.int64)  # symbols read so far, counted from the end
        have = np.zeros(len(size), np.int64)  # of them in the string
        lo, hi = np.zeros(len(size), np.int64), np.full(len(size), n, np.int64)
        live = np.flatnonzero(size >= self.depth)
        while len(live):
            full = live[have[live] == self.depth]
            of = self.of[lo[full]]  # drop the last symbol
            lo[full], hi[full], have[full] = self.wide[of], self.wide[of + 1], self.depth - 1
            back[live] += 1
            c = text[at[live] - back[live]] + 1
            a, b = self.matrix.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.first[c] + a, self.first[c] + b
            have[live] += 1
            lost = live[lo[live] >= hi[live]]
            back[lost] -= have[lost] - 1  # this string doesn't occur; begin anew, one symbol before its last
            have[lost], lo[lost], hi[lost] = 0, 0, n
            hit = live[have[live] == self.depth]
            if len(hit):
                yield hit, back[hit], lo[hit], hi[hit]
            live = live[back[live] - have[live] + self.depth <= size[live]]
            live = live[back[live] < size[live]]
