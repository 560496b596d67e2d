"""Suffix arrays and a full-text index over integer sequences."""

from __future__ import annotations

import numpy as np


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of t in order, by prefix doubling. Shorter suffixes come before those that they begin."""
    n = len(t)
    _, rank = np.unique(t, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    k = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - k)] = rank[k:]
        key = rank * (n + 2) + follow
        sa = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate(([True], np.diff(key[sa]) != 0))) if n else np.zeros(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[sa] = new
        if not n or new[-1] == n:
            return sa
        k *= 2


class WaveletMatrix:
    """Rank and access over a sequence of small integers, a bit plane for each binary digit."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.ones, self.bit, self.zeros = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            b = (s >> level) & 1
            self.bit.append(b.astype(np.uint8))
            self.ones.append(np.concatenate(([0], np.cumsum(b))).astype(np.int32))
            self.zeros.append(int(len(s) - b.sum()))
            s = np.concatenate((s[b == 0], s[b == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] stands before position i[k]."""
        start = np.zeros(len(c), np.int64)
        for k, (ones, z) in enumerate(zip(self.ones, self.zeros, strict=True)):
            on = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            i, start = (np.where(on, z + ones[x], x - ones[x]) for x in (i, start))
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for bit, ones, z in zip(self.bit, self.ones, self.zeros, strict=True):
            on = bit[i]
            c = c * 2 + on
            i = np.where(on == 1, z + ones[i], i - ones[i])
        return c


class FMIndex:
    """Backward search and located occurrences over t, whose values are 1 or more."""

    def __init__(self, t: np.ndarray, sample: int = 8):
        t = np.concatenate((np.asarray(t, np.int64), [0]))
        sa = suffix_array(t)
        top = int(t.max()) + 1
        self.below = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=top))))
        self.top = top
        self.wavelet = WaveletMatrix(t[sa - 1], max(1, int(top).bit_length()))
        marked = sa % sample == 0
        self.marked = marked
        self.before = np.concatenate(([0], np.cumsum(marked)))
        self.sampled = sa[marked]
        self.n = len(t)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of patterns, the range of index rows whose suffixes begin with it."""
        m, length = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        alive = np.arange(m)
        for k in range(length - 1, -1, -1):
            c = patterns[alive, k]
            fits = c < self.top
            lo[alive[~fits]] = hi[alive[~fits]] = 0
            alive, c = alive[fits], c[fits]
            lo[alive] = self.below[c] + self.wavelet.rank(c, lo[alive])
            hi[alive] = self.below[c] + self.wavelet.rank(c, hi[alive])
            alive = alive[hi[alive] > lo[alive]]
            if not len(alive):
                break
        dead = np.ones(m, bool)
        dead[alive] = False
        lo[dead] = hi[dead] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows: steps back to the nearest sampled suffix."""
        rows = rows.astype(np.int64).copy()
        out, steps, open_ = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            done = self.marked[at]
            ready = open_[done]
            out[ready] = self.sampled[self.before[rows[ready]]] + steps[ready]
            open_ = open_[~done]
            at = rows[open_]
            c = self.wavelet.access(at)
            rows[open_] = self.below[c] + self.wavelet.rank(c, at)
            steps[open_] += 1
        return out
