"""A run-length index of sequences of 64-bit words: run-compressed Burrows-Wheeler transform with sampled run ends.

Matching statistics are streamed by backward steps for many queries at once.  Where a step leaves the current run, the
row jumps to the end of the run before or the start of the run after that has the wanted word, whichever shares the
longer prefix (thresholds decide), and takes that run end's suffix-array sample.  The sample is a place in the indexed
text at which the longest match of the query's position begins.
"""

from __future__ import annotations

import numpy as np

from cairngraph.llm._text import mix64

_B = np.uint64(0x9E3779B97F4A7C15)
_BI = np.uint64(pow(int(_B), -1, 1 << 64))


def window_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` words (len - size + 1 values)."""
    n = len(x)
    if n < size:
        return np.zeros(0, np.uint64)
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _B, np.uint64)])
    back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _BI, np.uint64)])
    h = np.r_[np.uint64(0), np.cumsum(mix64(x) * power[:n])]
    return mix64((h[size:] - h[:-size]) * back[: n - size + 1])


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, longest common prefix of each suffix and the one before) by prefix doubling; t must have a unique last value."""
    n = len(t)
    _, rank = np.unique(t, return_inverse=True)
    ranks, k = [rank.astype(np.int64)], 1
    while True:
        rank = ranks[-1]
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
        ranks.append(new)
        k *= 2
        if new[order[-1]] == n - 1 or k >= n:
            break
    sa = np.argsort(ranks[-1])
    lcp = np.zeros(n, np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 2, -1, -1):
        inside = np.flatnonzero(np.maximum(a, b) < n)
        r = ranks[level]
        same = inside[r[a[inside]] == r[b[inside]]]
        common[same] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    lcp[1:] = common
    return sa, lcp


def _range_argmin(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Position of the least value (the first one) of each non-empty range [low, high)."""
    key = (values.astype(np.int64) << 32) | np.arange(len(values))
    size = high - low
    level = np.floor(np.log2(size)).astype(np.int64)
    out = np.zeros(len(low), np.int64)
    for p in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == p)
        if len(at):
            out[at] = np.minimum(key[low[at]], key[high[at] - (1 << p)]) & 0xFFFFFFFF
        if len(key) > 1 << p:
            key = np.minimum(key[: -(1 << p)], key[1 << p :])
    return out


class RunLengthIndex:
    """Index of pieces (sequences of words); ``owner`` gives a value for each place of each piece."""

    def __init__(self, pieces: list[np.ndarray], owners: list[np.ndarray]):
        seps = len(pieces)
        size = np.array([len(p) for p in pieces])
        n = int(size.sum()) + seps
        end = np.cumsum(size + 1) - 1  # places of the separators, each unique and smaller than any word
        word = np.ones(n, bool)
        word[end] = False
        flat = np.concatenate(pieces)
        self.alphabet, ids = np.unique(flat, return_inverse=True)
        t = np.empty(n, np.int64)
        t[word] = ids + seps
        t[end] = np.arange(seps)[::-1]
        sa, lcp = suffix_array(t)
        bwt = t[sa - 1]
        start = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        self.seps, self.n = seps, n
        self.start, self.stop = start, np.r_[start[1:], n]
        self.char = bwt[start]
        sigma = seps + len(self.alphabet)
        self.order = np.argsort(self.char, kind="stable")
        self.runs = len(start)
        self.bound = np.searchsorted(self.char[self.order], np.arange(sigma + 1))
        length = (self.stop - start)[self.order]
        self.lf = np.empty(self.runs, np.int64)
        self.lf[self.order] = np.cumsum(length) - length  # rows of smaller words and of earlier runs of the same word
        self.by_char = self.char[self.order] * (self.runs + 1) + self.order
        self.first_sample, self.last_sample = sa[start], sa[self.stop - 1]
        self.threshold = np.zeros(self.runs, np.int64)
        if self.runs > 1:
            prev, cur = self.order[:-1], self.order[1:]
            pair = np.flatnonzero(self.char[prev] == self.char[cur])
            self.threshold[pair + 1] = _range_argmin(lcp, self.stop[prev[pair]], start[cur[pair]] + 1)
        self.words = np.empty(n, np.uint64)
        self.words[word] = flat
        self.words[end] = mix64(np.arange(seps, dtype=np.uint64) + np.uint64(0xABCDEF0123))
        self.owner = np.full(n, -1, np.int64)
        self.owner[word] = np.concatenate(owners)
        self.windows: dict[int, np.ndarray] = {}

    def _ids(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + self.seps, -1)

    def places(self, pieces: list[np.ndarray], longest: int, overlap: int) -> list[np.ndarray]:
        """For each position of each piece, a place where its longest match starts; -1 if its word doesn't occur.

        Lanes are at most ``longest`` positions and see ``overlap`` words more, so a match of up to ``overlap`` + 1
        words is found as in the whole piece.
        """
        flat = self._ids(np.concatenate(pieces))
        result = np.full(len(flat), -1, np.int64)
        size = np.array([len(p) for p in pieces])
        base = np.cumsum(size) - size
        lanes = (size + longest - 1) // longest
        piece = np.repeat(np.arange(len(pieces)), lanes)
        k = np.arange(len(piece)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first = base[piece] + k * longest
        last = np.minimum(first + longest, base[piece] + size[piece])
        seen = np.minimum(last + overlap, base[piece] + size[piece])
        steps = seen - first
        by_size = np.argsort(-steps, kind="stable")
        last, seen, steps = last[by_size], seen[by_size], steps[by_size]
        active = len(steps)
        row = np.zeros(active, np.int64)
        ptr = np.zeros(active, np.int64)
        fresh = np.ones(active, bool)
        for s in range(int(steps.max(initial=0))):
            active = int(np.searchsorted(-steps, -s, "left"))
            pos = seen[:active] - 1 - s
            c = flat[pos]
            known = c >= 0
            r = row[:active]
            run = np.searchsorted(self.start, r, "right") - 1
            stay = known & ~fresh[:active] & (self.char[run] == c)
            jump = np.flatnonzero(known & ~stay)
            p = ptr[:active]
            if len(jump):
                cj = c[jump]
                j = np.searchsorted(self.by_char, cj * (self.runs + 1) + run[jump])
                has_next, has_prev = j < self.bound[cj + 1], j > self.bound[cj]
                prev = has_prev & (~has_next | (r[jump] < self.threshold[np.minimum(j, self.runs - 1)]))
                to = self.order[np.where(prev, j - 1, np.minimum(j, self.runs - 1))]
                run[jump] = to
                r[jump] = np.where(prev, self.stop[to] - 1, self.start[to])
                p[jump] = np.where(prev, self.last_sample[to], self.first_sample[to])
            moved = np.flatnonzero(known)
            r[moved] = self.lf[run[moved]] + r[moved] - self.start[run[moved]]
            p[moved] -= 1
            p[moved] += self.n * (p[moved] < 0)
            fresh[:active] = ~known
            own = np.flatnonzero(known & (pos < last[:active]))
            result[pos[own]] = p[own]
        return np.split(result, np.cumsum(size)[:-1])

    def matches(self, pieces: list[np.ndarray], length: int, longest: int = 1024) -> list[np.ndarray]:
        """For each position of each piece that starts a match of at least ``length`` words the owner of its place, else -1."""
        if length not in self.windows:
            self.windows[length] = window_hashes(self.words, length)
        known, out = self.windows[length], []
        for piece, place in zip(pieces, self.places(pieces, longest, length - 1), strict=True):
            found = np.full(len(piece), -1, np.int64)
            own = window_hashes(piece, length)
            at = place[: len(own)]
            ok = np.flatnonzero((at >= 0) & (at < len(known)))
            ok = ok[known[at[ok]] == own[ok]]
            found[ok] = self.owner[at[ok]]
            out.append(found)
        return out
