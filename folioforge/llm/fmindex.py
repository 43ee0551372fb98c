"""Repeated spans by FM-index.

:class:`FMIndex` is a compressed full-text index over word numbers: a Burrows-
Wheeler transform in a wavelet matrix of packed bits with rank counts. Backward
search extends a match to the left, one word a step, for many texts at once.

A window of ``length`` words is repeated if its words start anywhere else too.
``matching_intervals`` streams texts against an index: for each text it looks for
windows from the left; a window is searched from its last word backwards, and
where the search fails, all windows that hold the failed part are passed over.
Where windows match, the tested span is doubled, so long repeats cost few steps a
word. It reports the maximal intervals whose windows all occur ``at_least`` times.
"""

from __future__ import annotations

import numpy as np


class FMIndex:
    """Index over texts of word numbers 1..sigma; texts are ended by 0."""

    def __init__(self, words: np.ndarray, context: int):
        """words: texts, each followed by 0. context: words by which suffixes are ordered at least."""
        n = len(words)
        self.n = n
        self.sigma = int(words.max(initial=0)) + 1
        order = np.argsort(words, kind="stable")
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(words[order[1:]] != words[order[:-1]])
        reach = 1
        while reach < context and n:
            # Suffixes are compared in full up to the end of their text, which is enough: no match crosses it.
            nxt = np.zeros(n, np.int64)
            nxt[: n - reach] = rank[reach:] + 1
            key = rank * (n + 1) + nxt
            order = np.argsort(key, kind="stable")
            rank[order] = np.r_[0, np.cumsum(key[order[1:]] != key[order[:-1]])]
            reach *= 2
            if rank[order[-1]] == n - 1:
                break
        bwt = words[order - 1] if n else words
        self.first = np.r_[0, np.cumsum(np.bincount(words, minlength=self.sigma))].astype(np.int64)
        self.levels = max(1, int(self.sigma - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        now = bwt.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            padded = np.zeros(-(-(n + 1) // 64) * 64, bool)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(packed)
            self.ranks.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)][:-1].astype(np.uint32))
            self.zeros.append(n - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def occurrences(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each word is among the first ``at`` words of the transform, relative to the word's start in the matrix."""
        pos = at.astype(np.int64)
        for i in range(self.levels):
            block, rest = pos >> 6, (pos & 63).astype(np.uint64)
            ones = self.ranks[i][block].astype(np.int64) + np.bitwise_count(self.bits[i][block] & ((np.uint64(1) << rest) - np.uint64(1)))
            set_ = (word >> (self.levels - 1 - i) & 1).astype(bool)
            pos = np.where(set_, self.zeros[i] + ones, pos - ones)
        return pos

    def extend(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that start with the word and go on as those of [lo, hi)."""
        n = len(word)
        base = self.occurrences(word, np.zeros(n, np.int64))
        both = self.occurrences(np.r_[word, word], np.r_[lo, hi])
        start = self.first[word]
        return start + both[:n] - base, start + both[n:] - base

    def count(self, words: np.ndarray) -> int:
        """How often the words occur in a row."""
        lo, hi = np.array([0]), np.array([self.n])
        for w in words[::-1]:
            lo, hi = self.extend(np.array([w]), lo, hi)
        return max(0, int(hi[0] - lo[0]))


def matching_intervals(index: FMIndex, words: np.ndarray, bounds: np.ndarray, length: int, at_least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of maximal intervals of windows that occur ``at_least`` times.

    ``words`` has all texts end to end, ``bounds`` their starts and the end. All
    texts advance together, one word of backward search a step. A span from
    ``left`` to ``end`` is under test; ``good`` is where proven windows end.
    """
    start, stop = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    live = np.flatnonzero(stop - start >= length)
    left, end = start[live].copy(), start[live] + length
    good = np.full(len(live), -1, np.int64)
    span = np.full(len(live), length, np.int64)
    at, lo, hi = end.copy(), np.zeros(len(live), np.int64), np.full(len(live), index.n, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        at -= 1
        lo, hi = index.extend(words[at], lo, hi)
        failed = hi - lo < at_least
        done = ~failed & (at == left)
        turn = np.flatnonzero(failed | done)
        if not len(turn):
            continue
        # Proven: every window from left to end. Report it, and go on with windows that end later.
        d = np.flatnonzero(done)
        out.append((live[d], left[d], end[d]))
        good[d] = end[d]
        limit = stop[live]
        left[d] = end[d] - length + 1
        span[d] = np.minimum(span[d] * 2, 4096)
        end[d] = np.minimum(left[d] + span[d], np.maximum(limit[d], left[d] + length))
        # Failed at ``at``: no window that holds [at, end) is repeated. If the span was one window, the
        # next starts after ``at``; else a shorter span from the same left decides.
        f = np.flatnonzero(failed)
        one = f[end[f] - left[f] == length]
        left[one] = at[one] + 1
        span[one] = length
        end[one] = left[one] + length
        more = f[end[f] - left[f] > length]
        # A window that starts at ``left`` and ends before ``end`` may still be repeated.
        span[more] = np.maximum(length, (end[more] - left[more]) // 2)
        end[more] = left[more] + span[more]
        at[turn], lo[turn], hi[turn] = end[turn], 0, index.n
        stay = end <= limit
        if not stay.all():
            live, left, end, good, span, at, lo, hi = (x[stay] for x in (live, left, end, good, span, at, lo, hi))
    if not out:
        return (np.empty(0, np.int64),) * 3
    text, a, b = (np.concatenate([o[i] for o in out]) for i in range(3))
    order = np.lexsort((a, text))
    return text[order], a[order], b[order]
