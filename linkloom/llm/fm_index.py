"""A compressed full-text index over words, with backward search in batches.

The text is a concatenation of pieces, each ended by word 0. Suffixes are sorted by
their first 64 words (prefix doubling), which is exact for patterns of fewer words. The
Burrows-Wheeler text is kept as a wavelet tree of bit vectors in 64-bit blocks with rank
counts, about 1.5 bits per word and level.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
DEPTH = 64


class _Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.block = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.block), dtype=np.int64)[:-1]].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        i = at >> 6
        mask = (_U(1) << (at & 63).astype(_U)) - _U(1)
        return self.before[i] + np.bitwise_count(self.block[i] & mask)


class FMIndex:
    def __init__(self, text: np.ndarray):
        """``text`` holds word numbers from 0; 0 ends a piece."""
        n = len(text)
        rank = text.astype(np.int64)
        order = np.argsort(rank, kind="stable")
        h = 1
        while h <= DEPTH:
            after = np.zeros(n, np.int64)
            after[: max(0, n - h)] = rank[h:] + 1
            key = rank * (int(rank.max(initial=0)) + 3) + after
            order = np.argsort(key, kind="stable")
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[False, s[1:] != s[:-1]])
            if n == 0 or rank[order[-1]] == n - 1:
                break
            h *= 2
        bwt = text[order - 1].astype(np.int64)
        sigma = int(text.max(initial=0)) + 1
        self.size = n
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))].astype(np.int64)
        self.levels: list[tuple[int, int, _Bits]] = []
        for shift in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> shift) & 1
            zeros = n - int(bit.sum())
            self.levels.append((shift, zeros, _Bits(bit.astype(np.uint8))))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        # where each word's run starts at the last level
        self.start = np.zeros(sigma, np.int64)
        at = np.zeros(sigma, np.int64)
        c = np.arange(sigma)
        for shift, zeros, bits in self.levels:
            one = (c >> shift) & 1 == 1
            r = bits.rank(at)
            at = np.where(one, zeros + r, at - r)
        self.start = at

    def occ(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often word c stands in the first ``at`` places of the transformed text."""
        at = at.astype(np.int64)
        for shift, zeros, bits in self.levels:
            r = bits.rank(at)
            at = np.where((c >> shift) & 1 == 1, zeros + r, at - r)
        return at - self.start[c]

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the patterns with word c put in front."""
        both = self.occ(np.r_[c, c], np.r_[lo, hi])
        base = self.first[c]
        return base + both[: len(c)], base + both[len(c) :]


def repeated_windows(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int, probe: int = 8) -> np.ndarray:
    """True at each start of a ``width``-word window that the index holds twice or more.

    Pieces [begin, end) of ``text`` are streamed side by side, right to left. While a match
    with two or more places grows to the left, its length at each position is the matching
    statistic; where it breaks, a short probe from the break tells how far the right end
    has to move.
    """
    found = np.zeros(len(text) + 1, bool)
    live = end - begin >= width
    begin, right = begin[live].astype(np.int64), end[live].astype(np.int64)
    left = right.copy()
    lo, hi = np.zeros(len(right), np.int64), np.full(len(right), index.size)
    target = np.full(len(right), -1)  # left end of a running probe
    old = right.copy()  # right end that the probe was begun for
    while len(right):
        a, b = index.extend(text[left - 1], lo, hi)
        ok = b - a >= 2
        main = target < 0
        left = np.where(ok, left - 1, left)
        lo, hi = np.where(ok, a, lo), np.where(ok, b, hi)
        found[left[ok & main & (right - left >= width)]] = True
        # a probe that went through proves nothing: move by one word
        through = ok & ~main & (left == target)
        broke = ~ok
        short = broke & main & (right - left < probe)
        begin_probe = broke & main & ~short
        dead = broke & ~main  # the probe's words stand nowhere else
        at = left - 1  # the word that broke the match
        new_right = np.where(through, old - 1, np.where(short, right - 1, np.where(dead, np.minimum(target + probe, right) - 1, right)))
        old = np.where(begin_probe, right, old)
        new_right = np.where(begin_probe, at + probe, new_right)
        target = np.where(begin_probe, at, np.where(through | dead, -1, target))
        reset = through | broke
        right = new_right
        left = np.where(reset, right, left)
        lo, hi = np.where(reset, 0, lo), np.where(reset, index.size, hi)
        keep = np.where(target >= 0, True, (right - begin >= width) & ~((left <= begin) & ~reset))
        if not keep.all():
            begin, right, left, lo, hi, target, old = (x[keep] for x in (begin, right, left, lo, hi, target, old))
    return found[:-1]
