"""Substring dedup with a compressed FM-index per shard.

A shard's segments (see ``_repeats``) are one text of small symbol codes, each
word's code following from its hash. Its Burrows-Wheeler transform, sorted to
the window's depth, is kept as a wavelet matrix of packed bits with block counts
and nothing else. The segments' windows are streamed through it: backward search
from a window's end goes on while two places or more agree, which gives its
matching statistic against all others, up to the window's length. Windows that
reach it are reported with their interval; those of one interval stand at the
interval's places, so that no suffix array is needed to find them. As codes are
short, their words are compared, and all but the earliest of equal ones go.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from fleetlens.llm import _repeats
from fleetlens.llm._repeats import BYTE, Segments, Stretches, gather, word_symbols

WINDOW = 20
_GRAM = 5
#: Three bits a code: 0 ends a segment, words have 1 to 7. 21 codes fit a sort key of 64 bits.
_BITS = 3
_KEY = 21


class WaveletMatrix:
    """Symbols of a few bits, a level of packed bits each; ``rank`` counts a symbol before places."""

    def __init__(self, a: np.ndarray, bits: int) -> None:
        self.levels, self.size = [], len(a)
        for shift in range(bits - 1, -1, -1):
            bit = (a >> shift) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(len(a) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
            self.levels.append((shift, words, before, len(a) - int(bit.sum())))
            a = np.concatenate([a[bit == 0], a[bit == 1]])
        self.first = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place i arrives when it follows the bits of c."""
        for shift, words, before, zeros in self.levels:
            w = i >> 6
            ones = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((c >> shift) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many symbols equal to c[j] stand before place i[j]."""
        return self._down(c, i) - self.first[c]


def _keys(codes: np.ndarray, depth: int) -> list[np.ndarray]:
    """Sort keys of the suffixes at each place to at least ``depth`` codes, 21 in a key, the first one first."""
    n, size, padded = len(codes), 1, np.concatenate([codes, np.zeros(2 * _KEY + depth, np.uint8)]).astype(np.uint64)
    key = padded
    while 2 * size <= _KEY:  # 16 codes by doubling, then 5 more
        key = (key[:-size] << np.uint64(_BITS * size)) | key[size:]
        size *= 2
    for j in range(size, _KEY):
        key = (key[:-1] << np.uint64(_BITS)) | padded[j : j + len(key) - 1]
    return [key[j : j + n] for j in range(0, depth, _KEY)]


class FMIndex:
    """Counts and intervals of patterns of up to ``depth`` codes."""

    def __init__(self, codes: np.ndarray, depth: int = _KEY) -> None:
        # suffixes that agree to the depth may stand in any order: intervals of patterns up to it are the same
        keys = _keys(codes, depth)
        places = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
        self.tree = WaveletMatrix(codes[places - 1].astype(np.int64), _BITS)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=1 << _BITS))])
        self.n, self.depth = len(codes), depth

    def match(self, codes: np.ndarray, at: np.ndarray, w: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high): of each window codes[at : at + w] the longest end, up to w codes, that ``least`` places have, and its interval."""
        if w > self.depth:
            raise ValueError(f"the index is sorted to {self.depth} codes, so windows of {w} can't be counted")
        length = np.zeros(len(at), np.int64)
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        open_ = np.arange(len(at))
        for j in range(w - 1, -1, -1):
            c = codes[at[open_] + j].astype(np.int64)
            a, b = self.before[c] + self.tree.rank(c, low[open_]), self.before[c] + self.tree.rank(c, high[open_])
            on = b - a >= least
            open_ = open_[on]
            low[open_], high[open_] = a[on], b[on]
            length[open_] += 1
        return length, low, high

    def search(self, codes: np.ndarray, at: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Interval [low, high) of the places of each window codes[at : at + w], empty where there is none."""
        length, low, high = self.match(codes, at, w, 1)
        return low, np.where(length == w, high, low)


def _resolver(w: int):
    def resolve(seg: Segments, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Stretches to remove. rank: of the row; places of a row follow their start."""
        begin, end = _repeats.word_places(seg.raw)
        values = Stretches(BYTE[seg.raw]).hash(begin, end - begin)
        n = seg.windows + w - 1
        at = np.searchsorted(begin, seg.at)
        order = _repeats.dense_order(rank, seg.start)
        # anchors that occur once can't have an equal window elsewhere; equal segments are settled by the earliest
        stretches = Stretches(values)
        h = stretches.hash(at + seg.anchor, _GRAM)
        g = stretches.hash(at, n)
        done = _repeats.settle(g, order, order, seg.raw, seg.at, seg.size)
        cuts = [(seg.doc[done], seg.start[done], seg.start[done] + n[done])]
        left = np.flatnonzero(_repeats.again(h) & ~done)
        left = left[_repeats.again(h[left])]
        if not len(left):
            return cuts
        # the index: codes of the segments that are left, each ended by 0
        m = n[left]
        place = np.cumsum(m + 1) - (m + 1)
        inside = gather(place, m)
        word = np.full(int((m + 1).sum()), -1, np.int64)
        word[inside] = gather(at[left], m)
        codes = np.where(word < 0, 0, 1 + (values[word] >> np.uint64(7)) % np.uint64(7)).astype(np.uint8)
        start = gather(place, seg.windows[left])
        length, low, _ = FMIndex(codes, max(w, _KEY)).match(codes, start, w)
        many = np.flatnonzero(length == w)
        if not len(many):
            return cuts
        low, mine = low[many], start[many]
        row = np.repeat(left, seg.windows[left])[many]
        a = seg.start[row] + mine - np.repeat(place, seg.windows[left])[many]
        # the earliest of an interval's windows with the same words stays
        same = stretches.hash(word[mine], w)
        by = np.lexsort((a, rank[row], same, low))
        head = np.concatenate([[True], (low[by[1:]] != low[by[:-1]]) | (same[by[1:]] != same[by[:-1]])])
        first = by[np.flatnonzero(head)[np.cumsum(head) - 1]]
        x, size = begin[word[mine]], end[word[mine + w - 1]] - begin[word[mine]]
        equal = np.ones(len(mine), bool)
        equal[by] = _repeats.same_bytes(seg.raw, x[by], x[first], size[by], size[first])
        gone = np.zeros(len(mine), bool)
        gone[by] = equal[by] & (by != first)
        odd = first[~equal[by]]
        for f in np.unique(odd).tolist():  # words share a hash: by their bytes
            own: set[bytes] = set()
            for i in by[first == f].tolist():
                text = bytes(seg.raw[x[i] : x[i] + size[i]])
                gone[i] = text in own
                own.add(text)
        return [*cuts, (seg.doc[row[gone]], a[gone], a[gone] + w)]

    return resolve


def _keep(t: bytes | None, cuts: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    words = (t or b"").split()
    left, last = [], 0
    for a, b in sorted(cuts):
        left += words[last:a]
        last = max(last, b)
    left += words[last:]
    return len(words), len(words) - len(left), b" ".join(left)


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, shard_bytes: int = 2 << 20, chunk_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` (doc_id, text, any others) with n_words, n_removed and kept (the words left, joined by a blank, as bytes).

    A word goes if it lies in a window of ``window`` words that also starts
    earlier: in a smaller doc_id, or earlier in the same text. A null doc_id
    comes before all others. Rows that share a doc_id come by a hash of the row;
    rows that are equal are one text and have one result. A null text has no
    words. Made columns take the place of input columns of their name, in any
    case of letters; all other input columns are handed on.
    """
    return _repeats.remove_repeats(docs, word_symbols, _resolver(window), _keep, window, _GRAM, True, shard_bytes, chunk_bytes, "n_words long, n_removed long, kept binary")
