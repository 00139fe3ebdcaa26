"""Suffix-array dedup by a hash-compared suffix sort.

A shard's segments (see ``_repeats``) are one text with polynomial prefix
hashes. The suffixes at windows that may repeat are sorted by mergesort; two
suffixes are compared by binary search over the prefix hashes for their common
extension, then by the byte after it. Neighbours in the order whose common
extension reaches the window are equal windows once their bytes are compared;
a window goes if its group has one in a smaller document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import _repeats
from fleetlens.llm._repeats import BYTE, Segments, Symbols, gather

WINDOW = 50
#: Long enough that prose repeats few by chance, at half of the window.
_GRAM = 24


def read_bytes(raw: list[bytes]) -> Symbols:
    a = np.frombuffer(b"".join(raw), np.uint8)
    place = np.arange(len(a) + 1)
    return Symbols(BYTE[a], a, place[:-1], place[1:], np.array([len(x) for x in raw], np.int64))


class PrefixHashes:
    """Polynomial prefix hashes of a text, modulo 2**64, and what they tell of its suffixes."""

    def __init__(self, text: np.ndarray, window: int) -> None:
        self.text, self.window = text, window
        self.prefix, self.power = _repeats.prefix_hashes(BYTE[text])
        # the hash of each whole window, where the searches begin
        self.whole = _repeats.grams(BYTE[text], window)

    def equal(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Whether the hashes of ``size`` bytes at a and b agree, both shifted to one power."""
        last = len(self.text)
        x = (self.prefix[a + size] - self.prefix[a]) * self.power[last - a]
        return x == (self.prefix[b + size] - self.prefix[b]) * self.power[last - b]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes at a and b, up to the window, by binary search."""
        out = np.where(self.whole[a] == self.whole[b], self.window, 0)
        open_ = np.flatnonzero(out == 0)
        a, b, n, size = a[open_], b[open_], out[open_], 1 << (self.window.bit_length() - 1)
        while size and len(open_):
            i = np.flatnonzero(n + size < self.window)
            i = i[self.equal(a[i] + n[i], b[i] + n[i], size)]
            n[i] += size
            size >>= 1
        out[open_] = n
        return out

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at a is less than, equal to or greater than that at b, over the window."""
        n = self.common(a, b)
        i = np.minimum(n, self.window - 1)
        x, y = self.text[a + i].astype(np.int64), self.text[b + i].astype(np.int64)
        return np.where(n >= self.window, 0, np.sign(x - y))


def merge_sorted(hashes: PrefixHashes, at: np.ndarray) -> np.ndarray:
    """The suffixes at ``at`` in order: by their first 8 bytes, then by a stable mergesort within groups that share these.

    Runs of one length are merged at once: each suffix finds its rank in the
    sibling run by binary search with the hash comparison.
    """
    key = np.zeros(len(at), np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | hashes.text[at + j].astype(np.uint64)
    by = np.argsort(key, kind="stable")
    order, key = at[by], key[by]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    size = np.diff(np.concatenate([first, [len(at)]]))
    run = 1
    while run < size.max(initial=0):
        i = np.flatnonzero(size[group] > run)  # places in groups that aren't sorted yet
        base, n = first[group[i]], size[group[i]]
        own = (i - base) // run
        low = np.minimum((own ^ 1) * run, n)
        high = np.minimum(low + run, n)
        sibling, right = low.copy(), own & 1 == 1
        me = order[i]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            c = hashes.compare(order[base[open_] + mid], me[open_])
            less = (c < 0) | (c == 0) & right[open_]  # of equal ones the left run's come first
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
            open_ = open_[low[open_] < high[open_]]
        target = base + (own >> 1) * 2 * run + (i - base - own * run) + (low - sibling)
        merged = order.copy()
        merged[target] = me
        order, run = merged, 2 * run
    return order


def _resolver(w: int):
    def resolve(seg: Segments, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Stretches to remove. rank: of the doc_id."""
        order = _repeats.dense_order(rank, seg.start)
        values = BYTE[seg.raw]
        # anchors that occur once can't have an equal window elsewhere; equal segments are settled by the smallest document
        stretches = _repeats.Stretches(values)
        h = stretches.hash(seg.at + seg.anchor, _GRAM)
        left = np.flatnonzero(_repeats.again(h))
        if not len(left):
            return [(np.zeros(0, np.int64),) * 3]
        some, rank = seg.take(left), rank[left]
        g = stretches.hash(some.at, some.size)
        done = _repeats.settle(g, rank, order[left], some.raw, some.at, some.size)
        cuts = [(some.doc[done], some.start[done], some.start[done] + some.size[done])]
        some, rank, h = some.take(~done), rank[~done], h[left][~done]
        twice = _repeats.again(h)
        some, rank = some.take(twice), rank[twice]
        if not len(rank):
            return cuts
        text = some.raw[gather(some.at, some.size)]
        place = np.cumsum(some.size) - some.size
        at = gather(place, some.windows)
        owner = np.repeat(np.arange(len(rank)), some.windows)
        hashes = PrefixHashes(text, w)
        # suffixes whose window's hash is alone can't be equal to another; the sort leaves them out
        whole = hashes.whole[at]
        twice = _repeats.again(whole)
        at, owner = at[twice], owner[twice]
        if not len(at):
            return cuts
        of = np.full(len(text), -1, np.int64)
        of[at] = owner
        ordered = merge_sorted(hashes, at)
        a, b = ordered[:-1], ordered[1:]
        near = np.flatnonzero(hashes.common(a, b) >= w)
        equal = np.zeros(len(a), bool)
        equal[near] = _repeats.same_bytes(text, a[near], b[near], np.full(len(near), w), np.full(len(near), w))
        head = np.concatenate([[True], ~equal])
        least = np.minimum.reduceat(rank[of[ordered]], np.flatnonzero(head))[np.cumsum(head) - 1]
        removed = ordered[rank[of[ordered]] > least]
        row = of[removed]
        start = some.start[row] + removed - place[row]
        return [*cuts, (some.doc[row], start, start + w)]

    return resolve


def _keep(t: bytes | None, cuts: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    t, out, last, spans, reach = t or b"", [], 0, 0, -1
    for a, b in sorted(cuts):
        if a > reach:
            spans += 1
        if a > last:
            out.append(t[last:a])
        last, reach = max(last, b), max(reach, b)
    kept = b"".join([*out, t[last:]])
    return len(t), len(t) - len(kept), spans, kept


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, shard_bytes: int = 2 << 20, chunk_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` (doc_id, text, any others) with n_bytes, n_removed, n_spans and kept (the bytes left).

    A byte goes if it lies in a string of ``window`` bytes that also starts in a
    text with a smaller doc_id. A null doc_id comes before all others; rows that
    share a doc_id don't count for each other. A null text is empty. Made columns
    take the place of input columns of their name, in any case of letters; all
    other input columns are handed on.
    """
    return _repeats.remove_repeats(docs, read_bytes, _resolver(window), _keep, window, _GRAM, False, shard_bytes, chunk_bytes, "n_bytes long, n_removed long, n_spans long, kept binary", ask_first=True)


def whole_characters(kept: bytes | None) -> str:
    """Bytes left as text; parts of characters that a removal cut through go too."""
    return (kept or b"").decode("utf-8", "ignore")


def keep_unrepeated(docs: DataFrame, window: int = WINDOW, shard_bytes: int = 2 << 20, chunk_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with its columns, the texts without the repeated strings, n_chars (if any) made new; texts that become empty stay as such, null stays null."""

    def text_of(t: bytes | None, cuts: list[tuple[int, int]]) -> tuple[str | None]:
        return (None if t is None else whole_characters(_keep(t, cuts)[3]),)

    found = _repeats.with_repeats(docs, read_bytes, _resolver(window), text_of, window, _GRAM, False, shard_bytes, chunk_bytes, "new string", ask_first=True)
    return found.select(*[F.col("new").alias(c) if c == "text" else F.length("new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns])
