"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Windows of each benchmark item are hashed into a sorted table, which is made
once, broadcast and kept by each worker; training texts are scanned for windows whose hash is in it, and each hit
is verified word by word. The broadcast is bounded by ``block_bytes`` of their
text: a larger benchmark is scanned in several blocks, each broadcast on
its own, and each row passes through the blocks one after another.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fleetlens.llm._common import ASCII_LOWER, batch_of, chunks, map_batches, texts

#: Word bytes stay (A-Z lower-cased), all others become blanks: 0x00-0x2F, 0x3A-0x60, 0x7B-0x7F after lower-casing.
_TO_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in ASCII_LOWER)
WINDOW = 10
#: Bytes of benchmark text that one block broadcasts; an item is never split.
BLOCK_BYTES = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64())))])
DDL = "doc_id long, n_words long, n_hit long, items array<string>, spans array<array<long>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def rolled(ids: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of each k consecutive ids, modulo 2**64."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _BASE + ids[j : j + n].astype(np.uint64) + np.uint64(1)
    return h


def hashed(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, n)


class Windows:
    """The windows of some items by length, as arrays that are made once and broadcast: sorted hashes for the scan, places in the packed words for the check, items by window.

    Windows with equal words are one entry with all their items; two different
    ones of one hash are two entries.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.names = [name for name, _ in items]
        split = [words_of(text) for _, text in items]
        counts = np.array([len(w) for w in split], np.int64)
        self.raw = b" ".join(chain.from_iterable(split)) + b" "
        sizes = np.fromiter((len(w) + 1 for w in chain.from_iterable(split)), np.int64, int(counts.sum()))
        #: Where each word begins, and where the last one's blank ends.
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        values = hashed(chain.from_iterable(split), len(sizes))
        del split
        owner, first = np.repeat(np.arange(len(items)), counts), np.cumsum(counts) - counts
        left = np.repeat(first + counts, counts) - np.arange(len(owner))  # words from here to the item's end
        length = np.minimum(window, counts)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(length[length > 0]).tolist():
            at = np.flatnonzero((length[owner] == k) & (left >= k))
            self.tables[k] = self._table(k, at, rolled(values, k)[at], owner[at])
        self._quick: dict[int, np.ndarray] = {}

    def words_at(self, i: int, k: int) -> bytes:
        return self.raw[self.begin[i] : self.begin[i + k] - 1]

    def _table(self, k: int, at: np.ndarray, h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, places, ends of items, items) of the entries in order of hash."""
        order = np.lexsort((owner, h))
        at, h, owner = at[order], h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        same, head = np.flatnonzero(~new), np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        apart = [i for i in same.tolist() if self.words_at(int(at[i]), k) != self.words_at(int(at[head[i]]), k)]
        new[apart] = True  # of one hash, not one window; rows of the first window that follow it are an entry again
        for i in (i + 1 for i in apart if i + 1 < len(new)):
            new[i] = True
        entry = np.cumsum(new) - 1
        keep = new.copy()
        keep[1:] |= (entry[1:] != entry[:-1]) | (owner[1:] != owner[:-1])
        ends = np.cumsum(np.bincount(entry[keep], minlength=int(new.sum())))
        return h[new], at[new].astype(np.int64), ends, owner[keep].astype(np.int32)

    def quick(self, k: int) -> np.ndarray:
        """Whether any entry's hash begins with 24 bits; made once a worker."""
        if k not in self._quick:
            self._quick[k] = np.zeros(1 << 24, bool)
            self._quick[k][self.tables[k][0] >> np.uint64(40)] = True
        return self._quick[k]

    def scan(self, docs: list[list[bytes]]) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are hit, over the documents' words one after another with one place between documents, and the items by document."""
        starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
        values = hashed((w for d in docs for w in (*d, b"")), int(starts[-1]))
        hit, items = np.zeros(len(values), bool), [set() for _ in docs]
        for k, (known, places, ends, owners) in self.tables.items():
            if len(values) < k:
                continue
            h = rolled(values, k)
            at = np.flatnonzero(self.quick(k)[h >> np.uint64(40)])
            entry = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            found = known[entry] == h[at]
            for i, e in zip(at[found].tolist(), entry[found].tolist(), strict=True):
                doc = int(np.searchsorted(starts, i, "right")) - 1
                place = i - int(starts[doc])
                words = b" ".join(docs[doc][place : place + k])
                while e < len(known) and known[e] == h[i]:
                    if words == self.words_at(int(places[e]), k):
                        hit[i : i + k] = True
                        items[doc].update(self.names[o] for o in owners[ends[e - 1] if e else 0 : ends[e]].tolist())
                    e += 1
        return hit, items


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items, as they stream to the driver partition by partition, in blocks of bounded size."""
    block, size = [], 0
    for name, text in benchmark.toLocalIterator():
        text = (text or "").encode()
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += len(text)
    yield block


def _runs(hit: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for each row of ``docs`` (doc_id, text).

    ``benchmark`` is (item_id, text). A window is ``window`` consecutive words of
    an item, or all words of a shorter item; ``spans`` are the hit words' runs as
    [first, end). Null texts have no words, and an item without words or with a
    null id hits nothing. Rows come back one by one, repeated ones as often.
    """
    spark = docs.sparkSession
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.lit(None).cast(t).alias(c) for c, t in (("items", "array<string>"), ("spans", "array<array<long>>"))])
    blocks = _blocks(benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text"), block_bytes)
    following = next(blocks)
    while following is not None:
        shared = spark.sparkContext.broadcast(Windows(following, window))  # of at most block_bytes of text, or one item
        following = next(blocks, None)
        last = following is None

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for b in chunks(batches):
                words = [words_of(t) for t in texts(b.column("text"))]
                hit, items = windows.scan(words)
                ends = np.cumsum([len(w) + 1 for w in words]) - 1
                own = [hit[e - len(w) : e] for e, w in zip(ends, words, strict=True)]
                # what the blocks before have hit
                for x, names, old_names, old in zip(own, items, b.column("items").to_pylist(), b.column("spans").to_pylist(), strict=True):
                    names.update(old_names or [])
                    for i, j in old or []:
                        x[i:j] = True
                items, spans = [sorted(x) for x in items], [_runs(x) for x in own]
                if last:
                    yield batch_of(SCHEMA, [b.column("doc_id"), [len(w) for w in words], [int(x.sum()) for x in own], items, spans])
                else:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), *[pa.array(x, SCHEMA.field(c).type) for c, x in (("items", items), ("spans", spans))]], names=["doc_id", "text", "items", "spans"])

        found = map_batches(found, scan, DDL if last else "doc_id long, text string, items array<string>, spans array<array<long>>")
    return found


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all its columns, without the documents that hold a window (``documents``), or without the hit words (``spans``).

    Removing spans keeps each text's other bytes as they are. Null texts stay.
    """
    spark, schema = docs.sparkSession, docs.schema
    for block in _blocks(benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text"), block_bytes):
        shared = spark.sparkContext.broadcast(Windows(block, window))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for b in chunks(batches):
                raw = texts(b.column("text"))
                words = [words_of(t) for t in raw]
                hit, _ = windows.scan(words)
                ends = np.cumsum([len(w) + 1 for w in words]) - 1
                own = [hit[e - len(w) : e] for e, w in zip(ends, words, strict=True)]
                if mode == "documents":
                    yield b.filter(pa.array([not x.any() for x in own]))
                    continue
                left = [t if t is None or not x.any() else without_words(r, x).decode() for t, r, x in zip(b.column("text").to_pylist(), raw, own, strict=True)]
                i = b.schema.get_field_index("text")
                yield b.set_column(i, b.schema.field(i), pa.array(left, b.schema.field(i).type))

        docs = map_batches(docs, clean, schema)
    return docs


def without_words(raw: bytes, hit: np.ndarray) -> bytes:
    """The text without the runs of hit words, what stands between words of a run included."""
    line = np.frombuffer(raw.translate(_TO_WORDS), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[0], line.view(np.int8), [0]]))).reshape(-1, 2)
    out, last = [], 0
    for a, b in _runs(hit):
        out.append(raw[last : edge[a, 0]])
        last = edge[b - 1, 1]
    return b"".join([*out, raw[last:]])
