"""Where windows of w symbols occur again in a corpus: what the two repeat removers share.

Every window is dealt by its content, so that equal windows meet wherever they
stand. The m-gram with the least hash in a window (the leftmost of them) is its
anchor. Consecutive windows with one anchor form a segment, and the anchor's
hash names the shard that gets the segment's text. A text is so sent some three
times over, in compressed blobs, and each window is in one segment only.

Segments that a chunk holds more than once are sent once where the earlier one
settles the later; a passage that stands in a third of all texts so meets its
shard once a chunk. A shard keeps the segments whose anchor occurs again,
settles equal segments, and gives the rest to an index (op 6: FM-index, op 7:
suffix sort). Removed stretches go back to the chunk of their text.

With short windows the segments would be many times the text, so anchors can be
asked for first: chunks send 32 bits of each, shards answer a bit, and only
segments whose anchor occurs again are dealt. Bits that agree by chance only
add segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from xxhash import xxh64_intdigest

from fleetlens.llm._common import CHUNK_BYTES, chunks, for_group, for_groups, map_batches

BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Symbols that are hashed at once; longer texts are cut into overlapping pieces.
PIECE = 1 << 22
_LOW = np.uint64((1 << 24) - 1)
MIN_ID = np.iinfo(np.int64).min


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


def grams(symbols: np.ndarray, m: int) -> np.ndarray:
    """Polynomial hash of each m consecutive symbols, by doubling."""
    out, done, power, h, size = None, 0, np.array([BASE]), symbols, 1
    while True:
        if m & size:  # append the stretch of this size
            if out is None:
                out, done = h, size
            else:
                n = len(symbols) - done - size + 1
                out, done = out[:n] * power + h[done : done + n], done + size
        if done == m:
            return mixed(out)
        n = len(h) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = h[:n] * power + h[size : size + n]
        power, size = power * power, 2 * size


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    size, out = 1, a
    while 2 * size <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == w else np.minimum(out[: len(a) - w + 1], out[w - size : len(a) - size + 1])


def gather(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... of all stretches one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


@dataclass
class Symbols:
    """Symbols of some texts one after another: a 64-bit value each, and where its bytes stand in ``raw``."""

    values: np.ndarray
    raw: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    #: Symbols of each text.
    counts: np.ndarray


Read = Callable[[list[bytes]], Symbols]


@dataclass
class Segments:
    """Segments with their text: row of the document, first symbol, windows, anchor's place, and bytes."""

    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    raw: np.ndarray
    at: np.ndarray
    size: np.ndarray

    def take(self, i: np.ndarray) -> Segments:
        return Segments(self.doc[i], self.start[i], self.windows[i], self.anchor[i], self.raw, self.at[i], self.size[i])


#: Symbols that are hashed before the next ones, so that they stay in the processor's cache.
_BLOCK = 1 << 15


def _least_grams(values: np.ndarray, w: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the hash of its m-gram, and for each window the least hash's high bits with its place below."""
    n = len(values)
    h, least = np.empty(n - m + 1, np.uint64), np.empty(n - w + 1, np.uint64)
    for i in range(0, n - w + 1, _BLOCK):
        own = grams(values[i : i + _BLOCK + w - 1], m)
        h[i : i + len(own)] = own
        least[i : i + _BLOCK] = sliding_min((own & ~_LOW) | np.arange(i, i + len(own), dtype=np.uint64), w - m + 1)
    return h, least


def _pieces(counts: np.ndarray, w: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first symbol, end, texts, their starts, their ends) of stretches of about PIECE symbols; a longer text is cut so that each window is in one stretch."""
    ends = np.cumsum(counts)
    starts = ends - counts
    i = 0
    while i < len(counts):
        if counts[i] >= PIECE:
            for p in range(int(starts[i]), int(ends[i]) - w + 1, PIECE):
                e = min(p + PIECE + w - 1, int(ends[i]))
                yield p, e, np.array([i]), np.array([p]), np.array([e])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        yield int(starts[i]), int(ends[j - 1]), np.arange(i, j), starts[i:j], ends[i:j]
        i = j


def segments_of(s: Symbols, w: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first symbol, windows, anchor's offset, anchor's hash) of each segment, found in pieces of bounded size."""
    found = []
    first = np.cumsum(s.counts) - s.counts
    for begin, end, text, starts, ends in _pieces(s.counts, w):
        if end - begin < w:
            continue
        h, least = _least_grams(s.values[begin:end], w, m)
        starts, last = starts - begin, np.maximum(ends - begin - w + 1, starts - begin)  # windows start in [starts, last)
        cut = np.zeros(len(least) + 1, bool)
        cut[1:-1] = least[1:] != least[:-1]
        cut[starts[starts < len(cut)]] = True
        cut[last[last < len(cut)]] = True
        at = np.flatnonzero(cut[:-1])
        stop = np.append(at[1:], len(least))
        own = np.searchsorted(starts, at, "right") - 1
        ok = (own >= 0) & (at < last[own])
        at, stop, own = at[ok], stop[ok], own[ok]
        anchor = (least[at] & _LOW).astype(np.int64)
        found.append((text[own], at + begin - first[text[own]], stop - at, anchor - at, h[anchor]))
    if not found:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending different values and how often each occurs."""
    a = np.sort(a)
    head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    return a[head], np.diff(np.append(head, len(a)))


def again(a: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    by = np.argsort(a, kind="stable")
    same, out = a[by[1:]] == a[by[:-1]], np.zeros(len(a), bool)
    out[by[1:][same]] = True
    out[by[:-1][same]] = True
    return out


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefix_hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial prefix hashes of the values, and the powers of the base; both have one entry more than the values."""
    power = powers(BASE, len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:-1], out=prefix[1:])
    return prefix, power


class Stretches:
    """Hashes of stretches of symbols that tell their content, not their place, alike in every text."""

    def __init__(self, values: np.ndarray) -> None:
        self.prefix, _ = prefix_hashes(values)
        self.shift = powers(_INVERSE, len(values) + 1)

    def hash(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mixed((self.prefix[at + size] - self.prefix[at]) * self.shift[at])


def dense_order(rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places by (rank, start); equal pairs, which rows that are equal give, share a place."""
    by = np.lexsort((start, rank))
    out = np.empty(len(rank), np.int64)
    out[by] = np.concatenate([[0], np.cumsum((np.diff(rank[by]) != 0) | (np.diff(start[by]) != 0))]) if len(by) else 0
    return out


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the bytes at a and b agree; eight at a time, the last eight of a stretch overlapping those before."""
    out = size == size_b
    i = np.flatnonzero(out & (size >= 8))
    if len(i):
        eight = np.ndarray(len(raw) - 7, np.uint64, raw, strides=(1,))
        n = (size[i] + 7) >> 3
        ends = np.cumsum(n)
        step = np.minimum(8 * (np.arange(ends[-1]) - np.repeat(ends - n, n)), np.repeat(size[i] - 8, n))
        out[i] = np.logical_and.reduceat(eight[np.repeat(a[i], n) + step] == eight[np.repeat(b[i], n) + step], ends - n)
    for j in np.flatnonzero(out & (size < 8) & (size > 0)).tolist():
        out[j] = bytes(raw[a[j] : a[j] + size[j]]) == bytes(raw[b[j] : b[j] + size[j]])
    return out


def settle(g: np.ndarray, rank: np.ndarray, order: np.ndarray, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Segments that an equal one before them settles: same content, and a smaller rank. The bytes are compared.

    order: places in the corpus' order, rank: what must be smaller for a removal.
    """
    by = np.lexsort((order, g))
    head = np.concatenate([[True], g[by[1:]] != g[by[:-1]]])
    first = by[np.flatnonzero(head)[np.cumsum(head) - 1]]
    cand = np.flatnonzero((rank[first] < rank[by]))
    out = np.zeros(len(g), bool)
    x, f = by[cand], first[cand]
    out[x] = same_bytes(raw, at[x], at[f], size[x], size[f])
    return out


def pack(arrays: list[np.ndarray], z: zstandard.ZstdCompressor) -> bytes:
    return z.compress(b"".join([np.array([len(arrays[0])], np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpack(data: bytes, types: list) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for t in types:
        out.append(np.frombuffer(data, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


_META = [np.int32, np.int64, np.int32, np.int32, np.int32, np.bool_]
_DEALT = "shard int, ids binary, meta binary, text binary"
_CUTS = "chunk int, cuts binary"


def _doc_order(ids: np.ndarray, keys: np.ndarray, by_row: bool) -> np.ndarray:
    """Rank of each row by doc_id; by_row: by doc_id and then the row's hash."""
    if by_row:
        order = np.lexsort((keys, ids))
        new = (np.diff(ids[order]) != 0) | (np.diff(keys[order]) != 0)
    else:
        order = np.argsort(ids, kind="stable")
        new = np.diff(ids[order]) != 0
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(new)]) if len(ids) else []
    return rank


def _row_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    d = zstandard.ZstdDecompressor()
    return [b"" if x is None else d.decompress(x) for x in column.to_pylist()]


def _cut_by(key: np.ndarray) -> list[tuple[int, int]]:
    """[first, end) of the runs of a sorted key."""
    if not len(key):
        return []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]).tolist()
    return list(zip(cut[:-1], cut[1:], strict=True))


def slices(raw: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Rows of about ``limit`` bytes."""
    group = np.cumsum([len(x) for x in raw]) // limit if raw else np.zeros(0, np.int64)
    return (slice(a, b) for a, b in _cut_by(group))


def _shards(h: np.ndarray, n_shards: int) -> np.ndarray:
    return (mixed(h) % np.uint64(n_shards)).astype(np.int64)


def _asked(h: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard and 32 bits of each anchor as one number; a shard's size is bounded, so that chance hits are few at any scale."""
    return (_shards(h, n_shards) << 32) | (h >> np.uint64(32)).astype(np.int64)


def anchors_again(packed: DataFrame, read: Read, w: int, m: int, n_shards: int) -> DataFrame:
    """(chunk, shard, again): for each chunk's different anchors, in order, a bit that is set if another chunk has it too."""

    def ask(t: pa.Table) -> pa.Table:
        z, raw = zstandard.ZstdCompressor(level=1), _row_bytes(t.column("_text"))
        key, _ = distinct(np.concatenate([np.zeros(0, np.int64), *(distinct(_asked(segments_of(read(raw[x]), w, m)[4], n_shards))[0] for x in slices(raw))]))
        chunk = t.column("_chunk")[0].as_py()
        rows = [(int(key[a] >> 32), chunk, pack([key[a:b].astype(np.uint32)], z)) for a, b in _cut_by(key >> 32)]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["shard", "chunk", "grams"])

    def answer(t: pa.Table) -> pa.Table:
        lists = [unpack(x, [np.uint32])[0] for x in t.column("grams").to_pylist()]
        bits = np.split(again(np.concatenate(lists)), np.cumsum([len(x) for x in lists])[:-1])
        return pa.table({"chunk": t.column("chunk"), "shard": t.column("shard"), "again": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())})

    return packed.groupBy("_chunk").applyInArrow(for_group(ask), "shard int, chunk int, grams binary").groupBy("shard").applyInArrow(for_group(answer), "chunk int, shard int, again binary")


def find_cuts(packed: DataFrame, read: Read, resolve: Callable, w: int, m: int, by_row: bool, n_shards: int, n_chunks: int, ask_first: bool) -> DataFrame:
    """(chunk, cuts): removed stretches of symbols, as blobs for the chunk of the text.

    packed: _id, _key, _chunk, _text (compressed) if anchors are asked for first, else _id, _key, text.
    """

    def deal_rows(ids: np.ndarray, keys: np.ndarray, s: Symbols, segments: tuple, z: zstandard.ZstdCompressor) -> Iterator[pa.RecordBatch]:
        doc, start, windows, anchor, h = segments
        if not len(doc):
            return
        at = (np.cumsum(s.counts) - s.counts)[doc] + start
        size = windows + w - 1
        rank = _doc_order(ids, keys, by_row)[doc]
        order = dense_order(rank, start)
        begin, end = s.begin[at], s.end[at + size - 1]
        done = settle(Stretches(s.values).hash(at, size) ^ h, order if by_row else rank, order, s.raw, begin, end - begin)
        shard = _shards(h, n_shards)
        by = np.lexsort((start, doc, shard))
        out, raw = [], s.raw.tobytes()
        for a, e in _cut_by(shard[by]):
            i = by[a:e]
            own, row = np.unique(doc[i], return_inverse=True)
            sent = i[~done[i]]
            meta = [row.astype(np.int32), start[i], windows[i].astype(np.int32), anchor[i].astype(np.int32), (end - begin)[i].astype(np.int32), done[i]]
            out.append((int(shard[i[0]]), pack([ids[own], keys[own]], z), pack(meta, z), z.compress(b"".join([raw[x:y] for x, y in zip(begin[sent].tolist(), end[sent].tolist(), strict=True)]))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.binary(), pa.binary(), pa.binary()], strict=True)], names=["shard", "ids", "meta", "text"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in chunks(batches, limit=2 * CHUNK_BYTES):  # larger blobs compress better
            s = read([x or b"" for x in b.column("text").cast(pa.large_binary()).to_pylist()])
            yield from deal_rows(b.column("_id").to_numpy(), b.column("_key").to_numpy(), s, segments_of(s, w, m), z)

    def deal_again(left: pa.Table, right: pa.Table) -> pa.Table:
        z, raw = zstandard.ZstdCompressor(level=3), _row_bytes(left.column("_text"))
        ids, keys = left.column("_id").to_numpy(), left.column("_key").to_numpy()
        segments = [segments_of(read(raw[x]), w, m) for x in slices(raw)]
        own = [_asked(x[4], n_shards) for x in segments]
        key, times = distinct(np.concatenate([np.zeros(0, np.int64), *own]))
        twice = times > 1
        for s, bits in zip(right.column("shard").to_pylist(), right.column("again").to_pylist(), strict=True):
            a, b = np.searchsorted(key, [s << 32, (s + 1) << 32])
            twice[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        found = []
        for i, x in enumerate(slices(raw)):
            chosen = np.flatnonzero(twice[np.searchsorted(key, own[i])])
            kept, segments[i], own[i] = tuple(y[chosen] for y in segments[i]), (), own[i][:0]
            found += deal_rows(ids[x], keys[x], read(raw[x]), kept, z)
        return pa.Table.from_batches(found, pa.schema([("shard", pa.int32()), ("ids", pa.binary()), ("meta", pa.binary()), ("text", pa.binary())]))

    def settle_shard(t: pa.Table) -> pa.Table:
        z, d = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        ids, keys, metas, raws, base = [], [], [], [], 0
        for i, meta, text in zip(t.column("ids").to_pylist(), t.column("meta").to_pylist(), t.column("text").to_pylist(), strict=True):
            a, b = unpack(i, [np.int64, np.int64])
            row, *rest = unpack(meta, _META)
            ids.append(a), keys.append(b), metas.append([row.astype(np.int64) + base, *rest])
            raws.append(np.frombuffer(d.decompress(text), np.uint8))
            base += len(a)
        ids, keys, raw = np.concatenate(ids), np.concatenate(keys), np.concatenate(raws)
        doc, start, windows, anchor, size, done = (np.concatenate(x) for x in zip(*metas, strict=True))
        windows, anchor, size = windows.astype(np.int64), anchor.astype(np.int64), size.astype(np.int64)
        rank = _doc_order(ids, keys, by_row)[doc]
        cuts = [(doc[done], start[done], start[done] + windows[done] + w - 1)]
        sent = np.flatnonzero(~done)
        seg = Segments(doc[sent], start[sent], windows[sent], anchor[sent], raw, np.cumsum(size[sent]) - size[sent], size[sent])
        rank = rank[sent]
        if by_row and len(sent):  # rows that are equal are one text
            _, one = np.unique(dense_order(rank, seg.start), return_index=True)
            seg, rank = seg.take(one), rank[one]
        if len(sent):
            cuts += resolve(seg, rank)
        doc, a, b = (np.concatenate(x) for x in zip(*cuts, strict=True))
        doc, a, b = _merged(doc, a, b)
        chunk = keys[doc] % n_chunks  # numpy's remainder is never negative, as pmod
        by = np.argsort(chunk, kind="stable")
        out = [(int(chunk[by[x]]), pack([ids[doc[by[x:y]]], keys[doc[by[x:y]]], a[by[x:y]], b[by[x:y]]], z)) for x, y in _cut_by(chunk[by])]
        return pa.table({"chunk": pa.array([x for x, _ in out], pa.int32()), "cuts": pa.array([x for _, x in out], pa.binary())})

    if ask_first:
        again = anchors_again(packed, read, w, m, n_shards)
        dealt = packed.groupBy("_chunk").cogroup(again.groupBy("chunk")).applyInArrow(for_groups(deal_again), _DEALT)
    else:
        dealt = map_batches(packed, deal, _DEALT)
    return dealt.groupBy("shard").applyInArrow(for_group(settle_shard), _CUTS)


def _merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches by document and place, those that touch joined."""
    if not len(doc):
        return doc, a, b
    by = np.lexsort((a, doc))
    doc, a, b = doc[by], a[by], b[by]
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    # ends so far within the document: shifted apart by document, so that one running maximum serves all
    shift = np.cumsum(new_doc) * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + shift) - shift
    head = new_doc | np.concatenate([[True], a[1:] > reach[:-1]])
    first = np.flatnonzero(head)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], a[first], reach[last]


def with_repeats(docs: DataFrame, read: Read, resolve: Callable, keep: Callable, w: int, m: int, by_row: bool, shard_bytes: int, chunk_bytes: int, fields: str, ask_first: bool = False) -> DataFrame:
    """(row, text, made): ``docs`` with its other columns in one struct, so that no name of theirs matters here, and what ``keep`` makes, named in ``fields``.

    keep(text bytes or None, stretches) gives the values of ``fields`` for a row.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_shards, n_chunks = max(1, -(-total // shard_bytes)), max(1, -(-total // chunk_bytes))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    keyed = docs.select(row.alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_ID)).alias("_id"), F.xxhash64("doc_id", "text").alias("_key"))
    # asking, dealing and cutting share one shuffle of the whole rows
    left = squeezed(keyed).withColumn("_chunk", F.pmod("_key", F.lit(n_chunks)).cast("int"))
    cuts = find_cuts(left if ask_first else keyed.select("_id", "_key", "text"), read, resolve, w, m, by_row, n_shards, n_chunks, ask_first)
    schema = keyed.selectExpr("row", "text", *[f"cast(null as {f.split()[1]}) as {f.split()[0]}" for f in fields.split(", ")]).schema

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], list] = {}
        for blob in right.column("cuts").to_pylist():
            ids, keys, a, b = (x.tolist() for x in unpack(blob, [np.int64] * 4))
            for i, k, x, y in zip(ids, keys, a, b, strict=True):
                found.setdefault((i, k), []).append((x, y))
        d = zstandard.ZstdDecompressor()
        rows = []
        text = [None if x is None else d.decompress(x) for x in left.column("_text").to_pylist()]
        for i, k, t in zip(left.column("_id").to_pylist(), left.column("_key").to_pylist(), text, strict=True):
            rows.append(keep(t, found.get((i, k), [])))
        out = {"row": left.column("row"), "text": pa.array([None if t is None else t.decode() for t in text], pa.string())}
        for f, values in zip(fields.split(", "), zip(*rows, strict=True) if rows else [[]] * len(fields.split(", ")), strict=True):
            name, kind = f.split()
            out[name] = pa.array(values, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[kind])
        return pa.table(out)

    return left.groupBy("_chunk").cogroup(cuts.groupBy("chunk")).applyInArrow(for_groups(finish), schema)


def remove_repeats(docs: DataFrame, read: Read, resolve: Callable, keep: Callable, w: int, m: int, by_row: bool, shard_bytes: int, chunk_bytes: int, fields: str, ask_first: bool = False) -> DataFrame:
    """``docs`` with its columns and those that ``keep`` makes, which replace columns of their names."""
    found = with_repeats(docs, read, resolve, keep, w, m, by_row, shard_bytes, chunk_bytes, fields, ask_first)
    made = [f.split()[0] for f in fields.split(", ")]
    old = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in made]
    return found.select(*old, *made)


def squeezed(docs: DataFrame) -> DataFrame:
    """``docs`` with _text, the compressed text, in text's place, so that it is small in a shuffle."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in chunks(batches):
            i = b.schema.get_field_index("text")
            packed = [None if x is None else z.compress(x) for x in b.column("text").cast(pa.large_binary()).to_pylist()]
            yield b.set_column(i, pa.field("_text", pa.binary()), pa.array(packed, pa.binary()))

    return map_batches(docs, squeeze, StructType([StructField("_text", BinaryType()) if f.name == "text" else f for f in docs.schema.fields]))


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
#: A 64-bit value for each byte.
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_symbols(raw: list[bytes]) -> Symbols:
    """The words of some texts, each followed by one blank in ``raw``, which counts as its end; values are hashes of their bytes."""
    a = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    space = _SPACES[a]
    last = space.copy()  # a blank after a word
    last[1:] &= ~space[:-1]
    last[:1] = False
    text = np.where(space, np.uint8(32), a)[~space | last]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    before = np.searchsorted(np.flatnonzero(last), np.cumsum(size + 1))
    begin, end = word_places(text)
    return Symbols(Stretches(BYTE[text]).hash(begin, end - begin), text, begin, end + 1, np.diff(before, prepend=0))


def word_places(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[begin, end) of each word of a text where one blank follows each."""
    end = np.flatnonzero(text == 32)
    return np.concatenate([[0], end[:-1] + 1]) if len(end) else end, end


#: Word hashes that a worker keeps.
_CACHE = 1_000_000
_hashes: dict[bytes, int] = {}


def read_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    if len(_hashes) > _CACHE:
        _hashes.clear()
    get, values = _hashes.get, np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = _hashes[w] = xxh64_intdigest(w)
        values[i] = h
    return values
