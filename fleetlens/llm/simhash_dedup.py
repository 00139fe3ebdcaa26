"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: 64 bits are cut into blocks of odd
length, each block's code is the repetition code (all zeros, all ones), and the
product covers every fingerprint within the sum of the blocks' radii. A
fingerprint is compared at its own anchor, the nearest, with all fingerprints
that are replicated there: a partner within d bits lies within the covering
radius plus d of that anchor. Counted by block this is sharper: a fingerprint
can only meet partners at anchors that it would have as nearest after d flips,
so it goes to those where the flips its blocks need sum to d at most.

Equal fingerprints are one before that. An anchor gives a spanning forest of its
links, not all pairs, and components come from star contractions over tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fleetlens.llm._common import ASCII_LOWER, chunks, ensure_checkpoint_dir, for_group, map_batches, texts

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Distinct fingerprints up to which blocks of these lengths are used, so that an anchor's load stays bounded.
BLOCK_LENGTHS = [(500_000, 7), (4_000_000, 5), (1 << 62, 3)]


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if over half of the shingles' hashes have it. No words: 0."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= k:
        return xxh64_intdigest(line, seed)
    end = np.cumsum([len(w) + 1 for w in words])
    begin, end = np.concatenate([[0], end[: -k]]).tolist(), (end[k - 1 :] - 1).tolist()
    n, counts = len(begin), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        h = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(begin[i : i + (1 << 16)], end[i : i + (1 << 16)], strict=True)], np.uint64)
        counts += _bits_set(h)
    return _over_half(counts, n)


def _bits_set(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _over_half(counts: np.ndarray, n: int) -> int:
    return int((np.uint64(1) << np.flatnonzero(2 * counts > n).astype(np.uint64)).sum())


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    return _over_half(sum((_bits_set(h[i : i + (1 << 16)]) for i in range(0, len(h), 1 << 16)), np.zeros(64, np.int64)), len(h))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint as long) for each row of ``docs`` (doc_id, text), and the columns ``keep``, which are longs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            fp = np.array([fingerprint(t) for t in texts(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp), *[b.column(c) for c in keep]], names=["doc_id", "fingerprint", *keep])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep), scan, ", ".join(["doc_id long, fingerprint long", *[f"{c} long" for c in keep]]))


class CoveringCode:
    """Product of repetition codes over blocks of ``length`` bits; bits beyond the last full block aren't used."""

    def __init__(self, length: int, distance: int) -> None:
        self.length, self.blocks, self.distance = length, 64 // length, distance
        sets = [c for r in range(distance + 1) for c in combinations(range(self.blocks), r)]
        self.member = np.array([[b in c for c in sets] for b in range(self.blocks)], np.int64)
        self.flip = np.array([sum(1 << b for b in c) for c in sets], np.int64)

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest anchor of each fingerprint, and the flips after which each block's nearest word changes."""
        mask = np.uint64((1 << self.length) - 1)
        ones = np.stack([np.bitwise_count((fp >> np.uint64(b * self.length)) & mask).astype(np.int64) for b in range(self.blocks)], 1)
        bit = ones > self.length // 2
        need = np.where(bit, ones, self.length - ones) - self.length // 2
        return (bit.astype(np.int64) << np.arange(self.blocks)).sum(1), need

    def replicas(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, index of the fingerprint, whether it is the nearest anchor) of all copies; the flip sets are few, so all are tried."""
        home, need = self.anchors(fp)
        i, s = np.nonzero(need @ self.member <= self.distance)
        return home[i] ^ self.flip[s], i, s == 0


def forest(home: np.ndarray, every: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between ``home`` and ``every``, which holds home too."""
    every = np.unique(every)
    label = np.arange(len(every))
    a, b = [], []
    step = max(1, (1 << 20) // max(len(every), 1))
    for i in range(0, len(home), step):
        near = np.bitwise_count(home[i : i + step, None] ^ every[None, :]) <= distance
        for r in np.flatnonzero(near.sum(1) > 1).tolist():
            roots = np.unique(label[np.flatnonzero(near[r])])
            if len(roots) > 1:
                label[np.isin(label, roots[1:])] = roots[0]
                a.append(np.full(len(roots) - 1, roots[0]))
                b.append(roots[1:])
    if not a:
        return every[:0], every[:0]
    return every[np.concatenate(a)], every[np.concatenate(b)]


def links(distinct: DataFrame, distance: int = DISTANCE, block_length: int | None = None) -> DataFrame:
    """(u, v), u < v: forests of the links between distinct ``fingerprint`` values, one an anchor."""
    n = distinct.count() if block_length is None else 0
    length = block_length or next(x for most, x in BLOCK_LENGTHS if n <= most)
    code = CoveringCode(length, distance)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1 << 14):
                fp = b.column("fingerprint").to_numpy()[i : i + (1 << 14)].view(np.uint64)
                anchor, at, home = code.replicas(fp)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[at].view(np.int64)), pa.array(home)], names=["anchor", "fingerprint", "home"])

    def compare(t: pa.Table) -> pa.Table:
        fp, home = t.column("fingerprint").to_numpy().view(np.uint64), t.column("home").to_numpy()
        u, v = forest(fp[home], fp, distance)
        u, v = u.view(np.int64), v.view(np.int64)
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    # each fingerprint becomes some forty rows: spread them before that
    spread = distinct.select("fingerprint").repartition(F.col("fingerprint"))
    return map_batches(spread, deal, "anchor long, fingerprint long, home boolean").groupBy("anchor").applyInArrow(for_group(compare), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root), the least node of each component, for all nodes of ``edges`` (u, v).

    Large and small stars in turn: each node's larger neighbours link to its
    least neighbour, then its smaller ones do. Every round is a table in the
    checkpoint folder, and rounds grow with the logarithm of a component.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct().checkpoint()
    sign = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        sign = now


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, block_length: int | None = None) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id, component) for each row of ``docs`` (doc_id, text).

    component_id is the least doc_id among all rows that links reach, null if all
    of them are null; ``component`` is the component's least fingerprint. A null
    text has no words: fingerprint zero. Repeated rows come back as often; extra
    columns are left aside.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    known = fingerprints(docs).checkpoint()
    distinct = known.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, distance, block_length))
    rooted = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("component"))
    smallest = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fingerprint", "component").join(smallest, "component")
    return known.join(classes, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, one row of each component: of those with the least doc_id one, chosen by its text and then its other columns. Rows without a doc_id stay only where a component has none but them. Columns may have any names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.select("doc_id", "text", row.alias("row"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_hash"))
    known = fingerprints(held, keep=("row_hash",))
    classes = near_duplicates(docs.select("doc_id", "text")).select("fingerprint", "component", "component_id").distinct()
    hexed = known.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))
    placed = hexed.join(classes, "fingerprint").where("doc_id <=> component_id")
    chosen = placed.groupBy("component").agg(F.min_by(F.struct("doc_id", "row_hash"), F.struct("doc_id", "row_hash")).alias("one")).select(F.col("one.row_hash").alias("row_hash"))
    left = held.join(chosen.distinct(), "row_hash", "left_semi").groupBy("row_hash").agg(F.first("row").alias("row"))
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
