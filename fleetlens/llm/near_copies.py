"""Near copies by exact similarity of five-word shingles, for stages without a contract of their own.

Texts whose sets of shingles have a Jaccard similarity of 0.8 or more are
linked. Candidates come from op 9's anchors, over fingerprints of the five-word
shingles, as far as these differ in 3 bits or fewer; at a similarity of 0.8 they
lie some 7 to 13 bits apart, and a covering code for these distances sends each
fingerprint to most of its anchors. Those further apart so come from bands of
min-hashes: a pair at 0.8 shares none of BANDS bands of ROWS hashes in
(1 - 0.8**6)**32, 1 of 17000, and closer pairs share one surer. Candidates are
gathered by component and compared by their whole sets, so that nothing is
linked on an estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fleetlens.llm._common import ASCII_LOWER, blob, chunks, ensure_checkpoint_dir, for_group, map_batches, texts
from fleetlens.llm._repeats import MIN_ID
from fleetlens.llm.simhash_dedup import components, links, majority

SHINGLE, SEED = 5, 42
#: A similarity of NUM / DEN at least is a link.
NUM, DEN = 4, 5
ROWS, BANDS = 6, 32
_RANDOM = np.random.default_rng(SEED)
_XOR, _TIMES = _RANDOM.integers(0, 1 << 64, (2, ROWS * BANDS), np.uint64)
_TIMES |= np.uint64(1)


def normal(text: bytes) -> bytes:
    """The words in lower case, a blank between them."""
    return b" ".join(text.translate(ASCII_LOWER).split())


def shingles(line: bytes, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the different windows of k words of a ``normal`` text, ascending; a shorter text is one window, one without words has none."""
    words = line.split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= k:
        return np.array([xxh64_intdigest(line, SEED)], np.uint64)
    end = np.cumsum([len(w) + 1 for w in words])
    begin = np.concatenate([[0], end[:-k]]).tolist()
    return np.unique(np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(begin, (end[k - 1 :] - 1).tolist(), strict=True)], np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """A hash of each band's least values; no shingles, no bands."""
    if not len(found):
        return found
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1024):
        least = np.minimum(least, ((found[i : i + 1024, None] ^ _XOR) * _TIMES).min(0))
    return np.array([xxh64_intdigest(blob(x), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between non-empty ``sets``: each is compared with all that none has reached yet."""
    sizes = np.array([len(x) for x in sets])
    every, left, edges = np.concatenate(sets), np.arange(len(sets)), []
    starts = np.cumsum(sizes) - sizes
    queue: list[int] = []
    while len(left):
        take = np.zeros(len(left), bool)
        if queue:
            x = queue.pop()
            at = np.minimum(np.searchsorted(sets[x], every), sizes[x] - 1)
            both = np.add.reduceat((sets[x][at] == every).astype(np.int64), starts)
            take = DEN * both >= NUM * (sizes[x] + sizes[left] - both)
            edges += [(x, y) for y in left[take].tolist()]
        else:
            take[0] = True
        if take.any():
            queue += left[take].tolist()
            every = every[np.repeat(~take, sizes[left])]
            left = left[~take]
            starts = np.cumsum(sizes[left]) - sizes[left]
    return edges


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, component_id, component) for each row of ``docs`` (doc_id, text).

    component_id is the least doc_id among all rows that links reach, null if all
    of them are null; ``component`` is a hash of the component's. Texts with the
    same shingles are one before that; so are those without words, nulls too.
    """
    ensure_checkpoint_dir(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in chunks(batches):
            lines = [normal(t) for t in texts(b.column("text"))]
            found = [shingles(x) for x in lines]
            node = np.array([xxh64_intdigest(blob(x), SEED) for x in found], np.uint64).view(np.int64)
            keys = [bands(x).view(np.int64) for x in found]
            prints = [int(np.uint64(majority(x)).view(np.int64)) if len(x) else None for x in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(node), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.int64()), pa.array([z.compress(x) for x in lines], pa.binary())], names=["doc_id", "text_hash", "node", "bands", "fingerprint", "line"])

    def compare(t: pa.Table) -> pa.Table:
        node, z = t.column("node").to_numpy(), zstandard.ZstdDecompressor()
        edges = np.array(linked([shingles(z.decompress(x)) for x in t.column("line").to_pylist()]), np.int64).reshape(-1, 2)
        return pa.table({"u": node[edges[:, 0]], "v": node[edges[:, 1]]})

    known = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"), scan, "doc_id long, text_hash long, node long, bands array<long>, fingerprint long, line binary").checkpoint()
    keys = known.select("node", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("node").alias("m"), F.max("node").alias("x")).where("m != x").select("band", "m")
    banded = keys.join(shared, "band").where("node != m").select(F.col("node").alias("u"), F.col("m").alias("v"))
    prints = known.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("node").alias("m"))
    same = known.join(prints, "fingerprint").where("node != m").select(F.col("node").alias("u"), F.col("m").alias("v"))
    near = links(prints).join(prints.select(F.col("fingerprint").alias("u"), F.col("m").alias("node_u")), "u").join(prints.select(F.col("fingerprint").alias("v"), F.col("m").alias("node_v")), "v").select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
    candidates = components(banded.unionByName(same).unionByName(near).distinct())
    sets = known.select("node", "line").join(candidates, "node").groupBy("root", "node").agg(F.first("line").alias("line"))
    roots = components(sets.groupBy("root").applyInArrow(for_group(compare), "u long, v long"))
    distinct = known.groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = distinct.join(roots.withColumnRenamed("root", "of"), "node", "left").select("node", "least", F.coalesce("of", "node").alias("component"))
    smallest = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    return known.select("doc_id", "text_hash", "node").join(rooted.select("node", "component").join(smallest, "component"), "node").select("doc_id", "text_hash", "component_id", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, one row of each component: that of the least doc_id, or one without a doc_id where a component has none but these.

    Columns may have any names. Of rows that agree in doc_id and text, whatever
    else they hold, one stays: the least by its other columns' JSON, so that reruns agree.
    """
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_ID)).alias("_id")
    chosen = near_copies(docs.select("doc_id", "text")).where("doc_id <=> component_id").groupBy("component").agg(F.first(row_id).alias("_id"), F.min("text_hash").alias("_hash"))
    # texts move once, and with them the other columns in one struct: equal keys share a partition already
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = F.struct("doc_id", "text", *[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(rest)])
    keyed = docs.select(row_id, F.xxhash64("text").alias("_hash"), own.alias("_row"), (F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(rest)])) if rest else F.lit("")).alias("_rest"))
    kept = keyed.join(chosen.select("_id", "_hash"), ["_id", "_hash"], "left_semi").groupBy("_id", "_hash").agg(F.min_by("_row", "_rest").alias("_row"))
    named = {c: F.col("_row").getField(f"f{rest.index(c)}" if c in rest else c).alias(c) for c in docs.columns}
    return kept.select(*named.values())
