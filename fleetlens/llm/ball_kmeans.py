"""Ball k-means over integer vectors: Lloyd's rounds, exactly, with few distances.

Vectors lie in packed blocks with the cluster that each was in. In a round a
block's members of a cluster are a ball around its new centroid, whose radius
is their largest distance. Another centroid is the ball's neighbour if it lies
nearer than twice the radius; no other can take a member. Neighbours in order
of distance cut the ball into a stable core, nearer to the centroid than half
way to the first of them, and annuli: members of the n-th are compared with
the first n neighbours only. Distances are whole numbers, so that ties count.

The driver sees k centroids a round, whose sums are aggregated from one row of
sums a block; blocks stay cached by their executors, and what is lost is
computed again from the blocks of the round before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm._common import blob, map_batches

#: Vectors of a block.
BLOCK = 4096
SCALE = 1024
#: Components are cut to this after scaling, so that squared distances of 64 of them fit a long.
LARGEST = 1 << 27
_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), ("clusters", pa.binary()), ("counts", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())), ("inertia", pa.list_(pa.int64())), ("compared", pa.int64())])
_BLOCK_DDL = "ids array<long>, points binary, clusters binary, counts array<long>, sums array<long>, inertia array<long>, compared long"


def _whole(x: Column) -> Column:
    return F.floor(SCALE * F.greatest(F.least(x.cast("double"), F.lit(LARGEST / SCALE)), F.lit(-LARGEST / SCALE))).cast("int")


def vectors(embeddings: DataFrame, size: int) -> DataFrame:
    """(vec_id, whole array<int>): the vectors of ``size`` components without a null or non-finite one, each component scaled and floored."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return embeddings.where(F.coalesce((F.size(x) == size) & fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, _whole).alias("whole"))


def _squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = points - centre
    return np.einsum("ij,ij->i", apart, apart)


def reassigned(points: np.ndarray, clusters: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance to it, distances computed) of each point, from the cluster that each was in.

    Ties go to the smaller number. Comparisons of distances stand on whole
    squares: a point at distance d of its own centroid can't be nearer to, or
    as near to, another at D if 2d < D.
    """
    between = np.stack([_squares(centroids, c) for c in centroids])
    found, best, computed = clusters.copy(), np.empty(len(points), np.int64), len(points)
    for i in np.unique(clusters):
        members = np.flatnonzero(clusters == i)
        own = points[members]
        to_own = _squares(own, centroids[i])
        nearest, least = np.full(len(members), i, clusters.dtype), to_own.copy()
        ball = 4 * int(to_own.max())  # (2 radius)^2
        for j in np.argsort(between[i], kind="stable"):  # neighbours, nearest first; the annuli shrink outwards
            if j == i or between[i][j] > ball:
                continue
            outer = np.flatnonzero(between[i][j] // 4 <= to_own)
            if not len(outer):
                break
            far = _squares(own[outer], centroids[j])
            computed += len(outer)
            closer = (far < least[outer]) | ((far == least[outer]) & (j < nearest[outer]))
            least[outer[closer]], nearest[outer[closer]] = far[closer], j
        found[members], best[members] = nearest, least
    return found, best, computed


def _row(ids: pa.Array, points: np.ndarray, clusters: np.ndarray, distances: np.ndarray, k: int, computed: int) -> pa.RecordBatch:
    counts = np.bincount(clusters, minlength=k).astype(np.int64)
    sums = np.zeros((k, points.shape[1]), np.int64)
    np.add.at(sums, clusters, points)
    near = [int(distances[clusters == i].astype(object).sum()) if counts[i] else 0 for i in range(k)]
    return pa.RecordBatch.from_pylist([{"ids": ids.to_pylist(), "points": blob(points.astype(np.int32)), "clusters": blob(clusters.astype(np.uint8)), "counts": counts.tolist(), "sums": sums.ravel().tolist(), "inertia": [min(x, (1 << 63) - 1) for x in near], "compared": computed}], schema=_BLOCK)


def _packed(kept: DataFrame, size: int, centroids: np.ndarray) -> DataFrame:
    """Blocks of vectors, each assigned by comparing it with all centroids, as no ball is known yet."""
    k = len(centroids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                b = whole.slice(a, BLOCK)
                points = b.column("whole").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, size)
                to_all = np.stack([_squares(points, c) for c in centroids], axis=1)
                clusters = to_all.argmin(axis=1).astype(np.uint8)
                yield _row(b.column("vec_id"), points, clusters, to_all[np.arange(len(points)), clusters], k, to_all.size)

    return map_batches(kept, pack, _BLOCK_DDL)


def _moved(blocks: DataFrame, size: int, centroids: np.ndarray) -> DataFrame:
    """The blocks after another assignment."""
    k = len(centroids)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, packed, before in zip(b.column("ids"), b.column("points").to_pylist(), b.column("clusters").to_pylist(), strict=True):
                points = np.frombuffer(packed, np.int32).reshape(-1, size).astype(np.int64)
                clusters, distances, computed = reassigned(points, np.frombuffer(before, np.uint8), centroids)
                yield _row(ids.values, points, clusters, distances, k, computed)

    return map_batches(blocks, move, _BLOCK_DDL)


def _totals(blocks: DataFrame, column: str) -> list[int]:
    """A column of arrays summed over all blocks; as many rows as an array is long."""
    rows = blocks.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    return [int(r["x"]) for r in sorted(rows, key=lambda r: r["at"])]


def _centred(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's next place: the floor of its vectors' mean by component; an empty one stays."""
    k, size = centroids.shape
    both = _totals(blocks.select(F.concat("counts", "sums").alias("both")), "both")
    if not both:
        return centroids
    counts, sums = both[:k], both[k:]
    return np.array([[sums[i * size + j] // counts[i] if counts[i] else int(centroids[i][j]) for j in range(size)] for i in range(k)], np.int64)


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ``seed:vec_id`` has the smallest SHA-256, in its order; equal ids by their components. A null id is an empty text."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(key.alias("key"), "whole").orderBy("key", "whole").limit(k).collect()
    return np.array([r["whole"] for r in rows], np.int64)


def cluster(embeddings: DataFrame, k: int = 8, size: int = 64, rounds: int = 10, seed: str = "3") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of ``embeddings`` (vec_id, embedding) that has exactly ``size`` components, none null or non-finite.

    Components beyond 131072 count as that, which keeps squared distances of 64
    components in a long; inertia beyond a long is the greatest long. Repeated
    rows are vectors of their own, with equal results; a null id comes back as
    it is. With fewer vectors than ``k`` there are as many centroids, with none
    no rows come back. ``k`` is at most 256, as a cluster is a byte here. Extra columns are left aside.
    """
    if not 0 < k <= 256:
        raise ValueError("k is from 1 to 256")
    kept = vectors(embeddings, size)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).limit(0)
    blocks = _packed(kept, size, centroids).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(rounds):
        centroids = _centred(blocks, centroids)
        moved = _moved(blocks, size, centroids).persist(StorageLevel.MEMORY_AND_DISK)
        moved.count()
        blocks.unpersist()
        blocks = moved
    return _assigned(blocks, centroids, size)


_OUT = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string())])


def _assigned(blocks: DataFrame, centroids: np.ndarray, size: int) -> DataFrame:
    """Vectors one by one from their last blocks."""
    inertia, most = _totals(blocks, "inertia"), (1 << 63) - 1
    total = min(sum(inertia), most)
    inertia = np.array([min(x, most) for x in inertia], np.int64)
    shas = pa.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, packed, own in zip(b.column("ids"), b.column("points").to_pylist(), b.column("clusters").to_pylist(), strict=True):
                points, clusters = np.frombuffer(packed, np.int32).reshape(-1, size).astype(np.int64), np.frombuffer(own, np.uint8)
                apart = points - centroids[clusters]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(clusters.astype(np.int32)), pa.array(np.einsum("ij,ij->i", apart, apart)), pa.array(inertia[clusters]), pa.array(np.full(len(clusters), total, np.int64)), shas.take(pa.array(clusters.astype(np.int64)))], schema=_OUT)

    return map_batches(blocks.select("ids", "points", "clusters"), unpack, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
