"""What the text operators share: reading tables, word rules and bounded Arrow chunks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ends a word in the plain rule: blank and the controls 9 to 13. ``bytes.split()`` splits at the same six.
WORD = "[^\\x20\\x09-\\x0D]+"
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text bytes that a kernel works on at once.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder that the cluster names; one of our own only in local mode, where every task sees it, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not (context.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or "/tmp/checkpoints/fleetlens")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut at about ``limit`` text bytes, so that memory doesn't follow the batch size; a longer text is a chunk of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        group = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def ascii_lower(c):
    """Only A-Z change, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


#: Spark's bound for the bytes of an Arrow batch, which is in memory several times over.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate rows wherever it is stored."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of bounded bytes; a session with a smaller bound keeps it."""
    conf = df.sparkSession.conf
    now = conf.get(BATCH_CONF).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(BATCH_CONF, str(BATCH_BYTES))

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in f(batches):
            yield b
            release()

    return df.mapInArrow(released, schema)


def for_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of one group that leaves no freed memory behind."""

    def one(t: pa.Table) -> pa.Table:
        out = f(t)
        release()
        return out

    return one


def for_groups(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a pair of groups."""

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        release()
        return out

    return two
