"""Quality rules by compression bands.

Each text is compressed by zstandard as a whole and in fixed chunks, the last
partial one too. A ratio of raw to compressed bytes above its band means
repetition, one below it noise. The bands follow the length, since a frame has a
fixed cost and longer texts share more. One pass over the rows; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm._common import batch_of, chunks, map_batches, texts

LEVEL = 3
CHUNK = 1024
#: (bytes up to, lowest ratio, highest ratio) of whole texts, prose being about the middle; shorter texts aren't judged by their ratio.
BANDS = [
    (64, 0.0, 99.0),
    (128, 0.75, 2.2),
    (256, 0.95, 2.6),
    (512, 1.15, 3.0),
    (1024, 1.25, 3.4),
    (2048, 1.4, 3.8),
    (4096, 1.5, 4.2),
    (8192, 1.6, 4.6),
    (16384, 1.7, 5.0),
    (1 << 62, 1.8, 6.0),
]
#: The same for chunks: lower limits lie between prose and base64 of that length. A last piece of 64 bytes or less isn't judged.
CHUNK_BANDS = [
    (64, 0.0, 99.0),
    (128, 0.75, 2.2),
    (192, 1.06, 2.4),
    (256, 1.12, 2.6),
    (384, 1.2, 3.0),
    (512, 1.26, 3.0),
    (768, 1.3, 3.4),
    (1024, 1.33, 3.4),
]
#: The share of a text's bytes that may lie in chunks outside their band.
BAD_SHARE = 0.1
_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_LINE = re.compile(rb"[^\x20\x09-\x0D]")
SCHEMA = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunks", pa.int64())])
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks long"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """Words within windows of k words that occur at least twice."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += (ids[j : j + n] + np.uint64(1)) * _MULTIPLIERS[j]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    if any((ids[a + j] != ids[b + j]).any() for j in range(k)):  # two windows share a hash: count by the words themselves
        where: dict[tuple[bytes, ...], list[int]] = {}
        for i in range(n):
            where.setdefault(tuple(words[i : i + k]), []).append(i)
        a = b = np.array([i for x in where.values() if len(x) > 1 for i in x], np.int64)
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.union1d(a, b)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + k, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def base_counts(t: bytes) -> tuple[int, int, int, int, int]:
    words = t.split()
    chars = len(t.translate(None, _SPACE + bytes(range(0x80, 0xC0))))  # code points: all bytes but continuations
    symbols = len(t) - len(t.translate(None, _SYMBOLS))
    lines = [x for x in t.split(b"\n") if _LINE.search(x)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _band(bands: list[tuple[int, float, float]], n: int) -> tuple[float, float]:
    return next((a, b) for upto, a, b in bands if n <= upto)


def _fits(chunk: bytes, z: zstandard.ZstdCompressor) -> bool:
    low, high = _band(CHUNK_BANDS, len(chunk))
    return low <= len(chunk) / len(z.compress(chunk)) <= high


def judge(t: bytes, z: zstandard.ZstdCompressor) -> tuple[float, int, bool]:
    """Ratio of the whole text, its chunks outside their band, and whether it passes."""
    if not t:
        return 0.0, 0, False
    ratio = len(t) / len(z.compress(t))
    low, high = _band(BANDS, len(t))
    pieces = [t[i : i + CHUNK] for i in range(0, len(t), CHUNK)]
    bad = [len(x) for x in pieces if not _fits(x, z)]
    return ratio, len(bad), low <= ratio <= high and sum(bad) <= BAD_SHARE * len(t)


def _judged(raw: list[bytes]) -> list[tuple]:
    z = zstandard.ZstdCompressor(level=LEVEL)
    rows = []
    for t in raw:
        n, chars, symbols, lines, repeats = base_counts(t)
        failed = n < 10 or 100 * repeats > 20 * n
        ratio, bad, fine = judge(t, z)
        rows.append((n, chars, symbols, lines, repeats, failed, not failed and fine, ratio, bad))
    return rows


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, bad_chunks) for each row of ``docs`` (doc_id, text).

    A null text is an empty one: no words, so not kept. Repeated rows come back
    as often; extra columns are left aside.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield batch_of(SCHEMA, [b.column("doc_id"), *(list(c) for c in zip(*_judged(texts(b.column("text"))), strict=True))])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan, DDL)


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the rows that the rules reject."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield b.filter(pa.array([r[6] for r in _judged(texts(b.column("text")))]))

    return map_batches(docs, scan, docs.schema)
