"""Token counts by heap-and-linked-list byte-pair merging.

Pairs of neighbours wait in a heap by rank; the lowest is merged, its new
neighbours are pushed, and entries whose symbols have changed are passed over.
The count is the initial symbols less the merges; no identifiers are made.
Pieces of this kind of model hold the blank sign only at their start, so that a
text's stretches between blanks merge on their own, and a bounded table of
stretch counts spares most of the work. One pass; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm._common import batch_of, chunks, map_batches

BLANK = "▁"
#: Stretch counts that a worker keeps, and the signs of the longest of them.
CACHE, SHORT = 400_000, 64
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
DDL = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PieceCounter:
    """Counts pieces of a sentencepiece BPE model with byte fallback and an identity normaliser. The library gives the vocabulary only."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ranks = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}  # higher scores merge first
        if any(BLANK in p.lstrip(BLANK) for p in self.ranks):
            raise ValueError("a piece holds a blank sign after other signs; stretches can't be counted apart")
        if sp.normalize(" ﬁ x\t") != f"{BLANK}{BLANK}ﬁ{BLANK}x\t":
            raise ValueError("the model's normaliser isn't the identity with a blank in front")
        self.alone = {c for p in self.ranks for c in p if len(p) == 1}
        used = {c for p in self.ranks for c in p}
        self.outside = "\n" not in used  # then a line end is a token of one byte that nothing merges with
        #: a run of blank signs and what follows it up to the next run, or line end
        self.stretch = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+" if self.outside else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.known = lru_cache(CACHE)(self.merge)

    def count(self, s: str) -> int:
        return self.known(s) if len(s) <= SHORT else self.merge(s)

    def merge(self, s: str) -> int:
        """Tokens of a stretch: symbols less merges; a symbol left over that isn't a piece counts its UTF-8 bytes."""
        rank, n = self.ranks.get, len(s)
        if n == 1 or s in self.ranks and n == 2:
            return 1 if s in self.ranks else len(s.encode())
        sym, left, right = list(s), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(s[i : i + 2])) is not None]
        heapify(heap)
        count = n
        while heap:
            _, i, size = heappop(heap)
            j = right[i]
            if not sym[i] or j >= n or len(sym[i]) + len(sym[j]) != size:  # a symbol has gone or grown since
                continue
            merged = sym[i] + sym[j]
            sym[i], sym[j] = merged, ""
            count -= 1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank(merged + sym[k])) is not None:
                    heappush(heap, (r, i, size + len(sym[k])))
            if (h := left[i]) >= 0 and (r := rank(sym[h] + merged)) is not None:
                heappush(heap, (r, h, size + len(sym[h])))
        return count + sum(len(c.encode()) - 1 for c in sym if len(c) == 1 and c not in self.alone)

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        text = BLANK + text.replace(" ", BLANK)
        lines = text.count("\n") if self.outside else 0
        return lines + sum(map(self.count, self.stretch.findall(text)))


_counters: dict[str, PieceCounter] = {}


def counter(model: str) -> PieceCounter:
    """One a worker; its model comes with the job where the path isn't there."""
    if model not in _counters:
        _counters[model] = PieceCounter(model)
    return _counters[model]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs`` (doc_id, text).

    ``model`` is the path of a sentencepiece BPE model; it is sent to the
    executors with the job. A null text is an empty one and has no tokens.
    Repeated rows come back as often; extra columns are left aside.
    """
    docs.sparkSession.sparkContext.addFile(model)
    name = model.rpartition("/")[2]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(SparkFiles.get(name))
        for b in chunks(batches):
            rows = [x or "" for x in b.column("text").to_pylist()]
            n = [pieces.tokens(t) for t in rows]
            yield batch_of(SCHEMA, [b.column("doc_id"), [len(t.encode()) for t in rows], n, [x > limit for x in n]])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan, DDL)
