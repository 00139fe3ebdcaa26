"""Facts about groups of a document's rows, given back to each row of the group.

A window would sort all rows anew for each list of keys. Here a document's rows
stand together in one task, in their order, so that groups are found by numbers
within an Arrow batch of whole documents. What counts for a fact is a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

#: Rows handed on at once: what a document's rows share is repeated in each.
_ROWS = 2_000


class Fact(NamedTuple):
    """``kind`` of ``value`` over the document's rows that agree in ``keys``, as in SQL; ``has`` is whether it is ever true, ``latest`` the last one up to the row, whose groups stand together."""

    kind: str
    value: Column
    keys: tuple[str, ...] = ()


_KINDS = {"has": lambda _: BooleanType(), "count": lambda _: LongType(), "max": lambda t: t, "latest": lambda t: t, "collect_set": lambda t: ArrayType(t), "collect_list": lambda t: ArrayType(t)}


def fold(rows: DataFrame, facts: dict[str, Fact]) -> DataFrame:
    """``rows`` (doc_id, ...) with a column for each fact; rows of a document stand together in a task."""
    given = rows.withColumns({f"_{n}": f.value for n, f in facts.items()})
    types = {f.name: f.dataType for f in given.schema}
    schema = StructType([*rows.schema.fields, *[StructField(n, _KINDS[f.kind](types[f"_{n}"])) for n, f in facts.items()]])
    asked, own = {n: (f.kind, f.keys) for n, f in facts.items()}, rows.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _documents(batches):
            yield from _folded(t, asked, own)

    return given.mapInArrow(scan, schema)


def _numbers(c: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return c.fill_null(-(1 << 31)).to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.fill_null(-(1 << 31)).to_numpy()


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole documents, those of a batch at once."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = _numbers(b.column("doc_id"))
        turns = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        goes_on = bool(kept) and _numbers(kept[-1].column("doc_id"))[-1] == ids[0]
        if not len(turns) and (goes_on or not kept):
            kept.append(b)
            continue
        at = int(turns[-1]) if len(turns) else 0
        yield pa.Table.from_batches([*kept, b.slice(0, at)])
        kept = [b.slice(at)]
    if kept:
        yield pa.Table.from_batches(kept)


def _folded(t: pa.Table, asked: dict[str, tuple[str, tuple[str, ...]]], own: list[str]) -> Iterator[pa.RecordBatch]:
    ids = _numbers(t.column("doc_id"))
    groups: dict[tuple[str, ...], np.ndarray] = {(): np.concatenate([[0], np.cumsum(ids[1:] != ids[:-1])])}
    made: list[tuple[pa.Array, np.ndarray | None]] = []
    for name, (kind, keys) in asked.items():
        for i, key in enumerate(keys):
            if keys[: i + 1] not in groups:
                n = _numbers(t.column(key)).astype(np.int64)
                n -= n.min()
                groups[keys[: i + 1]] = np.unique(groups[keys[:i]] * (n.max() + 1) + n, return_inverse=True)[1]
        g, c = groups[keys], t.column(f"_{name}")
        made.append((_latest(c, g), None) if kind == "latest" else (_of_groups(kind, c, g), g))
    rows = t.select(own)
    for at in range(0, t.num_rows, _ROWS):
        part = rows.slice(at, _ROWS).combine_chunks()
        facts = [v.slice(at, _ROWS) if g is None else v.take(pa.array(g[at : at + _ROWS])) for v, g in made]
        yield from pa.Table.from_arrays([*part.columns, *facts], names=[*own, *asked]).to_batches()


def _of_groups(kind: str, c: pa.ChunkedArray, g: np.ndarray) -> pa.Array:
    """The fact of each group."""
    n = int(g.max()) + 1
    if kind in ("has", "count"):
        times = np.bincount(g[c.fill_null(False).to_numpy()], minlength=n)
        return pa.array(times > 0 if kind == "has" else times.astype(np.int64))
    at = np.flatnonzero(c.is_valid().to_numpy())
    found = zip(g[at].tolist(), c.take(pa.array(at)).to_pylist(), strict=True)
    if kind == "max":
        best: list = [None] * n
        for i, v in found:
            if best[i] is None or v > best[i]:
                best[i] = v
        return pa.array(best, c.type)
    each: list[list] = [[] for _ in range(n)]
    for i, v in dict.fromkeys(found) if kind == "collect_set" else found:
        each[i].append(v)
    return pa.array(each, pa.list_(c.type))


def _latest(c: pa.ChunkedArray, g: np.ndarray) -> pa.Array:
    at = np.maximum.accumulate(np.where(c.is_valid().to_numpy(), np.arange(len(g)), -1))
    begins = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
    begin = np.repeat(begins, np.diff([*begins, len(g)]))
    return c.combine_chunks().take(pa.array(np.maximum(at, 0), mask=at < begin))
