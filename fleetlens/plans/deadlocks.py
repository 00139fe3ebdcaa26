"""Deadlock graphs as rows: processes, and who waits for whom over what."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PROCESS = [("deadlock_id", pa.int64()), ("process_id", pa.string()), ("spid", pa.string()), ("is_victim", pa.bool_()), ("isolation_level", pa.string()), ("lock_mode", pa.string()), ("wait_resource", pa.string()), ("sql", pa.string())]
_EDGE = [("deadlock_id", pa.int64()), ("resource", pa.string()), ("object_name", pa.string()), ("index_name", pa.string()), ("owner_id", pa.string()), ("owner_mode", pa.string()), ("waiter_id", pa.string()), ("waiter_mode", pa.string())]


def _ddl(fields: list) -> str:
    kinds = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
    return ", ".join(f"{n} {kinds[t]}" for n, t in fields)


def last_graph(xml: str | None) -> ElementTree.Element | None:
    """The last deadlock graph of an event's text, also one that stands in it as escaped text; None where there is none or it is broken."""
    try:
        root = ElementTree.fromstring(xml) if xml else None
    except ElementTree.ParseError:
        return None
    if root is None:
        return None
    graphs = [e for e in root.iter() if e.tag.rsplit("}", 1)[-1] in ("deadlock", "deadlock-graph")]
    for e in root.iter():
        if e.text and "<deadlock" in e.text and (inner := last_graph(e.text.strip())) is not None:
            graphs.append(inner)
    # a graph may wrap another; the innermost one has the lists
    graphs = [g for g in graphs if g.find("{*}process-list") is not None or g.find("{*}resource-list") is not None]
    return graphs[-1] if graphs else None


def _processes(deadlock_id: int | None, graph: ElementTree.Element) -> Iterator[tuple]:
    pointed = graph.get("victim") or ""
    named = {v.get("id") for v in graph.iterfind("{*}victim-list/{*}victimProcess")}
    for p in graph.iterfind("{*}process-list/{*}process"):
        own = p.get("id") or ""
        victim = (p.get("status") or "").lower() == "victim" or bool(own) and (pointed.endswith(own) or own in named)
        buffer = p.find("{*}inputbuf")
        text = " ".join((buffer.text or "").split()) if buffer is not None else None
        yield deadlock_id, own, p.get("spid"), victim, p.get("isolationlevel"), p.get("lockMode"), p.get("waitresource"), text


def _edges(deadlock_id: int | None, graph: ElementTree.Element) -> Iterator[tuple]:
    for r in graph.iterfind("{*}resource-list/*"):
        kind = r.tag.rsplit("}", 1)[-1]
        for owner in r.iterfind("{*}owner-list/{*}owner"):
            for waiter in r.iterfind("{*}waiter-list/{*}waiter"):
                yield deadlock_id, kind, r.get("objectname"), r.get("indexname"), owner.get("id"), owner.get("mode"), waiter.get("id"), waiter.get("mode")


def _rows(events: DataFrame, fields: list, of) -> DataFrame:
    schema = pa.schema(fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row for i, x in zip(b.column("deadlock_id").to_pylist(), b.column("xml").to_pylist(), strict=True) if (g := last_graph(x)) is not None for row in of(i, g)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return events.select(F.col("deadlock_id").cast("long").alias("deadlock_id"), "xml").mapInArrow(scan, _ddl(fields))


def processes(events: DataFrame) -> DataFrame:
    """A row a process of the last graph of each of ``events`` (deadlock_id, xml); broken and null texts have none."""
    return _rows(events, _PROCESS, _processes)


def edges(events: DataFrame) -> DataFrame:
    """A row for each owner and waiter of a resource."""
    return _rows(events, _EDGE, _edges)


def summary(events: DataFrame) -> DataFrame:
    """(deadlock_id, victims, resources, reader_writer, parallel): the graph's gist."""
    writes = F.col("owner_mode").rlike("^[XU]|IX")
    reads = F.col("waiter_mode").rlike("^(S|IS)")
    e = edges(events).groupBy("deadlock_id").agg(F.array_sort(F.collect_set("object_name")).alias("resources"), F.coalesce(F.max(writes & reads), F.lit(False)).alias("reader_writer"), F.max(F.col("resource") == "exchangeEvent").alias("parallel"))
    p = processes(events).groupBy("deadlock_id").agg(F.array_sort(F.collect_set(F.when(F.col("is_victim"), F.col("process_id")))).alias("victims"))
    none = F.array().cast("array<string>")
    return p.join(e, "deadlock_id", "full").select("deadlock_id", F.coalesce("victims", none).alias("victims"), F.coalesce("resources", none).alias("resources"), F.coalesce("reader_writer", F.lit(False)).alias("reader_writer"), F.coalesce("parallel", F.lit(False)).alias("parallel"))
