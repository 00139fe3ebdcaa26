"""WARC archives of pages, read back and merged into capture histories.

Spark writes the archives: a record is one string, and the separator of a text
table is WARC's own end of a record, so that a committed part file is a WARC
file and a lost task leaves nothing behind. Reading goes by Content-Length,
file by file. The captures of an archive, sorted by URL key and time, are a
run. Ranges of (key, time, page) deal the runs' pieces to tasks, so that one
URL spreads too, and each task merges its pieces with a tree of losers. What
comes out is in order within a range and from range to range.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm._common import batch_of, map_batches

#: Payloads under so many bytes are always stored; the ``HOT`` payloads on most pages are looked up by broadcast, so that any other is on one page in ``HOT`` at most.
LEAST_BYTES, HOT = 100, 1000
#: Records of an archive at most; an archive is one task's to read.
RECORDS = 5_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"
SCHEMA = pa.schema([("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
DDL = "url_key string, captured_at string, page_id long, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, captured_at) with payload_bytes, payload_digest and, on revisits, refers_to.

    Payloads move once, by digest. Those of hot digests don't: they are looked
    up in a broadcast table and dealt by page, so that a payload on a third of
    all pages isn't one task's.
    """
    p = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2(F.col("html").cast("binary"), 256)})
    groups = p.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")
    hot = groups.orderBy(F.desc("n"), "payload_digest").limit(HOT).select(F.col("payload_digest").alias("hot_digest"), F.col("first").alias("hot_first"))
    rest = groups.select(F.col("payload_digest").alias("key"), "first")
    looked = p.join(F.broadcast(hot), F.col("payload_digest") == F.col("hot_digest"), "left")
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))  # no digest
    joined = looked.withColumn("key", F.when(F.col("hot_digest").isNull(), F.col("payload_digest")).otherwise(own)).join(rest, "key", "left")
    first = F.coalesce("hot_first", "first")
    return joined.select("page_id", "url", "html", "captured_at", "payload_bytes", "payload_digest", F.when(first.isNotNull() & ~first.eqNullSafe(F.col("page_id")), first).alias("refers_to"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(page: Column) -> Column:
    return F.concat(F.lit(f"<{ID}"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _encoded(url: Column) -> Column:
    """A URL fit for a header line: control characters as %XX."""
    for i in (*range(32), 127):
        url = F.replace(url, F.lit(chr(i)), F.lit(f"%{i:02X}"))
    return url


def records(captures: DataFrame) -> DataFrame:
    """(record) of ``with_revisits``: a WARC record without the line ends that close it. A revisit has the HTTP head only, whose Content-Length is the full payload's."""
    revisit, size = F.col("refers_to").isNotNull(), F.col("payload_bytes").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", size), F.lit("\r\n"))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    when = F.date_format(F.to_utc_timestamp("captured_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    url = F.when(F.col("url").rlike("[\\x00-\\x1F\\x7F]"), _encoded(F.col("url"))).otherwise(F.col("url"))
    told = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", _urn(F.col("page_id"))),
        F.coalesce(_line("WARC-Date", when), F.lit("")), F.coalesce(_line("WARC-Target-URI", url), F.lit("")), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _urn(F.col("refers_to"))))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"), _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return captures.select(F.concat(told, block).alias("record"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes ``pages`` (page_id, url, html, captured_at timestamp) as gzipped WARC files under ``path``, a folder that all executors share."""
    records(with_revisits(pages)).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


class Broken(ValueError):
    """An archive doesn't hold what its headers say."""


def _lines(stream: io.BufferedIOBase, first: bytes, what: str) -> tuple[dict[str, str], int]:
    """Header fields up to the empty line, and their bytes."""
    found, size = {}, len(first)
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Broken(f"{what}: a header line without a colon")
        found[name.strip().lower()] = value.strip()
        size += len(line)
    return found, size + len(line)


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(f"<{ID}(-?\\d+)>", urn or "")
    return int(found[1]) if found else None


class _Inflated(io.RawIOBase):
    """A gzipped file's bytes, unpacked as they are asked for, over all of its members."""

    def __init__(self, packed: memoryview) -> None:
        self.packed, self.at, self.gz, self.held = packed, 0, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        while not self.held:
            if self.gz.eof:
                self.at -= len(self.gz.unused_data)
                self.gz = zlib.decompressobj(31)
            if self.at >= len(self.packed):
                return 0
            piece = self.packed[self.at : self.at + (1 << 16)]
            self.at += len(piece)
            self.held = self.gz.decompress(piece)
        n = min(len(into), len(self.held))
        into[:n], self.held = self.held[:n], self.held[n:]
        return n


def _captures(name: str, packed: memoryview) -> Iterator[dict]:
    """The captures of an archive; the digest of a stored payload is computed anew and must be the header's. Offsets count unpacked bytes."""
    stream, at = io.BufferedReader(_Inflated(packed), 1 << 16), 0
    while first := stream.readline():
        if not first.startswith(b"WARC/1."):
            raise Broken(f"{name}: no record at {at}")
        told, size = _lines(stream, first, name)
        length = int(told["content-length"])
        http = stream.readline()
        fields, head = _lines(stream, http, name)
        sha, left = hashlib.sha256(), length - head
        while left > 0 and (piece := stream.read(min(left, 1 << 20))):
            sha.update(piece)
            left -= len(piece)
        if left or stream.read(4) != END.encode():
            raise Broken(f"{name}: the record at {at} isn't as long as it says")
        kind, digest, payload = told["warc-type"], told["warc-payload-digest"].removeprefix("sha256:"), int(fields["content-length"])
        if kind == "response" and (sha.hexdigest() != digest or payload != length - head):
            raise Broken(f"{name}: the payload at {at} isn't what its header says")
        yield {"url_key": url_key(told.get("warc-target-uri")), "captured_at": told.get("warc-date"), "page_id": _page(told["warc-record-id"]), "archive": name, "offset": at, "length": size + length, "payload_bytes": payload, "payload_digest": digest, "record_type": kind, "refers_to": _page(told.get("warc-refers-to"))}
        at += size + length + 4


def url_key(url: str | None) -> str:
    """The key that sorts a site's pages together: host labels reversed, then path and query, without scheme, ``www.``, port 80 or 443 and fragment; null is empty."""
    rest = (url or "").partition("://")[2] or (url or "")
    host, slash, path = re.fullmatch(r"([^/?#]*)(/?)((?:.|\n)*)", rest).groups()
    host = re.sub(r":(80|443)$", "", host.rpartition("@")[2].lower())
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + (slash or "/") + path.partition("#")[0]


def _order(x: dict) -> tuple:
    """Key, time, page; nulls first."""
    return x["url_key"], x["captured_at"] or "", -(1 << 63) if x["page_id"] is None else x["page_id"]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``, each archive's in order of key, time and page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, packed in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                found = sorted(_captures(name.rpartition("/")[2], memoryview(packed.as_buffer())), key=_order)
                yield pa.RecordBatch.from_pylist(found, schema=SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return map_batches(files, read, DDL)


class LoserTree:
    """k sorted streams as one: each inner node holds the loser of its match, so that the next winner needs one match a level."""

    def __init__(self, streams: list[Iterator[tuple]]) -> None:
        self.streams = streams
        k = 1
        while k < len(streams):
            k *= 2
        self.k, heads = k, [next(s, None) for s in streams] + [None] * (k - len(streams))
        self.heads, self.losers, winners = heads, [0] * k, [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (b, a) if self._after(a, b) else (a, b)
        self.winner = winners[1] if k > 1 else 0

    def _after(self, a: int, b: int) -> bool:
        """Whether stream a's head comes after b's; a stream at its end comes last, equal heads in the order of streams."""
        x, y = self.heads[a], self.heads[b]
        return y is not None and (x is None or y < x or (y == x and b < a))

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head
            w = self.winner
            self.heads[w] = next(self.streams[w], None)
            node = (w + self.k) // 2
            while node:
                if self._after(w, self.losers[node]):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def _ascending(keys: list[tuple]) -> list[range]:
    """The stretches of rows that are in order: pieces of runs, in whatever order the shuffle brought them."""
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def merged(captures: DataFrame, parts: int | None = None) -> DataFrame:
    """``runs`` in global order of key, time and page, with ``part`` and ``place`` in it.

    A task holds the index rows of its range, no payloads; ranges are as many
    as the session's shuffle partitions, or ``parts``. Captures that agree in
    key, time and page keep the order of their archive and offset.
    """
    order = ["url_key", "captured_at", "page_id", "archive", "offset"]
    ranged = captures.repartitionByRange(parts, *order) if parts else captures.repartitionByRange(*order)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        columns = [t.column(c).to_pylist() for c in order]
        keys = [(k, at or "", -(1 << 63) if page is None else page, archive, offset) for k, at, page, archive, offset in zip(*columns, strict=True)]
        tree = LoserTree([((keys[i], i) for i in piece) for piece in _ascending(keys)])
        places = [i for _, i in tree]
        for a in range(0, len(places), 8192):
            rows = t.take(pa.array(places[a : a + 8192], pa.int64())).combine_chunks()
            yield batch_of(_MERGED, [*[rows.column(c).combine_chunks() for c in SCHEMA.names], list(range(a, a + rows.num_rows))])

    return map_batches(ranged, merge, f"{DDL}, place long").withColumn("part", F.spark_partition_id())


_MERGED = SCHEMA.append(pa.field("place", pa.int64()))


def archived(pages: DataFrame, path: str, parts: int | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html, and captured_at if known) under ``path`` and gives their capture histories, read back from there.

    Of payloads of 100 bytes and more that are equal, the one with the smallest
    page_id is stored as a response, and so is every row with that id; the
    others are revisits. A null html is an empty payload; a null page_id comes
    after all others and is a revisit, unless no page with its payload has an
    id. A null url has the key ``)/``; a null captured_at gives no date. Repeated
    rows come back as often, extra columns are left aside, and no pages give
    no rows. A payload is held whole in its task, as is a packed archive of 5,000 records or
    one partition's at most.
    """
    at = F.col("captured_at").cast("timestamp") if "captured_at" in pages.columns else F.lit(None).cast("timestamp")
    write_archives(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), at.alias("captured_at")), path)
    return merged(runs(pages.sparkSession, path), parts)
