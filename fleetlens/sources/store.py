"""The telemetry store: Parquet folders that a commit makes visible together.

A write stages each table's rows in a folder of their own and then publishes
one manifest, a small file that lists the folders of every table, by a rename
that fails where another writer was first; the loser reads the newer manifest
and tries again. Runs and their findings so become visible at once or not at
all. Folders are never changed, so that a snapshot, which is one manifest,
reads the same rows whatever is committed after it.

Tables of events lie by day, tables with keys by bucket of the key's hash. A
change to keyed rows is a small folder beside the old ones; readers merge
only buckets that have one, and ``compact`` rewrites only these. Retention
drops whole days from the manifest and rewrites the day of the cutoff.
``vacuum`` removes what no kept manifest names.

Manifests hold folder names, never rows: days times commits since the last compaction.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import date, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.sources.tables import TABLES, Table

BUCKETS = 16
#: Tries of a commit before a writer gives up.
TRIES = 50
#: Hours that staged folders without a manifest are left alone, as their writer may still be at work.
GRACE_HOURS = 24.0
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another commit took away the folders that a change was to replace, or came first too often."""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name under the one that the cluster shares, or Spark's own checkpoint folder; one of our own only in local mode, where every task sees it."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    own = context._jsc.sc().getCheckpointDir()
    if named is None and own.isDefined():
        named = own.get()
    if named is None and not (context.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or '/tmp/checkpoints/fleetlens'}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Part:
    """A folder of one commit's rows for a day or bucket."""

    commit: str
    value: str

    def folder(self, table: Table) -> str:
        return f"commit={self.commit}/{table.by}={self.value}"


@dataclass(frozen=True)
class Manifest:
    """What a version shows: the parts of each table, oldest commit first, and the last batch of each stream."""

    version: int = 0
    parts: dict[str, tuple[Part, ...]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"version": self.version, "parts": {t: [[p.commit, p.value] for p in ps] for t, ps in self.parts.items()}, "batches": self.batches})

    @staticmethod
    def read(text: str) -> Manifest:
        told = json.loads(text)
        return Manifest(told["version"], {t: tuple(Part(*p) for p in ps) for t, ps in told["parts"].items()}, told["batches"])

    def changed(self, table: str, gone: Iterable[Part] = (), new: Iterable[Part] = ()) -> Manifest:
        """With the new parts where the first one that goes stood, else at the end; all that go must still be there."""
        now, gone = list(self.parts.get(table, ())), set(gone)
        if not gone <= set(now):
            raise Conflict(f"{table}: another commit has replaced these folders")
        at = min((i for i, p in enumerate(now) if p in gone), default=len(now))
        kept = [p for p in now[:at] if p not in gone], [p for p in now[at:] if p not in gone]
        return Manifest(self.version, self.parts | {table: (*kept[0], *new, *kept[1])}, self.batches)


class Files:
    """The few calls on small files and folders that a store needs, by Hadoop's file contexts, wherever the store lies."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self.path("").getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        self.gateway = spark.sparkContext._gateway

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[tuple[str, float]]:
        """(name, age in seconds) of what a folder holds; a missing folder holds nothing."""
        if not self.system.exists(self.path(name)):
            return []
        return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in self.system.listStatus(self.path(name))]

    def text(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def published(self, name: str, text: str) -> bool:
        """Whether a file of that name, whole, is now there by us: it is written aside and renamed, which fails where the name is taken."""
        aside = self.path(f"aside/{uuid.uuid4().hex}")
        stream = self.system.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.system.mkdirs(self.path(name).getParent())
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.context.rename(aside, self.path(name), none)
        except Py4JJavaError as e:
            self.system.delete(aside, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def removed(self, name: str) -> None:
        self.system.delete(self.path(name), True)


def _bucket(table: Table) -> Column:
    return F.pmod(F.xxhash64(*table.keys), F.lit(BUCKETS)).cast("int")


class Snapshot:
    """One version, for reading only. It has no way to write, and later commits don't change what it reads."""

    def __init__(self, spark: SparkSession, root: str, manifest: Manifest, tables: dict[str, Table]) -> None:
        self.spark, self.root, self.manifest, self.tables = spark, root.rstrip("/"), manifest, tables

    @property
    def version(self) -> int:
        return self.manifest.version

    def parts(self, name: str) -> tuple[Part, ...]:
        return self.manifest.parts.get(name, ())

    def raw(self, table: Table, parts: Iterable[Part]) -> DataFrame:
        """The rows of some parts with their commit and day or bucket; no parts give no rows."""
        kind, folders = "date" if table.by == "day" else "int", [f"{self.root}/data/{table.name}/{p.folder(table)}" for p in parts]
        ddl = f"{table.ddl}, commit string, {table.by} {kind}"
        if not folders:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).option("basePath", f"{self.root}/data/{table.name}").parquet(*folders)

    def merged(self, table: Table, parts: Iterable[Part]) -> DataFrame:
        """Of each key the row that stands: the greatest version and, of equal ones, the latest commit; in a table whose first row stays, the earliest commit and version."""
        parts = tuple(parts)
        order = {c: i for i, c in enumerate(dict.fromkeys(p.commit for p in parts))}
        place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("commit")] if order else F.lit(0)
        rows = self.raw(table, parts)
        whole, rank = F.struct(*table.columns), F.struct(table.version, place) if not table.first else F.struct(place, table.version)
        chosen = (F.min_by if table.first else F.max_by)(whole, rank).alias("row")
        return rows.groupBy(*table.keys).agg(chosen).select("row.*")

    def read(self, name: str, since: object = None, until: object = None) -> DataFrame:
        """The table's rows in [since, until) by its time; only days of the window are listed and only buckets with changes merged."""
        table, parts = self.tables[name], self.parts(name)
        if table.keys:
            by: dict[str, list[Part]] = {}
            for p in parts:
                by.setdefault(p.value, []).append(p)
            clean = [p for ps in by.values() if len(ps) == 1 for p in ps]
            dirty = [p for p in parts if len(by[p.value]) > 1]
            rows = self.raw(table, clean).select(*table.columns)
            if dirty:
                rows = rows.unionByName(self.merged(table, dirty))
        else:
            low, high = (None if x is None else table.folder_day(str(x)[:10]) for x in (since, until))
            inside = [p for p in parts if p.value == NO_DAY and low is None and high is None or p.value != NO_DAY and (low is None or p.value >= low) and (high is None or p.value <= high)]
            rows = self.raw(table, inside).select(*table.columns)
        if since is not None:
            rows = rows.where(F.col(table.at) >= F.lit(since))
        return rows if until is None else rows.where(F.col(table.at) < F.lit(until))


class Store:
    """Writes a store under ``root``, a folder that all executors share, and opens snapshots of it."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table] = TABLES) -> None:
        self.spark, self.root, self.tables, self.files = spark, root.rstrip("/"), tables, Files(spark, root)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in self.files.names("commits") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            version = max(self.versions(), default=0)
        return Manifest.read(self.files.text(f"commits/{version:020d}.json")) if version else Manifest()

    def snapshot(self, version: int | None = None) -> Snapshot:
        return Snapshot(self.spark, self.root, self.manifest(version), self.tables)

    def publish(self, change: Callable[[Manifest], Manifest | None]) -> int:
        """Applies a change to the newest manifest, again if another writer comes first; a change of None leaves all as it is."""
        for _ in range(TRIES):
            now = self.manifest()
            to = change(now)
            if to is None:
                return now.version
            to = Manifest(now.version + 1, to.parts, to.batches)
            if self.files.published(f"commits/{to.version:020d}.json", to.text()):
                return to.version
        raise Conflict(f"{TRIES} other commits came first")

    def stage(self, name: str, rows: DataFrame) -> list[Part]:
        """Writes rows where no snapshot sees them: columns by the table's schema, missing ones null, unknown ones refused."""
        table = self.tables[name]
        if unknown := set(rows.columns) - set(table.columns):
            raise ValueError(f"{name} has no column {', '.join(sorted(unknown))}")
        shaped = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in table.types])
        return self._staged(table, shaped)

    def _staged(self, table: Table, shaped: DataFrame) -> list[Part]:
        commit = uuid.uuid4().hex
        if table.keys:
            shaped = shaped.withColumn("bucket", _bucket(table)).repartition(BUCKETS, "bucket")
        else:
            day = F.to_date(table.at) if table.at else F.lit(None).cast("date")
            day = F.trunc(day, "month") if table.monthly else day
            shaped = shaped.withColumn("day", day).hint("rebalance", "day")  # a day with many rows is split
        shaped.write.partitionBy(table.by).parquet(f"{self.root}/data/{table.name}/commit={commit}")
        found = [n.partition("=")[2] for n, _ in self.files.names(f"data/{table.name}/commit={commit}") if n.startswith(f"{table.by}=")]
        return [Part(commit, v) for v in sorted(found)]

    def write(self, frames: dict[str, DataFrame], stream: str | None = None, batch: int = 0) -> int:
        """Commits rows of several tables at once: appended to tables of events, merged by key into the others. The version that shows them.

        With ``stream`` a batch that was committed before is left out, so that one that is tried again counts once.
        """
        if stream is not None and self.manifest().batches.get(stream, -1) >= batch:
            return self.manifest().version
        staged = {name: self.stage(name, rows) for name, rows in frames.items()}

        def added(now: Manifest) -> Manifest | None:
            if stream is not None and now.batches.get(stream, -1) >= batch:
                return None
            for name, parts in staged.items():
                now = now.changed(name, new=parts)
            return Manifest(now.version, now.parts, now.batches if stream is None else now.batches | {stream: batch})

        return self.publish(added)

    def sink(self, rows: DataFrame, name: str, stream: str, checkpoint: str) -> StreamingQuery:
        """A running query that commits each batch of a stream once; ``stream`` names it in the manifests, so that a lost checkpoint doesn't count batches twice."""

        def commit(batch: DataFrame, number: int) -> None:
            self.write({name: batch}, stream, number)

        return rows.writeStream.queryName(stream).foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def compact(self, name: str) -> int:
        """Rewrites the days or buckets that have several folders into one each; others aren't read. A change made meanwhile stays."""
        table, now = self.tables[name], self.snapshot()
        by: dict[str, list[Part]] = {}
        for p in now.parts(name):
            by.setdefault(p.value, []).append(p)
        old = [p for p in now.parts(name) if len(by[p.value]) > 1]
        if not old:
            return now.version
        rows = now.merged(table, old) if table.keys else now.raw(table, old).select(*table.columns)
        new = self._staged(table, rows)
        return self.publish(lambda m: m.changed(name, old, new))

    def prune(self, cutoff: datetime | date | str, names: Iterable[str] | None = None) -> dict[str, int]:
        """Rows before ``cutoff`` go from every table that ages, in one commit; how many went from each. Rows without a time stay.

        Whole days go without being rewritten; the day of the cutoff is, and of keyed tables the buckets that hold an old row.
        """
        now, limit, day = self.snapshot(), F.lit(str(cutoff)).cast("timestamp"), str(cutoff)[:10]
        changes, removed = {}, {}
        for name in names or [t.name for t in self.tables.values() if t.ages]:
            table, parts = self.tables[name], now.parts(name)
            old = F.col(table.at) < limit
            if table.keys:
                counts = now.raw(table, parts).groupBy("bucket").agg(F.count(F.when(old, 1)).alias("n")).where("n > 0").collect()  # BUCKETS rows at most
                values = {str(r["bucket"]) for r in counts}
                gone = [p for p in parts if p.value in values]
                rows = now.merged(table, gone)
                n = rows.where(old).count() if gone else 0
                new = self._staged(table, rows.where(~F.coalesce(old, F.lit(False)))) if gone else []
            else:
                edge_day = table.folder_day(day)
                whole = [p for p in parts if p.value != NO_DAY and p.value < edge_day]
                edge = [p for p in parts if p.value == edge_day]
                n = now.raw(table, [*whole, *edge]).where(old).count() if whole or edge else 0
                edge = edge if now.raw(table, edge).where(old).limit(1).count() else []
                gone, new = [*whole, *edge], self._staged(table, now.raw(table, edge).select(*table.columns).where(~old)) if edge else []
            if gone:
                changes[name], removed[name] = (gone, new), n

        def aged(m: Manifest) -> Manifest:
            for name, (gone, new) in changes.items():
                m = m.changed(name, gone, new)
            return m

        if changes:
            self.publish(aged)
        return removed

    def vacuum(self, keep: int = 2, grace_hours: float = GRACE_HOURS) -> int:
        """Removes manifests but the newest ``keep`` and folders that none of these names; how many folders. Young folders stay: their writer may not have committed yet."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        for v in versions[:-keep]:
            self.files.removed(f"commits/{v:020d}.json")
        removed = 0
        for table in self.tables.values():
            named = {p.folder(table) for m in kept for p in m.parts.get(table.name, ())}
            for commit, age in self.files.names(f"data/{table.name}"):
                if age < grace_hours * 3600:
                    continue
                values = [f"{commit}/{v}" for v, _ in self.files.names(f"data/{table.name}/{commit}") if not v.startswith(("_", "."))]
                spare = [v for v in values if v not in named]
                for folder in [commit] if len(spare) == len(values) else spare:
                    self.files.removed(f"data/{table.name}/{folder}")
                removed += len(spare)
        for name, age in self.files.names("aside"):
            if age >= grace_hours * 3600:
                self.files.removed(f"aside/{name}")
        return removed


def opened(spark: SparkSession, root: str, tables: dict[str, Table] = TABLES) -> Snapshot | None:
    """A snapshot of the newest version, for readers beside a writer; None where there is no store, which isn't an error."""
    store = Store(spark, root, tables)
    return store.snapshot() if store.versions() else None
