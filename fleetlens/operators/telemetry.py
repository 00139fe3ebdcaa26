"""Windowed aggregates, counter deltas, baselines and alerts over telemetry tables.

Unknown stays null and never fires. Every limit has a full tie-break. Windows
run by query or instance after the rows are cut to what they need; latest rows
come from ``max_by``, which combines before the shuffle.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

#: Fixed values of the regression test and the trust rule.
Z_SCORE, MIN_SAMPLES, MIN_EXECUTIONS, MIN_DELTA_MS = 3.0, 6, 10, 5.0
MAX_GAP_SECONDS = 3600
UNUSED_UPDATES, UNUSED_LIMIT, REGRESSION_LIMIT = 100, 50, 50
COOLDOWN_SECONDS = 900
#: Seconds of a key's breaches that are one row at least, and two cooldowns.
STRETCH = 4 * 86_400


def top_queries(store: DataFrame, n: int, by: str = "duration") -> DataFrame:
    """The n plans with the most time, or the latest ones, nulls last."""
    found = store.groupBy("query_id", "plan_id").agg(F.round(F.sum("total_duration_ms"), 4).alias("duration_ms"), F.sum("executions").alias("executions"), F.max("query_sql_text").alias("text"), F.max("captured_at").alias("last_seen"))
    first = F.desc_nulls_last("duration_ms" if by == "duration" else "last_seen")
    return found.orderBy(first, "query_id", "plan_id").limit(n)


def unused_indexes(usage: DataFrame) -> DataFrame:
    """Indexes that are only written to, the most written first."""
    sums = usage.groupBy("table_id", "index_id").agg(*[F.sum(c).alias(c) for c in ("seeks", "scans", "lookups", "updates")])
    return sums.where((F.col("seeks") == 0) & (F.col("scans") == 0) & (F.col("lookups") == 0) & (F.col("updates") > UNUSED_UPDATES)).select("table_id", "index_id", "updates").orderBy(F.desc("updates"), "table_id", "index_id").limit(UNUSED_LIMIT)


def index_history(usage: DataFrame) -> DataFrame:
    """Days with reads and with writes of each index, by UTC day."""
    day = F.to_date("captured_at")
    reads = F.col("seeks") + F.col("scans") + F.col("lookups")
    return usage.groupBy("table_id", "index_id").agg(F.countDistinct(F.when(reads > 0, day)).alias("days_with_reads"), F.countDistinct(F.when(F.col("updates") > 0, day)).alias("days_with_writes"))


def counter_deltas(snapshots: DataFrame) -> DataFrame:
    """Growth of each counter since its instance's capture before.

    A capture gives nothing if it is the first, if the one before is over an hour
    older, or if any counter of the instance went down. A counter that the
    capture before lacks grew from 0; rows without growth are left out.
    """
    ticks = snapshots.select("instance_id", "captured_at").distinct()
    ticks = ticks.withColumn("before", F.lag("captured_at").over(Window.partitionBy("instance_id").orderBy("captured_at")))
    age = F.unix_micros(F.col("captured_at").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    ticks = ticks.where(F.col("before").isNotNull() & (age <= MAX_GAP_SECONDS * 1_000_000))
    prior = snapshots.select("instance_id", "wait_type", F.col("captured_at").alias("before"), F.col("total_ms").alias("prior_ms"))
    pairs = snapshots.join(ticks, ["instance_id", "captured_at"]).join(prior, ["instance_id", "wait_type", "before"], "left")
    voided = pairs.groupBy("instance_id", "captured_at").agg(F.max(F.coalesce(F.col("total_ms") < F.col("prior_ms"), F.lit(False))).alias("voided"))
    fair = voided.where("not voided").select("instance_id", "captured_at")
    delta = F.col("total_ms") - F.coalesce("prior_ms", F.lit(0))
    return pairs.join(fair, ["instance_id", "captured_at"]).select("instance_id", "wait_type", "captured_at", delta.alias("delta_ms")).where("delta_ms > 0")


def _per_execution(store: DataFrame) -> DataFrame:
    return store.where("executions > 0").select("query_id", "captured_at", "event_id", "executions", (F.col("total_duration_ms") / F.col("executions")).alias("ms"))


def regressions(store: DataFrame) -> DataFrame:
    """Queries whose last sample is an outlier against the samples before it, the largest slowdown first."""
    samples = _per_execution(store)
    last = samples.groupBy("query_id").agg(F.max(F.struct("captured_at", "event_id", "ms")).alias("last"), F.count("*").alias("n"), F.sum("executions").alias("executions"))
    before = samples.join(last.select("query_id", "last"), "query_id").where(F.struct("captured_at", "event_id") < F.struct("last.captured_at", "last.event_id"))
    base = before.groupBy("query_id").agg(F.avg("ms").alias("mean"), F.stddev_samp("ms").alias("sd"))
    now = last.join(base, "query_id").withColumn("ms", F.col("last.ms"))
    found = now.where((F.col("n") >= MIN_SAMPLES) & (F.col("executions") >= MIN_EXECUTIONS) & (F.col("sd") > 0) & (F.col("ms") - F.col("mean") >= Z_SCORE * F.col("sd")) & (F.col("ms") - F.col("mean") >= MIN_DELTA_MS))
    found = found.select("query_id", F.round("mean").cast("long").alias("baseline_ms"), F.round("ms").cast("long").alias("current_ms"), F.round(F.when(F.col("mean") > 0, (F.col("ms") / F.col("mean") - 1) * 100).otherwise(0.0), 4).alias("delta_pct"))
    return found.orderBy(F.desc(F.col("current_ms") - F.col("baseline_ms")), "query_id").limit(REGRESSION_LIMIT)


def baselines(store: DataFrame) -> DataFrame:
    """Mergeable baseline of each query: count, mean, sum of squared deviations, last sample."""
    return _per_execution(store).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 6).alias("mean"), F.round(F.coalesce(F.var_pop("ms"), F.lit(0.0)) * F.count("*"), 4).alias("m2"), F.round(F.max_by("ms", F.struct("captured_at", "event_id")), 6).alias("last_ms"))


def newest_points(store: DataFrame, n: int) -> DataFrame:
    """The newest n samples of each query, oldest first."""
    newest = Window.partitionBy("query_id").orderBy(F.desc("captured_at"), F.desc("event_id"))
    return store.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= n).select("query_id", (n + 1 - F.col("age")).alias("place"), "captured_at", "total_duration_ms")


def fired_alerts(breaches: DataFrame, cooldown: int = COOLDOWN_SECONDS) -> DataFrame:
    """Of (keys, at seconds), those that fire: a key's first, and each at least ``cooldown`` after its last that fired.

    All columns but ``at`` are the key: the rule, and in a fleet the instance.
    Breaches are cut to one a second while they are dealt to stretches of time,
    so that a key with a third of all rows is many tasks. What a stretch makes
    of the last alert before it is a step function of few steps; a key's
    functions, one a stretch, are composed in order, and each stretch then
    follows its breaches from where its key stands. Rows without a time are left out.
    """
    keys = [c for c in breaches.columns if c != "at"]
    cooldown = max(1, cooldown)  # breaches are one a second
    width = max(2, -(-STRETCH // cooldown)) * cooldown
    kinds = [breaches.schema[k] for k in keys]
    at = F.col("at").cast("long")
    dealt = breaches.where("at is not null").select(*keys, (at - F.pmod(at, F.lit(width))).alias("stretch"), at.alias("at"))
    dealt = dealt.groupBy(*keys, "stretch").agg(F.array_sort(F.collect_set("at")).alias("times"))
    steps = dealt.mapInArrow(_steps(keys, cooldown), StructType([*kinds, StructField("stretch", LongType()), StructField("limits", ArrayType(LongType())), StructField("ends", ArrayType(LongType()))]))
    before = steps.groupBy(*keys).applyInArrow(_composed(keys, cooldown), StructType([*kinds, StructField("stretch", LongType()), StructField("last", LongType())]))
    before = before.select(*[F.col(k).alias(f"of_{i}") for i, k in enumerate(keys)], F.col("stretch").alias("from"), "last")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{i}")) for i, k in enumerate(keys)], F.col("stretch") == F.col("from"))
    return dealt.join(before, same).select(*keys, "times", "last").mapInArrow(_followed(keys, cooldown), StructType([*kinds, StructField("fired_at", LongType())]))


def _times(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for x in batch.column("times"):
        yield x.values.to_numpy(zero_copy_only=False)


def _steps(keys: list[str], cooldown: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The last alert of a stretch by when the first may come: ``ends[i]`` for the i-th step, up to ``limits[i]``; null if none comes."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            limits, ends = [], []
            for start, times in zip(b.column("stretch").to_pylist(), _times(b), strict=True):
                # an alert before the stretch bars nothing beyond its first cooldown
                first = times[: np.searchsorted(times, start + cooldown) + 1]
                last = first.copy()
                while (found := np.searchsorted(times, last + cooldown)).min(initial=len(times)) < len(times):
                    last = np.where(found < len(times), times[np.minimum(found, len(times) - 1)], last)
                cuts = np.flatnonzero(np.diff(last))
                limits.append([*first[cuts].tolist(), int(first[-1])])
                ends.append([*last[cuts].tolist(), int(last[-1]), None])
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], b.column("stretch"), pa.array(limits, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=[*keys, "stretch", "limits", "ends"])

    return steps


def _composed(keys: list[str], cooldown: int) -> Callable[[pa.Table], pa.Table]:
    """A key's last alert before each of its stretches; a row a stretch, so that a key's rows grow with the time it spans only."""

    def composed(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("stretch").to_numpy())
        limits, ends, last, found = t.column("limits").to_pylist(), t.column("ends").to_pylist(), None, [None] * len(order)
        for i in order:
            found[i] = last
            step = 0 if last is None else bisect_left(limits[i], last + cooldown)
            last = last if ends[i][step] is None else ends[i][step]
        return t.select([*keys, "stretch"]).append_column("last", pa.array(found, pa.int64()))

    return composed


def _followed(keys: list[str], cooldown: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The alerts of each stretch."""

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, fired = [], []
            for i, (times, last) in enumerate(zip(_times(b), b.column("last").to_pylist(), strict=True)):
                at = 0 if last is None else int(np.searchsorted(times, last + cooldown))
                while at < len(times):
                    rows.append(i)
                    fired.append(int(times[at]))
                    at = int(np.searchsorted(times, times[at] + cooldown))
            own = b.select(keys).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(fired, pa.int64())], names=[*keys, "fired_at"])

    return followed


def top_wait(waits: DataFrame, ignorable: list[str]) -> DataFrame:
    """The wait type with the most time that isn't background noise."""
    return waits.where(~F.col("wait_type").isin(ignorable)).groupBy("wait_type").agg(F.sum("delta_ms").alias("total_ms")).orderBy(F.desc("total_ms"), "wait_type").limit(1)
