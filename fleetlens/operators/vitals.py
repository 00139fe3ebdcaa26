"""Newest captures, histories and summaries over telemetry tables.

``as_of`` and the bounds of windows are parameters, never the clock. Windows are
half-open. A null is unknown: it neither counts nor fires.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def capture_span(tables: list[DataFrame]) -> DataFrame:
    """One row (first_capture, last_capture) over all tables; each is reduced before the union."""
    spans = [t.agg(F.min("captured_at").alias("a"), F.max("captured_at").alias("b")) for t in tables]
    return reduce(DataFrame.unionByName, spans).agg(F.min("a").alias("first_capture"), F.max("b").alias("last_capture"))


def newest_rows(table: DataFrame, by: list[str], tie: str) -> DataFrame:
    """The newest row of each key, ties by the greatest ``tie``; it combines before the shuffle."""
    rest = [c for c in table.columns if c not in by]
    newest = F.max_by(F.struct(*rest), F.struct("captured_at", tie)).alias("newest")
    return table.where("captured_at is not null").groupBy(*by).agg(newest).select(*by, "newest.*")


def newest_tick(table: DataFrame) -> DataFrame:
    """All rows of each instance's newest capture."""
    ticks = table.groupBy("instance_id").agg(F.max("captured_at").alias("captured_at"))
    return table.join(ticks, ["instance_id", "captured_at"], "left_semi")


def newest_ticks(table: DataFrame, n: int) -> DataFrame:
    """All rows of each instance's newest ``n`` captures. The rank is cut below the shuffle too, so that no task sees an instance's whole history."""
    place = F.dense_rank().over(Window.partitionBy("instance_id").orderBy(F.desc("captured_at")))
    return table.where("captured_at is not null").withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


#: Surfaces of the vitals with their tables, and the series behind each.
SURFACES = {
    "cpu_pressure": ("cpu_pressure_snapshot", "cpu_runnable_tasks", "runnable_tasks"),
    "memory_headroom": ("memory_headroom_snapshot", "memory_ple", "page_life_expectancy"),
    "tempdb_contention": ("tempdb_contention_snapshot", "tempdb_total_waiters", "pagelatch_waiters"),
    "plan_cache": ("plan_cache_snapshot", "plan_cache_single_use", "single_use_plan_count"),
}
SERIES = 60


def deep_vitals(instances: DataFrame, tables: Callable[[str], DataFrame], since: object = None, points: int = SERIES) -> DataFrame:
    """A row for each of ``instances`` (instance_id): its newest capture of every surface, the series behind them and the tables that wanted indexes.

    ``tables`` gives a stored table by its name. ``has_data``, ``captured_at``
    (the newest of all surfaces), a struct by surface, ``io_latency`` with a row
    by file, and series of the newest ``points`` captures, oldest first, as
    arrays of (captured_at, value); captures of one instant are one point, the
    greatest value. ``missing_index_history`` counts days from ``since`` on.
    What was never captured is null or an empty array. An instance's rows of
    all surfaces are cut to ``points`` captures before they meet, and all
    surfaces share the partitioning by instance.
    """
    found, newest = instances.select("instance_id").distinct(), []
    by_time = lambda value: F.array_sort(F.collect_list(F.struct("captured_at", value)))
    for surface, (table, series, value) in SURFACES.items():
        rows = newest_ticks(tables(table), points)
        rest = [c for c in rows.columns if c != "instance_id"]
        ticks = rows.groupBy("instance_id", "captured_at").agg(F.max(F.expr(value).cast("double")).alias("value"), F.max(F.struct(*rest)).alias("row"))
        found = found.join(ticks.groupBy("instance_id").agg(F.max_by("row", "captured_at").alias(surface), by_time("value").alias(series)), "instance_id", "left")
        newest.append(F.col(f"{surface}.captured_at"))
    rows = newest_ticks(tables("io_latency_delta"), points)
    rest = [c for c in rows.columns if c != "instance_id"]
    worst = F.greatest("avg_read_latency_ms", "avg_write_latency_ms")
    ticks = rows.groupBy("instance_id", "captured_at").agg(F.max(worst).alias("value"), F.array_sort(F.collect_list(F.struct(*rest))).alias("files"))
    found = found.join(ticks.groupBy("instance_id").agg(F.max_by("files", "captured_at").alias("io_latency"), by_time("value").alias("io_worst_latency_ms"), F.max("captured_at").alias("_io")), "instance_id", "left")
    wanted = tables("missing_index_snapshot").where("captured_at is not null")
    wanted = wanted if since is None else wanted.where(F.col("captured_at") >= F.lit(since))
    day = F.to_date("captured_at")
    by_table = wanted.groupBy("instance_id", "db_name", "schema_name", "table_name").agg(F.countDistinct(day).alias("days_seen"), F.max("user_seeks").alias("max_user_seeks"))
    observed = wanted.groupBy("instance_id").agg(F.countDistinct(day).alias("days_observed"))
    first = [(-F.col("days_seen")).alias("a"), (-F.coalesce("max_user_seeks", F.lit(0))).alias("b"), "db_name", "schema_name", "table_name"]
    listed = F.array_sort(F.collect_list(F.struct(*first, F.struct("db_name", "schema_name", "table_name", "days_seen", "days_observed", "max_user_seeks").alias("row"))))
    history = by_table.join(observed, "instance_id").where("table_name <> ''").groupBy("instance_id").agg(F.transform(listed, lambda x: x["row"]).alias("missing_index_history"))
    found = found.join(history, "instance_id", "left")
    captured = F.greatest(*newest, F.col("_io"))
    lists = [*(series for _, series, _ in SURFACES.values()), "io_worst_latency_ms", "io_latency", "missing_index_history"]
    kinds = dict(found.dtypes)
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(kinds[c])).alias(c)
    return found.select("instance_id", captured.isNotNull().alias("has_data"), captured.alias("captured_at"), *SURFACES, *[empty(c) for c in lists])


def signal_wait_pct(waits: DataFrame) -> DataFrame:
    """Share of signal waits at each instance's newest capture, null where nothing waited."""
    sums = newest_tick(waits).groupBy("instance_id").agg(F.sum("signal_ms").alias("signal_ms"), F.sum("delta_ms").alias("total_ms"))
    return sums.select("instance_id", F.when(F.col("total_ms") > 0, F.round(F.col("signal_ms") / F.col("total_ms") * 100, 4)).alias("signal_pct"))


def io_series(io: DataFrame) -> DataFrame:
    """The worst latency of each capture, reads or writes; a null side doesn't hide the other."""
    return io.groupBy("instance_id", "captured_at").agg(F.max(F.greatest("read_ms", "write_ms")).alias("worst_ms"))


def io_deltas(files: DataFrame) -> DataFrame:
    """Growth of each file's counters since the row before, clamped at 0, with mean latencies; rows without I/O are left out."""
    before = Window.partitionBy("instance_id", "file_name").orderBy("captured_at")
    grown = files.select("instance_id", "file_name", "captured_at", *[F.greatest(F.col(c) - F.lag(c).over(before), F.lit(0)).alias(c) for c in ("reads", "writes", "read_stall_ms", "write_stall_ms")])
    mean = lambda stall, n: F.when(F.col(n) > 0, F.round(F.col(stall) / F.col(n), 4)).otherwise(0.0)
    return grown.where("reads + writes > 0").select("*", mean("read_stall_ms", "reads").alias("read_ms"), mean("write_stall_ms", "writes").alias("write_ms"))


def seen_days(history: DataFrame, by: str) -> DataFrame:
    """(key, days_seen, days_observed): days on which a key shows, and days with any row; rows with a null key mark days only."""
    day = F.to_date("captured_at")
    observed = history.agg(F.countDistinct(day).alias("days_observed"))
    seen = history.where(F.col(by).isNotNull()).groupBy(by).agg(F.countDistinct(day).alias("days_seen"))
    return seen.join(F.broadcast(observed)).where("days_observed > 0")  # one row


def judged_samples(store: DataFrame, z: float = 3.0, least: int = 6, min_delta_ms: float = 5.0) -> DataFrame:
    """Samples that stand out from their query's samples before them; each is judged before it joins the baseline."""
    samples = store.where("executions > 0").select("query_id", "captured_at", "event_id", (F.col("total_duration_ms") / F.col("executions")).alias("ms"))
    before = Window.partitionBy("query_id").orderBy("captured_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    judged = samples.select("*", F.count("ms").over(before).alias("n"), F.avg("ms").over(before).alias("mean"), F.stddev_samp("ms").over(before).alias("sd"))
    over = F.col("ms") - F.col("mean")
    return judged.where((F.col("n") >= least) & (F.col("sd") > 0) & (over >= z * F.col("sd")) & (over >= min_delta_ms)).select("query_id", "captured_at", "event_id", "n", F.round("mean", 4).alias("mean_ms"), F.round("ms", 4).alias("ms"))


def baseline_summary(baselines: DataFrame, least: int = 6) -> DataFrame:
    """One row over the mature baselines (query_id, n, mean, m2, last_ms): sums, their change in percent, worst z, at least 0."""
    sd = F.sqrt(F.col("m2") / (F.col("n") - 1))
    mature = baselines.where(F.col("n") >= least).withColumn("z", F.when(sd > 0, (F.col("last_ms") - F.col("mean")) / sd))
    sums = mature.agg(F.count("*").alias("queries"), F.sum("mean").alias("mean"), F.sum("last_ms").alias("last"), F.max("z").alias("z"))
    return sums.select("queries", F.round("mean", 2).alias("mean_ms"), F.round("last", 2).alias("last_ms"), F.round(F.when(F.col("mean") > 0, (F.col("last") / F.col("mean") - 1) * 100), 2).alias("delta_pct"), F.round(F.greatest(F.coalesce("z", F.lit(0.0)), F.lit(0.0)), 2).alias("worst_z"))


def size_growth(sizes: DataFrame) -> DataFrame:
    """Rows and kilobytes of each table at its first and last capture."""
    of = lambda f, c, name: f(c, "captured_at").alias(name)
    return sizes.groupBy("table_name").agg(of(F.min_by, "row_count", "first_rows"), of(F.max_by, "row_count", "last_rows"), of(F.min_by, "used_kb", "first_kb"), of(F.max_by, "used_kb", "last_kb"))


def events_once(events: DataFrame, text: str) -> DataFrame:
    """Events with the first 16 hex digits of their text's SHA-256, each text once: the earliest, null texts left out."""
    hashed = events.where(F.col(text).isNotNull()).withColumn("text_hash", F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 16))
    return hashed.groupBy("text_hash").agg(F.count("*").alias("times"), F.min("captured_at").alias("first_seen"))


#: Fixed values of the default alert rules: (rule, metric, comparator, threshold, severity).
ALERT_RULES = [
    ("cpu.runnable_tasks_high", "runnable_tasks", "ge", 10.0, "warning"),
    ("cpu.signal_wait_pct_high", "signal_pct", "gt", 35.0, "warning"),
    ("memory.ple_below_floor", "ple_seconds", "lt", None, "warning"),
    ("memory.pending_memory_grants", "pending_grants", "ge", 1.0, "warning"),
    ("plancache.adhoc_singleuse_pct", "single_use_pct", "ge", 20.0, "warning"),
    ("tempdb.pagelatch_contention", "pagelatch_waiters", "ge", 10.0, "warning"),
    ("io.data_file_latency_ms.warning", "data_latency_ms", "gt", 20.0, "warning"),
    ("io.data_file_latency_ms.critical", "data_latency_ms", "gt", 100.0, "critical"),
    ("io.log_write_latency_ms", "log_latency_ms", "gt", 5.0, "warning"),
    ("reliability.deadlocks", "deadlocks", "ge", 1.0, "critical"),
    ("reliability.blocking", "blocked", "ge", 1.0, "warning"),
]
_COMPARE = {"gt": lambda v, t: v > t, "ge": lambda v, t: v >= t, "lt": lambda v, t: v < t, "le": lambda v, t: v <= t}


def page_life_floor(memory_gb: Column) -> Column:
    """300 seconds for each 4 GB, 300 at least and where the memory is unknown."""
    return F.greatest(F.coalesce(memory_gb, F.lit(0.0)) / 4 * 300, F.lit(300.0))


def breaches(snapshots: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """(instance_id, captured_at, rule_id, severity, value, threshold) of all rules that a snapshot breaks.

    A snapshot is a row with a column by metric; a metric that is null or that
    the table lacks doesn't fire. A rule without a threshold has the page-life floor.
    """
    found = []
    for rule, metric, compare, threshold, severity in ALERT_RULES if rules is None else rules:
        if metric in snapshots.columns:
            limit = F.lit(float(threshold)) if threshold is not None else page_life_floor(F.col("memory_gb") if "memory_gb" in snapshots.columns else F.lit(None).cast("double"))
            value = F.col(metric).cast("double")
            found.append(F.when(_COMPARE[compare](value, limit), F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), value.alias("value"), limit.alias("threshold"))))
    hits = F.explode(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return snapshots.select("instance_id", "captured_at", hits.alias("hit")).select("instance_id", "captured_at", "hit.*")
