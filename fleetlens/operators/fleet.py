"""Reads over the telemetry store for many instances: windows, newest ticks, logs, composed reports.

Windows are half-open, [since, until); a null bound is open. Newest rows come
from an aggregate that combines before the shuffle. Sorted and limited results
have full tie-breaks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators import vitals


def within(table: DataFrame, since: object = None, until: object = None, at: str = "captured_at") -> DataFrame:
    """The rows of [since, until); rows without a time are outside of any bound."""
    if since is not None:
        table = table.where(F.col(at) >= F.lit(since))
    return table if until is None else table.where(F.col(at) < F.lit(until))


def trusted_deltas(snapshots: DataFrame, keys: list[str], counters: list[str], watched: list[str], max_gap_seconds: int = 3600) -> DataFrame:
    """(instance_id, keys, captured_at, counters): growth of cumulative counters since the instance's capture before.

    A capture gives nothing if it is the first, comes over ``max_gap_seconds``
    after the one before, or if a watched counter of any key went down. A key
    that the capture before lacks grew from 0; growth is 0 at least, and rows
    without any growth are left out. Nulls count as 0.
    """
    ticks = snapshots.select("instance_id", "captured_at").distinct()
    ticks = ticks.withColumn("before", F.lag("captured_at").over(Window.partitionBy("instance_id").orderBy("captured_at")))
    age = F.unix_micros(F.col("captured_at").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    ticks = ticks.where(F.col("before").isNotNull() & (age <= max_gap_seconds * 1_000_000))
    prior = snapshots.select("instance_id", *keys, F.col("captured_at").alias("before"), *[F.col(c).alias(f"prior_{c}") for c in counters])
    pairs = snapshots.join(ticks, ["instance_id", "captured_at"]).join(prior, ["instance_id", *keys, "before"], "left")
    down = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < F.col(f"prior_{c}"), F.lit(False)) for c in watched])
    fair = pairs.groupBy("instance_id", "captured_at").agg(F.max(down).alias("down")).where("not down").select("instance_id", "captured_at")
    grown = [F.greatest(F.coalesce(c, F.lit(0)) - F.coalesce(f"prior_{c}", F.lit(0)), F.lit(0)).alias(c) for c in counters]
    found = pairs.join(fair, ["instance_id", "captured_at"]).select("instance_id", *keys, "captured_at", *grown)
    return found.where(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in counters]))


def spaced_captures(captures: DataFrame, least_hours: int = 20) -> DataFrame:
    """(instance_id, captured_at) of captures that a rate limit lets through: the first, and each at least ``least_hours`` after the last let through."""
    from fleetlens.operators.telemetry import fired_alerts

    seconds = F.floor(F.unix_micros(F.col("captured_at").cast("timestamp")) / 1_000_000)
    kept = fired_alerts(captures.select("instance_id", seconds.alias("at")), least_hours * 3600)
    return kept.select("instance_id", F.timestamp_seconds("fired_at").alias("captured_at"))


def blocked_sessions(live: DataFrame) -> DataFrame:
    """(instance_id, blocked): sessions that wait for another at each instance's newest capture; 0 where none does."""
    return vitals.newest_tick(live).groupBy("instance_id").agg(F.count("blocking_session_id").alias("blocked"))


def longest_blocked(live: DataFrame, n: int = 10) -> DataFrame:
    """The n longest waits for another session at each instance's newest capture, with their place."""
    order = Window.partitionBy("instance_id").orderBy(F.desc_nulls_last("duration_ms"), "session_id")
    blocked = vitals.newest_tick(live).where("blocking_session_id is not null")
    return blocked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def events_since(events: DataFrame, since: object) -> DataFrame:
    """(instance_id, events): how many of each instance came at ``since`` or later; instances without one are left out."""
    return within(events, since).groupBy("instance_id").agg(F.count("*").alias("events"))


def newest_event(events: DataFrame, tie: str) -> DataFrame:
    return vitals.newest_rows(events, ["instance_id"], tie)


def recent_alerts(alerts: DataFrame, instances: DataFrame, n: int = 50) -> DataFrame:
    """The n newest alerts with their instance's name; alerts of unknown instances are left out."""
    named = alerts.join(instances.select("instance_id", "instance_name"), "instance_id")
    return named.orderBy(F.desc_nulls_last("fired_at"), "instance_id", "rule_id").limit(n)


def newest_instance(instances: DataFrame, **where: str) -> DataFrame:
    """One row (instance_id), the newest instance whose columns have these values, any case; null where there is none."""
    for column, value in where.items():
        instances = instances.where(F.lower(column) == value.lower())
    return instances.agg(F.max_by("instance_id", F.struct("created_at", "instance_id")).alias("instance_id"))


def runs(log: DataFrame, instance_id: int | None = None, kind: str | None = None, since: object = None, until: object = None, n: int = 100) -> DataFrame:
    """The n newest analysis runs; filters that aren't given don't apply."""
    log = within(log, since, until, "started_at")
    if instance_id is not None:
        log = log.where(F.col("instance_id") == instance_id)
    if kind is not None:
        log = log.where(F.col("kind") == kind)
    return log.orderBy(F.desc_nulls_last("started_at"), "run_id").limit(n)


def findings_of_run(findings: DataFrame, run_id: int) -> DataFrame:
    return findings.where(F.col("run_id") == run_id).orderBy("place")


def with_index_history(indexes: DataFrame, history: DataFrame) -> DataFrame:
    """``indexes`` with days_with_reads, days_with_writes; an index never seen has 0 if its instance was captured at all, else null."""
    captured = history.select("instance_id").distinct().withColumn("captured", F.lit(True))
    joined = indexes.join(history, ["instance_id", "table_name", "index_name"], "left").join(captured, "instance_id", "left")
    known = lambda c: F.coalesce(c, F.when(F.col("captured"), 0)).alias(c)
    return joined.select(*indexes.columns, known("days_with_reads"), known("days_with_writes"))


def metric_snapshot(cpu: DataFrame, memory: DataFrame, plans: DataFrame, io: DataFrame, tempdb: DataFrame, waits: DataFrame, live: DataFrame, deadlocks: DataFrame, instances: DataFrame, since: object) -> DataFrame:
    """A row for each instance with the metrics that alert rules look at, from its newest captures; what was never captured is null.

    ``since`` is where the count of recent deadlocks begins.
    """
    newest = lambda t, *columns: t.groupBy("instance_id").agg(*[F.max_by(c, "captured_at").alias(n) for n, c in columns])
    gb = F.col("total_kb") / 1_048_576
    latency = vitals.newest_tick(io)
    log = F.coalesce(F.col("file_type") == "LOG", F.lit(False))
    parts = [
        newest(cpu, ("runnable_tasks", F.try_divide("runnable", "schedulers"))),
        newest(memory, ("ple_seconds", F.col("ple_seconds")), ("pending_grants", F.col("pending_grants")), ("memory_gb", gb)),
        newest(plans, ("single_use_pct", F.try_divide(F.col("single_use_kb") * 100.0, F.col("total_kb")))),
        newest(tempdb, ("pagelatch_waiters", F.col("waiters"))),
        latency.groupBy("instance_id").agg(F.max(F.when(~log, F.greatest("read_ms", "write_ms"))).alias("data_latency_ms"), F.max(F.when(log, F.col("write_ms"))).alias("log_latency_ms")),
        vitals.signal_wait_pct(waits),
        blocked_sessions(live),
        instances.select("instance_id").join(events_since(deadlocks, since), "instance_id", "left").select("instance_id", F.coalesce("events", F.lit(0)).alias("deadlocks")),
    ]
    found = instances.select("instance_id").distinct()
    for part in parts:
        found = found.join(part, "instance_id", "left")
    return found


def kept_since(table: DataFrame, cutoff: object, at: str = "captured_at") -> DataFrame:
    """What retention leaves: rows at ``cutoff`` or later, and rows without a time."""
    return table.where(F.col(at).isNull() | (F.col(at) >= F.lit(cutoff)))


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """``table`` with ``changes`` over it: of each key the row of the greatest version stays, a change before an old row of its version. Columns are those of ``table``."""
    both = table.withColumn("change", F.lit(0)).unionByName(changes.withColumn("change", F.lit(1)))
    rest = [c for c in table.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "change")).alias("newest")).select(*keys, "newest.*").select(*table.columns)


def inserted_once(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new`` whose key ``table`` lacks, each key once: its earliest; rows without a key are left out."""
    first = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*new.columns), "captured_at").alias("row")).select("row.*")
    return first.join(table.select(key).distinct(), key, "left_anti").select(*new.columns)


def stored(table: DataFrame, path: str, at: str = "captured_at") -> None:
    """Appends to a Parquet table partitioned by day, which windows and retention prune."""
    table.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def pains(store: DataFrame, waits: DataFrame, live: DataFrame, deadlocks: DataFrame, ignorable: list[str], since: object = None, until: object = None) -> DataFrame:
    """A row for each instance: its top wait in the window, blocked sessions seen and deadlocks."""
    w = within(waits, since, until).where(~F.col("wait_type").isin(ignorable)).groupBy("instance_id", "wait_type").agg(F.sum("delta_ms").alias("total_ms"))
    top = w.groupBy("instance_id").agg(F.max_by(F.struct("wait_type", "total_ms"), F.struct("total_ms", "wait_type")).alias("top")).select("instance_id", F.col("top.wait_type").alias("top_wait"), F.col("top.total_ms").alias("top_wait_ms"))
    blocked = within(live, since, until).where("blocking_session_id is not null").groupBy("instance_id").agg(F.count("*").alias("blocked"))
    locked = within(deadlocks, since, until).groupBy("instance_id").agg(F.count("*").alias("deadlocks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return within(store, since, until).select("instance_id").distinct().join(top, "instance_id", "left").join(blocked, "instance_id", "left").join(locked, "instance_id", "left").select("instance_id", "top_wait", "top_wait_ms", zero("blocked"), zero("deadlocks"))


def report_lines(sections: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(section, place, line) of a report: each section's rows as text by a SQL expression; a section without rows has one line that says so."""
    found = []
    for i, (title, rows, line) in enumerate(sections):
        text = rows.select(F.expr(line).alias("line")).where("line is not null")
        numbered = text.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("line")))  # a report's sections are short lists
        none = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("nothing in this window").alias("line"), F.lit(1).alias("place"))
        found.append(numbered.unionByName(none).select(F.lit(i).alias("section_no"), F.lit(title).alias("section"), "place", "line"))
    return reduce(DataFrame.unionByName, found)


def markdown(lines: DataFrame) -> DataFrame:
    """One row (report) of ``report_lines`` as Markdown."""
    by = lines.groupBy("section_no", "section").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    text = F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- "), x["line"])), "\n"))
    return by.agg(F.array_sort(F.collect_list(F.struct("section_no", text.alias("text")))).alias("parts")).select(F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("report"))


def html(lines: DataFrame) -> DataFrame:
    """One row (report) of ``report_lines`` as HTML, signs escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    by = lines.groupBy("section_no", "section").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    text = F.concat(F.lit("<h2>"), safe(F.col("section")), F.lit("</h2><ul>"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<li>"), safe(x["line"]), F.lit("</li>"))), ""), F.lit("</ul>"))
    return by.agg(F.array_sort(F.collect_list(F.struct("section_no", text.alias("text")))).alias("parts")).select(F.concat(F.lit("<html><body>"), F.array_join(F.transform("parts", lambda p: p["text"]), ""), F.lit("</body></html>")).alias("report"))


def webhook_body(alerts: DataFrame, kind: str = "generic") -> DataFrame:
    """``alerts`` with ``body``, the JSON that a generic, Slack or Teams hook takes; nothing is sent."""
    text = F.concat_ws(" ", F.concat(F.lit("["), F.upper("severity"), F.lit("]")), "rule_id", F.concat(F.lit("on "), F.col("instance_name")), F.concat(F.lit("value "), F.col("value").cast("string")))
    fields = {"generic": F.struct("rule_id", "severity", "instance_name", "value"), "slack": F.struct(text.alias("text")), "teams": F.struct(F.lit("MessageCard").alias("@type"), F.col("rule_id").alias("title"), text.alias("text"))}
    return alerts.withColumn("body", F.to_json(fields[kind]))


