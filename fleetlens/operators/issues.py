"""From recommendations, findings, pains and facts to issues of one schema, and their reconciliation.

An issue has instance_id, issue_id, source, rule, severity, title, table_name,
impact and fix. Unknown facts give no issue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators import health

COLUMNS = ["instance_id", "issue_id", "source", "rule", "severity", "title", "table_name", "impact", "fix"]
#: Waits that a change of queries or settings can shorten, by the beginning of their names, and what they tell.
WAIT_KINDS = [("LCK_", "locking"), ("PAGEIOLATCH_", "storage reads"), ("PAGELATCH_", "hot pages"), ("WRITELOG", "log writes"), ("CX", "parallel plans"), ("SOS_SCHEDULER_YIELD", "processor"), ("RESOURCE_SEMAPHORE", "memory grants"), ("ASYNC_NETWORK_IO", "slow clients"), ("IO_COMPLETION", "storage"), ("THREADPOOL", "worker threads"), ("LATCH_", "latches"), ("HADR_", "replicas")]


def slug(text: Column) -> Column:
    """Letters of a text, runs of others as one hyphen, at most 90 signs."""
    return F.substring(F.btrim(F.regexp_replace(F.lower(text), "[^a-z]+", "-"), F.lit("-")), 1, 90)


def wait_kind(wait: Column) -> Column:
    found = F.lit(None).cast("string")
    for prefix, kind in reversed(WAIT_KINDS):
        found = F.when(wait.startswith(prefix), kind).otherwise(found)
    return found


def recommendation_impact(kind: Column, score: Column) -> Column:
    """0 to 10000, whatever a recommendation's score measures."""
    at_least = F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0))
    size = F.when(at_least < 1, 0).otherwise(F.round(1000 + F.least(F.log10(F.greatest(at_least / 1024, F.lit(1.0))) / 6, F.lit(1.0)) * 4000))
    wide = F.round(F.least(F.log10(1 + at_least) * 1400, F.lit(10000.0)))
    plain = F.least(F.round(at_least), F.lit(10000.0))
    return F.when(kind == "merge_index", size).when(kind.isin("rebuild_index", "update_statistics", "alter_column", "parameter_sniffing"), wide).otherwise(plain).cast("int")


def from_findings(findings: DataFrame) -> DataFrame:
    """Issues of (instance_id, rule, severity, message, table_name, rows, reserved_kb)."""
    return findings.select("instance_id", F.concat(F.col("rule"), F.lit(":"), slug(F.concat_ws(" ", "table_name", "message"))).alias("issue_id"), F.lit("static").alias("source"), "rule", "severity", F.col("message").alias("title"), "table_name", health.impact(F.col("severity"), F.col("rows"), F.col("reserved_kb")).alias("impact"), F.lit(None).cast("string").alias("fix"))


def from_recommendations(found: DataFrame) -> DataFrame:
    """Issues of (instance_id, kind, priority, title, table_name, score, ddl)."""
    severity = F.when(F.col("priority") == "high", "error").when(F.col("priority") == "medium", "warning").otherwise("info")
    return found.select("instance_id", F.concat(F.col("kind"), F.lit(":"), slug(F.concat_ws(" ", "table_name", "title"))).alias("issue_id"), F.lit("advisor").alias("source"), F.col("kind").alias("rule"), severity.alias("severity"), "title", "table_name", recommendation_impact(F.col("kind"), F.col("score")).alias("impact"), F.col("ddl").alias("fix"))


def from_pains(pains: DataFrame) -> DataFrame:
    """Issues of (instance_id, top_wait, top_wait_ms, blocked, deadlocks); a wait counts from 30 s on and only if something can be done about it."""
    wait = F.when(wait_kind(F.col("top_wait")).isNotNull() & (F.col("top_wait_ms") >= 30_000), F.when(F.col("top_wait_ms") > 120_000, "warning").otherwise("info"))
    blocked = F.when(F.col("blocked") > 500, "error").when(F.col("blocked") > 50, "warning").when(F.col("blocked") > 0, "info")
    locked = F.when(F.col("deadlocks") > 10, "critical").when(F.col("deadlocks") > 0, "error")
    said = [("monitor.top_wait", wait, F.concat(F.lit("Time is lost on "), wait_kind(F.col("top_wait"))), F.col("top_wait_ms") / 1000), ("monitor.blocking", blocked, F.lit("Sessions wait for each other"), F.col("blocked")), ("monitor.deadlocks", locked, F.lit("Deadlocks occurred"), F.col("deadlocks") * 100)]
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), title.alias("title"), F.least(F.round(size), F.lit(10000)).cast("int").alias("impact")) for rule, severity, title, size in said])
    hits = pains.select("instance_id", F.explode(F.filter(each, lambda x: x["severity"].isNotNull())).alias("x"))
    return hits.select("instance_id", F.col("x.rule").alias("issue_id"), F.lit("monitor").alias("source"), "x.rule", "x.severity", "x.title", F.lit(None).cast("string").alias("table_name"), "x.impact", F.lit(None).cast("string").alias("fix"))


def from_regressions(found: DataFrame) -> DataFrame:
    """Issues of (instance_id, query_id, delta_pct): 300 % slower is an error, 100 % a warning."""
    severity = F.when(F.col("delta_pct") >= 300, "error").when(F.col("delta_pct") >= 100, "warning").otherwise("info")
    name = F.concat(F.lit("monitor.regression:"), F.col("query_id").cast("string"))
    return found.select("instance_id", name.alias("issue_id"), F.lit("monitor").alias("source"), F.lit("monitor.regression").alias("rule"), severity.alias("severity"), F.concat(F.lit("Query "), F.col("query_id").cast("string"), F.lit(" became slower")).alias("title"), F.lit(None).cast("string").alias("table_name"), F.least(F.round("delta_pct"), F.lit(10000)).cast("int").alias("impact"), F.lit(None).cast("string").alias("fix"))


#: Advisor kinds that decide the same as a finding on the same table.
_SAME = {"dmv.missing_index": "create_index", "dmv.duplicate_or_overlapping_index": "merge_index", "dmv.unused_index": "drop_index"}


def reconciled(issues: DataFrame) -> DataFrame:
    """``issues`` (COLUMNS) with ``merged``: issues of a table that ask for the same decision are one.

    The advisor's of one kind merge, findings fold into the advisor's of their
    kind, a missing primary key into the finding that the table is a heap; the
    worst severity and the greatest impact stay, fixes are joined, each once.
    An issue without a table, or without such a partner, stays alone.
    """
    kind = F.col("rule")
    for rule, advised in _SAME.items():
        kind = F.when(F.col("rule") == rule, advised).otherwise(kind)
    kind = F.when(F.col("rule") == "structure.no_primary_key", "structure.heap_table").otherwise(kind)
    anchor = (F.col("source") == "advisor") | (F.col("rule") == "structure.heap_table")
    table = F.when(F.trim("table_name") != "", F.lower("table_name"))
    t = issues.select("*", kind.alias("kind"), anchor.alias("anchor"), table.alias("table"))
    hosts = t.where("anchor and table is not null").select("instance_id", "table", "kind").distinct().withColumn("hosted", F.lit(True))
    t = t.join(hosts, ["instance_id", "table", "kind"], "left")
    place = F.when(F.col("hosted"), F.concat_ws("|", "table", "kind")).otherwise(F.concat_ws("|", F.lit("alone"), "issue_id", "source", "rule"))
    host = F.min_by(F.struct("issue_id", "source", "rule", "title", "table_name"), F.struct((~F.col("anchor")).alias("a"), (-F.col("impact")).alias("i"), "issue_id")).alias("host")
    worst = F.min_by("severity", health.severity_rank(F.col("severity"))).alias("severity")
    fixes = F.array_join(F.array_sort(F.collect_set(F.when(F.trim("fix") != "", F.col("fix")))), "\n\n")
    by = t.groupBy("instance_id", place.alias("place")).agg(host, worst, F.max("impact").alias("impact"), fixes.alias("fix"), F.count("*").alias("merged"))
    return by.select("instance_id", "host.issue_id", "host.source", "host.rule", "severity", "host.title", "host.table_name", "impact", F.when(F.col("fix") != "", F.col("fix")).alias("fix"), "merged")


def ranked(issues: DataFrame) -> DataFrame:
    """``issues`` with ``rank`` within their instance: severity, impact, id."""
    return issues.withColumn("rank", F.row_number().over(Window.partitionBy("instance_id").orderBy(health.severity_rank(F.col("severity")), F.desc("impact"), "issue_id")))


def trend_band(worst_z: Column, last_updated: Column, window_from: Column) -> Column:
    """Where a baseline stands: stale before its window, regressed from 3 standard deviations on, elevated from half of that on."""
    return F.when(last_updated < window_from, "stale").when(worst_z >= 3.0, "regressed").when(worst_z >= 1.5, "elevated").otherwise("steady")


def monitor_state(last_capture: Column, now: Column) -> Column:
    """running if captured within 15 minutes, stopped if before, never if not at all."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_capture.cast("timestamp"))
    return F.when(last_capture.isNull(), "never").when(age <= 15 * 60 * 1_000_000, "running").otherwise("stopped")


#: Trace flags that hide faults or change the engine for all.
RISKY_FLAGS = (652, 661, 1211, 1224, 1806, 2330, 3505, 4138, 8649)


def operational(facts: DataFrame) -> DataFrame:
    """(instance_id, rule, severity) of a row of facts by instance; a fact that is null or couldn't be read fires nothing.

    Facts: maxdop, cpu_count, cost_threshold, optimize_for_adhoc, auto_shrink,
    auto_close, page_verify, auto_create_stats, auto_update_stats, vlf_count,
    backups_readable, full_backup_hours, recovery_model, log_backup_hours,
    checkdb_readable, db_is_read_only, checkdb_days, replica_unhealthy,
    jobs_readable, failed_jobs, critical_job_failed, ifi_enabled,
    tempdb_data_files, tempdb_files_unequal, trace_flags_readable, trace_flags.
    """
    c = F.col
    off = lambda name: ~c(name)
    wanted_files = F.least(c("cpu_count"), F.lit(8))
    never = lambda name: c(name).isNull()
    logged = c("backups_readable") & c("recovery_model").isin("FULL", "BULK_LOGGED")
    checked = c("checkdb_readable") & ~F.coalesce(c("db_is_read_only"), F.lit(False))
    checks = [
        ("config.maxdop_unbounded", "warning", (c("maxdop") == 0) & (c("cpu_count") > 8)),
        ("config.cost_threshold_default", "warning", c("cost_threshold") <= 5),
        ("config.optimize_for_adhoc_off", "info", off("optimize_for_adhoc")),
        ("config.auto_shrink_on", "warning", c("auto_shrink")),
        ("config.auto_close_on", "warning", c("auto_close")),
        ("config.page_verify_not_checksum", F.when(c("page_verify") == "NONE", "error").otherwise("warning"), c("page_verify") != "CHECKSUM"),
        ("config.auto_create_stats_off", "warning", off("auto_create_stats")),
        ("config.auto_update_stats_off", "warning", off("auto_update_stats")),
        ("log.high_vlf_count", "warning", c("vlf_count") > 10_000),
        ("backup.no_full_backup", "error", c("backups_readable") & never("full_backup_hours")),
        ("backup.full_backup_stale", "warning", c("backups_readable") & (c("full_backup_hours") > 168)),
        ("backup.no_log_backup", "warning", logged & never("log_backup_hours")),
        ("backup.log_backup_stale", "warning", logged & (c("log_backup_hours") > 24)),
        ("integrity.checkdb_never", "critical", checked & never("checkdb_days")),
        ("integrity.checkdb_stale", "critical", checked & (c("checkdb_days") >= 14)),
        ("hadr.replica_unhealthy", "critical", c("replica_unhealthy")),
        ("jobs.recent_failures", F.when(c("critical_job_failed"), "error").otherwise("warning"), c("jobs_readable") & (c("failed_jobs") > 0)),
        ("config.ifi_disabled", "warning", off("ifi_enabled")),
        ("tempdb.too_few_files", F.when(c("tempdb_data_files") <= 1, "warning").otherwise("info"), c("tempdb_data_files") < wanted_files),
        ("tempdb.unequal_files", "info", c("tempdb_files_unequal") & (c("tempdb_data_files") >= wanted_files)),
        ("config.dangerous_trace_flag", "warning", c("trace_flags_readable") & F.exists(c("trace_flags"), lambda f: f.isin(*RISKY_FLAGS))),
    ]
    found = F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(rule).alias("rule"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"))) for rule, severity, hit in checks])
    return facts.select("instance_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("instance_id", "x.*")


#: What can be done about a pain, step by step.
LADDERS = {
    "locking": ["find the session at the head of the chain", "shorten its transaction", "index its conditions", "turn row versioning on"],
    "storage reads": ["find the queries that read most", "index their conditions", "look at the latency of the data files"],
    "log writes": ["batch single-row commits", "look at the latency of the log file"],
    "parallel plans": ["raise the cost threshold", "limit MAXDOP", "index what the large scans read"],
    "processor": ["find the queries with most CPU time", "look for scalar functions and hidden conversions"],
    "memory grants": ["update statistics behind large sorts and hashes", "cap the grants"],
    "hot pages": ["spread tempdb over more files", "change ever-increasing keys of busy tables"],
    "regression": ["compare the plans before and after", "update statistics", "force the earlier plan while you look"],
    "blocking": ["find the session at the head of the chain", "end or shorten its transaction"],
}


def with_steps(pains: DataFrame, kind: str) -> DataFrame:
    """``pains`` with ``steps``, the ladder of the column ``kind``; unknown kinds have none."""
    ladders = F.create_map(*[x for k, v in LADDERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return pains.withColumn("steps", F.try_element_at(ladders, F.coalesce(F.col(kind), F.lit(""))))
