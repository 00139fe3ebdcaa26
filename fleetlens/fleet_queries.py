"""Queries of fleet reads, issues, advice and deadlocks over stand-ins, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import advisor, fleet, health, issues, telemetry, vitals
from fleetlens.plans import deadlocks
from fleetlens.sources import catalog, views

SINCE, UNTIL = "2024-01-06 00:00:00", "2024-01-21 00:00:00"
SHIPPED_SINCE, SHIPPED_UNTIL = "1997-01-01 00:00:00", "1999-01-01 00:00:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumns({"instance_id": F.col("user_id") % 5, "k": F.get_json_object("props", "$.k").cast("long")})


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions at hourly captures; every fourth waits for another."""
    return _events(spark, sf_dir).select("instance_id", F.date_trunc("hour", "ts").alias("captured_at"), F.col("event_id").alias("session_id"), F.when(F.col("k") % 4 == 0, F.col("k")).alias("blocking_session_id"), F.col("value").alias("duration_ms"))


def locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_type = 'error'").select("instance_id", "event_id", F.col("ts").alias("captured_at"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("instance_id"), F.col("r_name").alias("instance_name"), F.length("r_name").alias("created_at"))


def fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("value >= 120").select("instance_id", F.col("event_type").alias("rule_id"), F.col("ts").alias("fired_at"), F.col("event_id").alias("alert_id"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("event_id").alias("run_id"), "instance_id", F.col("event_type").alias("kind"), F.col("ts").alias("started_at"))


def usage_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative reads and writes by index; a week's first capture starts them anew, as ``views.counters`` does."""
    return views.counters(spark, sf_dir).select("instance_id", F.col("wait_type").alias("index_name"), "captured_at", F.col("total_ms").alias("seeks"), F.expr("total_ms div 3").alias("updates"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of an instance a nation, all from its key."""
    n = F.col("n_nationkey")
    known = lambda value, unknown: F.when(n % unknown != 0, value)
    return _table(spark, sf_dir, "nation").select(
        n.alias("instance_id"), known(n % 3, 7).alias("maxdop"), (n + 1).alias("cpu_count"), known(n * 3, 5).alias("cost_threshold"), known(n % 2 == 0, 11).alias("optimize_for_adhoc"), (n % 6 == 0).alias("auto_shrink"), (n % 8 == 1).alias("auto_close"),
        F.element_at(F.array(F.lit("CHECKSUM"), F.lit("NONE"), F.lit("TORN_PAGE_DETECTION")), (n % 3 + 1).cast("int")).alias("page_verify"), (n % 5 != 0).alias("auto_create_stats"), (n % 5 != 1).alias("auto_update_stats"), (n * 1000).alias("vlf_count"),
        (n % 4 != 0).alias("backups_readable"), known(n * 10, 9).alias("full_backup_hours"), F.when(n % 2 == 0, "FULL").otherwise("SIMPLE").alias("recovery_model"), known(n * 2, 6).alias("log_backup_hours"), (n % 5 != 0).alias("checkdb_readable"), (n % 10 == 3).alias("db_is_read_only"), known(n, 8).alias("checkdb_days"),
        (n % 12 == 0).alias("replica_unhealthy"), (n % 2 == 1).alias("jobs_readable"), (n % 3).alias("failed_jobs"), (n % 7 == 0).alias("critical_job_failed"), (n % 9 != 4).alias("ifi_enabled"), (n % 10).alias("tempdb_data_files"), (n % 2 == 0).alias("tempdb_files_unequal"), (n % 3 != 1).alias("trace_flags_readable"), F.array(n * 100 + 24, F.lit(1211) + n % 2).alias("trace_flags"),
    )


def physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog._parts(spark, sf_dir)
    return p.select("table_name", F.col("p_partkey").cast("string").alias("index_name"), F.col("p_size").cast("double").alias("fragmentation_pct"), (F.col("p_partkey") * 20).alias("pages"), (F.col("p_size") * 2).cast("long").alias("fill_factor"), (F.col("p_partkey") % 100).alias("seeks"), F.lit(0).cast("long").alias("scans"), F.lit(0).cast("long").alias("lookups"), (F.col("p_partkey") % 7).alias("updates"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog._parts(spark, sf_dir).select("table_name", F.col("p_partkey").cast("string").alias("stats_name"), (F.col("p_partkey") * 400).alias("rows"), (F.col("p_partkey") * F.col("p_size") * 3).alias("modifications"), (F.col("p_size") % 3 == 0).alias("no_recompute"))


def skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _events(spark, sf_dir).groupBy(F.col("user_id").alias("query_id"))
    return by.agg(F.countDistinct(F.col("k") % 3).alias("plans"), (F.count("*") * 10).alias("executions"), F.avg("value").alias("avg_reads"), (F.max("value") * 3).alias("max_reads"))


def lob_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("text", "NTEXT", "image", "int", "varchar")))
    return catalog._parts(spark, sf_dir).select("table_name", F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("column_name"), F.element_at(kinds, (F.col("p_size") % 5 + 1).cast("int")).alias("type_name"))


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, one a supplier, with sizes around the limits."""
    k = F.col("s_suppkey")
    types = F.when(k % 4 == 0, F.array(F.lit("uniqueidentifier"))).when(k % 4 == 1, F.array(*[F.lit("int")] * 4)).when(k % 4 == 2, F.array(F.lit("int")))
    return _table(spark, sf_dir, "supplier").select(F.concat(F.lit("t"), k.cast("string")).alias("table_name"), F.when(k % 11 != 0, F.pow(F.lit(10.0), k % 8).cast("long")).alias("rows"), (k % 3 == 0).alias("is_heap"), (k % 5 * 500).alias("forwarded_records"), (k % 2 == 0).alias("has_primary_key"), types.alias("clustered_types"), (k % 30).alias("clustered_bytes"))


def deadlock_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of two processes a supplier; every third is broken, and every second stands in its event as escaped text."""
    k = F.col("s_suppkey")
    graph = F.format_string('<deadlock-graph victim="p%1$d"><process-list><process id="p%1$d" spid="5" lockMode="S"><inputbuf>SELECT  1</inputbuf></process><process id="q%1$d" spid="6" lockMode="X"/></process-list><resource-list><keylock objectname="t%1$d" indexname="i"><owner-list><owner id="q%1$d" mode="X"/></owner-list><waiter-list><waiter id="p%1$d" mode="S"/></waiter-list></keylock></resource-list></deadlock-graph>', k)
    escaped = F.concat(F.lit("<event><value>"), F.replace(F.replace(graph, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</value></event>"))
    xml = F.when(k % 3 == 0, "<deadlock").when(k % 2 == 0, escaped).otherwise(F.concat(F.lit("<e>"), graph, F.lit("</e>")))
    return _table(spark, sf_dir, "supplier").select(k.alias("deadlock_id"), xml.alias("xml"))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = advisor.table_rows(catalog.partitions(spark, sf_dir))
    missing = catalog.missing_indexes(spark, sf_dir)
    found = advisor.missing_index_findings(missing, rows).join(rows, "table_name").select(F.lit(1).alias("instance_id"), "rule", "severity", F.array_join("key_columns", " ").alias("message"), "table_name", "rows", "reserved_kb")
    advised = advisor.create_index(missing, rows).select(F.lit(1).alias("instance_id"), F.lit("create_index").alias("kind"), "priority", F.array_join("key_columns", " ").alias("title"), "table_name", "score", F.lit(None).cast("string").alias("ddl"))
    return issues.from_findings(found).unionByName(issues.from_recommendations(advised))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = issues.operational(facts(spark, sf_dir)).withColumn("lane", F.when(F.col("rule").startswith("backup."), "reliability").when(F.col("rule").startswith("config."), "opportunity").otherwise("operational"))
    known = facts(spark, sf_dir).select("instance_id", (F.col("instance_id") * 3600).alias("monitored_seconds"), F.when(F.col("instance_id") % 2 == 0, F.col("instance_id") * 1800).alias("counter_seconds"), F.lit(0).alias("signals"))
    return health.lane_scores(known, found)


def _standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = lambda x: F.lit(x).cast("timestamp")
    seen = _events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("last_seen"), (F.max("value") / 150).alias("worst_z"))
    last = F.col("last_seen").cast("timestamp")
    return seen.select("user_id", issues.trend_band(F.col("worst_z"), last, stamp("2024-01-25 00:00:00")).alias("band"), issues.monitor_state(last, stamp("2024-01-30 12:00:00")).alias("state"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    store = views.query_store
    return {
        "top_queries_in_window": lambda s, d: telemetry.top_queries(fleet.within(store(s, d), SINCE, UNTIL), 20),
        "regressions_in_range": lambda s, d: telemetry.regressions(fleet.within(store(s, d), SINCE, UNTIL)),
        "unused_indexes_in_range": lambda s, d: telemetry.unused_indexes(fleet.within(views.index_usage(s, d), SHIPPED_SINCE, SHIPPED_UNTIL)),
        "index_usage_deltas": lambda s, d: fleet.trusted_deltas(usage_snapshots(s, d), ["index_name"], ["seeks", "updates"], ["seeks", "updates"]),
        "blocked_sessions": lambda s, d: fleet.blocked_sessions(live(s, d)),
        "longest_blocked": lambda s, d: fleet.longest_blocked(live(s, d), 5).select("instance_id", "place", "session_id", "blocking_session_id", "duration_ms"),
        "deadlocks_since": lambda s, d: fleet.events_since(locked(s, d), SINCE),
        "newest_deadlock": lambda s, d: fleet.newest_event(locked(s, d), "event_id"),
        "recent_alerts": lambda s, d: fleet.recent_alerts(fired(s, d), instances(s, d), 30),
        "newest_instance": lambda s, d: fleet.newest_instance(instances(s, d)),
        "analysis_runs": lambda s, d: fleet.runs(run_log(s, d), instance_id=2, kind="error", since=SINCE, n=25),
        "spaced_captures": lambda s, d: fleet.spaced_captures(live(s, d).select("instance_id", "captured_at")).select("instance_id", F.unix_seconds("captured_at").alias("secs")),
        "retained_rows": lambda s, d: fleet.kept_since(store(s, d), UNTIL).groupBy("query_id").agg(F.count("*").alias("kept")),
        "upserted_baselines": lambda s, d: fleet.upserted(fleet.within(store(s, d), None, SINCE).select("query_id", "captured_at", "total_duration_ms"), fleet.within(store(s, d), SINCE).where("executions > 3").select("query_id", "captured_at", "total_duration_ms"), ["query_id"], "captured_at"),
        "pains": lambda s, d: fleet.pains(store(s, d).withColumn("instance_id", F.col("query_id") % 5), telemetry.counter_deltas(views.counters(s, d)), live(s, d), locked(s, d), ["view"], SINCE, UNTIL),
        "operational_checks": lambda s, d: issues.operational(facts(s, d)),
        "lane_scores": _scored,
        "issues_reconciled": lambda s, d: issues.ranked(issues.reconciled(_issues(s, d))).select("table_name", "source", "rule", "severity", "impact", "merged"),
        "standing": _standing,
        "structure_findings": lambda s, d: advisor.structure_findings(structures(s, d)),
        "rebuild_index": lambda s, d: advisor.rebuild_index(physical(s, d)),
        "update_statistics": lambda s, d: advisor.update_statistics(statistics(s, d)),
        "parameter_sniffing": lambda s, d: advisor.parameter_sniffing(skew(s, d)),
        "lob_findings": lambda s, d: advisor.lob_findings(lob_columns(s, d)),
        "alter_column": lambda s, d: advisor.alter_column(lob_columns(s, d)),
        "size_growth": lambda s, d: vitals.size_growth(_table(s, d, "orders").select(F.col("o_orderstatus").alias("table_name"), F.struct("o_orderdate", "o_orderkey").alias("captured_at"), F.col("o_orderkey").alias("row_count"), F.col("o_custkey").alias("used_kb"))),
        "merge_same_keys": lambda s, d: advisor.merge_same_keys(catalog.indexes(s, d)),
        "drop_index_ddl": lambda s, d: advisor.drop_ddl(advisor.drop_index(catalog.indexes(s, d))),
        "create_index_ddl": lambda s, d: advisor.create_ddl(catalog.missing_indexes(s, d)).select("table_name", F.array_join("key_columns", ",").alias("key_columns"), "ddl").distinct(),
        "boosted_indexes": lambda s, d: advisor.boosted(advisor.create_index(catalog.missing_indexes(s, d), advisor.table_rows(catalog.partitions(s, d))).groupBy("table_name").agg(F.max("score").alias("score")), catalog.partitions(s, d).select("table_name", F.col("row_count").alias("execution_count"), (F.col("reserved_kb") / 1000).alias("window_hours"))).select("table_name", F.round("score", 2).alias("score"), F.round("executions_per_day", 2).alias("executions_per_day")),
        "deadlock_edges": lambda s, d: deadlocks.edges(deadlock_events(s, d)),
        "deadlock_processes": lambda s, d: deadlocks.processes(deadlock_events(s, d)),
    }


_EV = "ev as (select *, user_id % 5 as instance_id, cast(json_extract_string(props, '$.k') as bigint) as k, date_trunc('hour', ts) as hour from events)"
_LIVE = "live as (select instance_id, hour as captured_at, event_id as session_id, case when k % 4 = 0 then k end as blocking_session_id, value as duration_ms from ev)"
_CHECKS = [
    ("config.maxdop_unbounded", "'warning'", "n % 7 <> 0 and n % 3 = 0 and n + 1 > 8"),
    ("config.cost_threshold_default", "'warning'", "n % 5 <> 0 and n * 3 <= 5"),
    ("config.optimize_for_adhoc_off", "'info'", "n % 11 <> 0 and n % 2 <> 0"),
    ("config.auto_shrink_on", "'warning'", "n % 6 = 0"),
    ("config.auto_close_on", "'warning'", "n % 8 = 1"),
    ("config.page_verify_not_checksum", "case when n % 3 = 1 then 'error' else 'warning' end", "n % 3 <> 0"),
    ("config.auto_create_stats_off", "'warning'", "n % 5 = 0"),
    ("config.auto_update_stats_off", "'warning'", "n % 5 = 1"),
    ("log.high_vlf_count", "'warning'", "n * 1000 > 10000"),
    ("backup.no_full_backup", "'error'", "n % 4 <> 0 and n % 9 = 0"),
    ("backup.full_backup_stale", "'warning'", "n % 4 <> 0 and n % 9 <> 0 and n * 10 > 168"),
    ("backup.no_log_backup", "'warning'", "n % 4 <> 0 and n % 2 = 0 and n % 6 = 0"),
    ("backup.log_backup_stale", "'warning'", "n % 4 <> 0 and n % 2 = 0 and n % 6 <> 0 and n * 2 > 24"),
    ("integrity.checkdb_never", "'critical'", "n % 5 <> 0 and n % 10 <> 3 and n % 8 = 0"),
    ("integrity.checkdb_stale", "'critical'", "n % 5 <> 0 and n % 10 <> 3 and n % 8 <> 0 and n >= 14"),
    ("hadr.replica_unhealthy", "'critical'", "n % 12 = 0"),
    ("jobs.recent_failures", "case when n % 7 = 0 then 'error' else 'warning' end", "n % 2 = 1 and n % 3 > 0"),
    ("config.ifi_disabled", "'warning'", "n % 9 = 4"),
    ("tempdb.too_few_files", "case when n % 10 <= 1 then 'warning' else 'info' end", "n % 10 < least(n + 1, 8)"),
    ("tempdb.unequal_files", "'info'", "n % 2 = 0 and n % 10 >= least(n + 1, 8)"),
    ("config.dangerous_trace_flag", "'warning'", "n % 3 <> 1 and (n % 2 = 0 or n * 100 + 24 in (652, 661, 1211, 1224, 1806, 2330, 3505, 4138, 8649))"),
]


def _checks() -> str:
    each = " union all ".join(f"select n as instance_id, '{rule}' as rule, {severity} as severity from f where {when}" for rule, severity, when in _CHECKS)
    return f"f as (select n_nationkey as n from nation), checks as ({each})"


def oracle_sql(deltas: str) -> dict[str, str]:
    w, c, e = f"with recursive {views.SQL}", f"with {views.SQL}, {catalog.SQL}", f"with {_EV}, {_LIVE}"
    window = f"captured_at >= timestamp '{SINCE}' and captured_at < timestamp '{UNTIL}'"
    newest = "captured_at = (select max(captured_at) from live m where m.instance_id = live.instance_id)"
    points = "case severity when 'critical' then 25 when 'error' then 12 when 'warning' then 4 else 1 end"
    lost = lambda lane, cap, test: f"100 - least(coalesce(sum({points}) filter (where {test}), 0), {cap}) as {lane}"
    return {
        "top_queries_in_window": f"{w} select query_id, plan_id, round(sum(total_duration_ms), 4) as duration_ms, cast(sum(executions) as bigint) as executions, max(query_sql_text) as text, max(captured_at) as last_seen from query_store where {window} group by 1, 2 order by duration_ms desc nulls last, query_id, plan_id limit 20",
        "regressions_in_range": f"""{w}, samples as (select query_id, executions, total_duration_ms / executions as ms, row_number() over (partition by query_id order by captured_at desc, event_id desc) as age from query_store where executions > 0 and {window}),
            base as (select query_id, avg(ms) filter (where age > 1) as mean, stddev_samp(ms) filter (where age > 1) as sd, max(ms) filter (where age = 1) as ms, count(*) as n, sum(executions) as executions from samples group by 1)
            select query_id, cast(round(mean) as bigint) as baseline_ms, cast(round(ms) as bigint) as current_ms, round(case when mean > 0 then (ms / mean - 1) * 100 else 0 end, 4) as delta_pct from base where n >= 6 and executions >= 10 and sd > 0 and ms - mean >= 3 * sd and ms - mean >= 5 order by current_ms - baseline_ms desc, query_id limit 50""",
        "unused_indexes_in_range": f"{w} select table_id, index_id, cast(sum(updates) as bigint) as updates from index_usage where captured_at >= timestamp '{SHIPPED_SINCE}' and captured_at < timestamp '{SHIPPED_UNTIL}' group by 1, 2 having sum(seeks) = 0 and sum(scans) = 0 and sum(lookups) = 0 and sum(updates) > 100 order by updates desc, table_id, index_id limit 50",
        "index_usage_deltas": f"{w}, {deltas}, full_ as (select c.instance_id, c.wait_type, c.captured_at, c.total_ms, coalesce(p.total_ms, 0) as prior from counters c join ticks t on c.instance_id = t.instance_id and c.captured_at = t.captured_at left join counters p on p.instance_id = c.instance_id and p.wait_type = c.wait_type and p.captured_at = t.before), kept as (select distinct instance_id, captured_at from deltas) select instance_id, wait_type as index_name, captured_at, greatest(total_ms - prior, 0) as seeks, greatest(total_ms // 3 - prior // 3, 0) as updates from full_ join kept using (instance_id, captured_at) where total_ms > prior",
        "blocked_sessions": f"{e} select instance_id, count(blocking_session_id) as blocked from live where {newest} group by 1",
        "longest_blocked": f"{e} select instance_id, row_number() over (partition by instance_id order by duration_ms desc nulls last, session_id) as place, session_id, blocking_session_id, duration_ms from live where {newest} and blocking_session_id is not null qualify place <= 5",
        "deadlocks_since": f"with {_EV} select instance_id, count(*) as events from ev where event_type = 'error' and ts >= timestamp '{SINCE}' group by 1",
        "newest_deadlock": f"with {_EV} select instance_id, event_id, ts as captured_at from ev where event_type = 'error' qualify row_number() over (partition by instance_id order by ts desc, event_id desc) = 1",
        "recent_alerts": f"with {_EV} select instance_id, event_type as rule_id, ts as fired_at, event_id as alert_id, r_name as instance_name from ev join region on r_regionkey = instance_id where value >= 120 order by fired_at desc, instance_id, rule_id limit 30",
        "newest_instance": "select r_regionkey as instance_id from region order by length(r_name) desc, r_regionkey desc limit 1",
        "analysis_runs": f"with {_EV} select event_id as run_id, instance_id, event_type as kind, ts as started_at from ev where instance_id = 2 and event_type = 'error' and ts >= timestamp '{SINCE}' order by started_at desc, run_id limit 25",
        "spaced_captures": f"with recursive {_EV}, b as (select distinct instance_id, epoch_us(hour) // 1000000 as secs from ev), x as (select instance_id, min(secs) as secs from b group by 1 union all select instance_id, secs from (select x.instance_id, (select min(b.secs) from b where b.instance_id = x.instance_id and b.secs >= x.secs + 72000) as secs from x) where secs is not null) select instance_id, secs from x",
        "retained_rows": f"{w} select query_id, count(*) as kept from query_store where captured_at >= timestamp '{UNTIL}' group by 1",
        "upserted_baselines": f"{w} select query_id, captured_at, total_duration_ms from query_store where captured_at < timestamp '{SINCE}' or executions > 3 qualify row_number() over (partition by query_id order by captured_at desc) = 1",
        "pains": f"""{w}, {deltas}, {_EV}, {_LIVE}, s as (select distinct query_id % 5 as instance_id from query_store where {window}),
            t as (select instance_id, wait_type, cast(sum(delta_ms) as bigint) as ms from deltas where wait_type <> 'view' and {window} group by 1, 2 qualify row_number() over (partition by instance_id order by ms desc, wait_type desc) = 1),
            b as (select instance_id, count(*) as blocked from live where blocking_session_id is not null and {window} group by 1), l as (select instance_id, count(*) as deadlocks from ev where event_type = 'error' and ts >= timestamp '{SINCE}' and ts < timestamp '{UNTIL}' group by 1)
            select instance_id, wait_type as top_wait, ms as top_wait_ms, coalesce(blocked, 0) as blocked, coalesce(deadlocks, 0) as deadlocks from s left join t using (instance_id) left join b using (instance_id) left join l using (instance_id)""",
        "operational_checks": f"with {_checks()} select * from checks",
        "lane_scores": f"""with {_checks()}, g as (select n as instance_id, {lost("reliability_score", 80, "rule like 'backup.%'")}, {lost("opportunity_score", 60, "rule like 'config.%'")}, {lost("operational_score", 80, "rule not like 'backup.%' and rule not like 'config.%'")}, count(rule) as issues from f left join checks on n = instance_id group by 1),
            h as (select instance_id, case when issues = 0 then case when instance_id * 3600 >= 21600 then 98 else 95 end else reliability_score end as reliability_score, case when issues = 0 then case when instance_id * 3600 >= 21600 then 98 else 95 end else opportunity_score end as opportunity_score, case when issues = 0 then case when instance_id * 3600 >= 21600 then 98 else 95 end else operational_score end as operational_score,
            (issues = 0 and instance_id * 3600 < 21600) or (instance_id % 2 = 0 and instance_id * 1800 < 21600) as learning from g), j as (select *, least(reliability_score, opportunity_score, operational_score) as score from h)
            select instance_id, cast(reliability_score as int) as reliability_score, cast(opportunity_score as int) as opportunity_score, cast(operational_score as int) as operational_score, learning, cast(score as int) as score, case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 60 then 'D' else 'F' end as grade from j""",
        "issues_reconciled": f"""{c}, n as (select *, len(key_columns) as nk, 2 * len(key_columns) + len(included_columns) as units from missing left join table_rows using (table_name) where rows >= 1000 or rows is null),
            s as (select table_name, round(cost * impact / 100 * greatest(seeks, 1) / case when nk >= 5 or units >= 12 then 3.0 when nk >= 3 or units >= 6 then 1.75 else 1.0 end, 6) as score, 1000 + cast(round(999 * least(greatest(coalesce(case when rows > 0 then log10(rows) / 9 end, 0), coalesce(case when reserved_kb > 0 then log10(greatest(reserved_kb // 1024, 1)) / 6 end, 0)), 1)) as int) as sized from n)
            select table_name, 'advisor' as source, 'create_index' as rule, case when max(score) >= 10 then 'error' when max(score) >= 1 then 'warning' else 'info' end as severity, greatest(max(sized), max(cast(least(round(score), 10000) as int))) as impact, 2 * count(*) as merged from s group by 1""",
        "standing": "select user_id, case when max(ts) < timestamp '2024-01-25' then 'stale' when max(value) / 150 >= 3 then 'regressed' when max(value) / 150 >= 1.5 then 'elevated' else 'steady' end as band, case when max(ts) >= timestamp '2024-01-30 11:45:00' then 'running' else 'stopped' end as state from events group by 1",
        "structure_findings": """with t as (select 't' || s_suppkey as table_name, s_suppkey as k, case when s_suppkey % 11 <> 0 then cast(pow(10, s_suppkey % 8) as bigint) end as rows from supplier),
            h as (select *, case when rows >= 1000000 then 'error' when rows >= 100000 then 'warning' when rows >= 1000 then 'info' end as size from t)
            select table_name, 'structure.heap_table' as rule, case when size = 'info' and k % 5 * 500 >= 1000 then 'warning' else size end as severity from h where k % 3 = 0 and size is not null
            union all select table_name, 'structure.no_primary_key', case when rows >= 1000000 then 'error' else 'warning' end from t where k % 2 <> 0 and rows >= 100
            union all select table_name, 'structure.guid_clustered_key', case when rows < 1000 then 'info' else 'warning' end from t where k % 4 = 0
            union all select table_name, 'structure.wide_clustered_key', 'info' from t where k % 4 <> 0 and (k % 4 = 1 or k % 30 > 16)""",
        "rebuild_index": "select lower(p_brand) as table_name, cast(p_partkey as varchar) as index_name, case when p_size >= 30 and p_partkey * 20 >= 1000 then 'fragmented' else 'fill_factor' end as reason from part where (p_size >= 30 and p_partkey * 20 >= 1000) or (p_size * 2 > 0 and p_size * 2 < 70 and p_partkey % 100 > 0 and 10 * (p_partkey % 7) <= p_partkey % 100)",
        "update_statistics": "select lower(p_brand) as table_name, cast(p_partkey as varchar) as stats_name, round(p_partkey * p_size * 3 * 100.0 / (p_partkey * 400), 4) as changed_pct from part where (p_size % 3 = 0 and p_size * 300 / 400 >= 10 and p_partkey * p_size * 3 >= 1000) or (p_partkey * 400 >= 100000 and p_size * 300 / 400 >= 20)",
        "parameter_sniffing": f"with {_EV}, s as (select user_id as query_id, count(distinct k % 3) as plans, count(*) * 10 as executions, avg(value) as a, max(value) * 3 as m from ev group by 1) select query_id, round(m / a, 4) as ratio, case when m >= 1000000 then 'high' else 'medium' end as priority from s where plans >= 2 and executions >= 50 and a > 0 and m / a >= 10",
        "lob_findings": "select lower(p_brand) as table_name, 'c' || p_partkey as column_name, 'structure.deprecated_lob_type' as rule, 'warning' as severity from part where p_size % 5 < 3",
        "alter_column": "select lower(p_brand) as table_name, 'c' || p_partkey as column_name, 'ALTER TABLE [' || lower(p_brand) || '] ALTER COLUMN [c' || p_partkey || '] ' || case p_size % 5 when 0 then 'varchar(max)' when 1 then 'nvarchar(max)' else 'varbinary(max)' end || ';' as ddl, 'medium' as priority from part where p_size % 5 < 3",
        "size_growth": "select o_orderstatus as table_name, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first_rows, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_rows, arg_min(o_custkey, (o_orderdate, o_orderkey)) as first_kb, arg_max(o_custkey, (o_orderdate, o_orderkey)) as last_kb from orders group by 1",
        "merge_same_keys": f"""{c}, i as (select *, {"seeks + scans + lookups"} as reads, is_primary_key or is_unique as bound from indexes),
            e as (select *, first_value(index_name) over x as keep, row_number() over x as place from i window x as (partition by table_name, key_columns, list_sort(included_columns) order by bound desc, index_name)),
            o as (select *, first_value(index_name) over x as keeper, row_number() over x as place2 from e where place = 1 and not bound window x as (partition by table_name, key_columns order by reads desc, index_name))
            select table_name, keep, index_name as retire, 'exact' as kind, case when reserved_kb > 0 then 'medium' else 'low' end as priority, reserved_kb as reclaimed_kb, 'observed' as confidence from e where place > 1 and not bound
            union all select table_name, keeper, index_name, 'overlapping', 'low', reserved_kb, 'observed' from o where place2 > 1""",
        "drop_index_ddl": f"{c}, spare as (select * from indexes where seeks + scans + lookups = 0 and not is_primary_key and not is_unique and not is_clustered) select table_name, index_name, case when updates > 100 then 'write_only' else 'never_touched' end as kind, case when updates > 100 and updates >= 100000 then 'high' when updates > 100 and updates >= 10000 then 'medium' else 'low' end as priority, 'DROP INDEX [' || index_name || '] ON [' || table_name || '];' as ddl from spare where updates > 100 or updates = 0",
        "create_index_ddl": f"""{c} select distinct table_name, array_to_string(key_columns, ',') as key_columns, 'CREATE NONCLUSTERED INDEX [' || substr('IX_' || regexp_replace(table_name || '_' || array_to_string(key_columns, '_'), '[^A-Za-z0-9_]', '', 'g'), 1, 120) || '] ON [' || table_name || '] (' || '[' || array_to_string(key_columns, '], [') || ']' || ')' || case when len(included_columns) > 0 then ' INCLUDE ([' || array_to_string(included_columns, '], [') || '])' else '' end || ';' as ddl from missing""",
        "boosted_indexes": f"""{c}, n as (select *, len(key_columns) as nk, 2 * len(key_columns) + len(included_columns) as units from missing left join table_rows using (table_name) where rows >= 1000 or rows is null),
            s as (select table_name, max(round(cost * impact / 100 * greatest(seeks, 1) / case when nk >= 5 or units >= 12 then 3.0 when nk >= 3 or units >= 6 then 1.75 else 1.0 end, 6)) as score from n group by 1),
            b as (select table_name, max(row_count * 24.0 / (reserved_kb / 1000)) as per_day from partitions where reserved_kb > 0 group by 1)
            select table_name, round(score * case when per_day > 0 then 1 + ln(1 + per_day) / ln(10) else 1 end, 2) as score, round(per_day, 2) as executions_per_day from s left join b using (table_name)""",
        "deadlock_edges": "select s_suppkey as deadlock_id, 'keylock' as resource, 't' || s_suppkey as object_name, 'i' as index_name, 'q' || s_suppkey as owner_id, 'X' as owner_mode, 'p' || s_suppkey as waiter_id, 'S' as waiter_mode from supplier where s_suppkey % 3 <> 0",
        "deadlock_processes": "select s_suppkey as deadlock_id, 'p' || s_suppkey as process_id, '5' as spid, true as is_victim, cast(null as varchar) as isolation_level, 'S' as lock_mode, cast(null as varchar) as wait_resource, 'SELECT 1' as sql from supplier where s_suppkey % 3 <> 0 union all select s_suppkey, 'q' || s_suppkey, '6', false, null, 'X', null, null from supplier where s_suppkey % 3 <> 0",
    }
