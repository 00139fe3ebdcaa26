"""Queries of the telemetry store over stand-ins, with the SQL that says the same: commits, merges, retention and vitals read back from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import vitals
from fleetlens.sources.store import Snapshot, Store, shared_folder

#: Where retention cuts, from where index history counts, and the points of a series here.
CUTOFF, SINCE, POINTS = "2024-01-12 06:00:00", "2024-01-05 00:00:00", 12


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", (F.col("user_id") % 5).alias("instance_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _store(spark: SparkSession, name: str) -> Store:
    return Store(spark, shared_folder(spark, name))


def runs_with_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs and their line items as findings, committed together, read back from one snapshot."""
    store = _store(spark, "runs")
    orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    runs = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp").alias("occurred_at"), F.col("o_orderstatus").alias("mode"))
    findings = items.select(F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linestatus").alias("rule_id"), F.col("l_returnflag").alias("severity"), F.col("l_linenumber").cast("int").alias("line_no"), F.lit("m").alias("message"))
    store.write({"analysis_runs": runs, "analysis_findings": findings})
    shot = store.snapshot()
    worst = shot.read("analysis_findings").groupBy("run_id").agg(F.count("*").alias("findings"), F.min("rule_id").alias("first_rule"))
    return shot.read("analysis_runs").join(worst, F.col("id") == F.col("run_id"), "left").select("id", "mode", F.coalesce("findings", F.lit(0)).alias("findings"), "first_rule")


def merged_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines of January's two halves, the second over the first; the buckets that it touched are compacted."""
    store, e = _store(spark, "baselines"), _events(spark, sf_dir)
    rows = lambda half: half.groupBy("instance_id", F.col("k").alias("query_id")).agg(F.count("*").alias("count"), F.max("ts").alias("last_updated"))
    store.write({"query_baseline": rows(e.where("ts < timestamp '2024-01-15'"))})
    store.write({"query_baseline": rows(e.where("ts >= timestamp '2024-01-15' and k % 3 = 0"))})
    store.compact("query_baseline")
    return store.snapshot().read("query_baseline").select("instance_id", "query_id", "count", F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))


def retained_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What retention leaves of the waits, by day."""
    store = _store(spark, "waits")
    store.write({"wait_stats_delta": _events(spark, sf_dir).select("instance_id", F.col("ts").alias("captured_at"), F.col("event_type").alias("wait_type"), F.col("k").alias("wait_time_ms_delta"))})
    store.prune(CUTOFF, ["wait_stats_delta"])
    store.vacuum(keep=1)
    kept = store.snapshot().read("wait_stats_delta")
    return kept.groupBy(F.to_date("captured_at").alias("day"), "wait_type").agg(F.count("*").alias("waits"), F.sum("wait_time_ms_delta").alias("total_ms"))


def _vital_tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """Hourly captures of all surfaces, committed and read back."""
    store, e = _store(spark, "vitals"), _events(spark, sf_dir)
    hours = e.groupBy("instance_id", F.date_trunc("hour", "ts").alias("captured_at")).agg(F.count("*").alias("n"), F.max("k").alias("high"), F.min("k").alias("low"))
    store.write({
        "cpu_pressure_snapshot": hours.select("instance_id", "captured_at", F.col("n").alias("runnable_tasks"), F.lit(4).alias("online_schedulers")),
        "memory_headroom_snapshot": hours.where("high % 2 = 0").select("instance_id", "captured_at", (F.col("n") * 100).alias("page_life_expectancy")),
        "tempdb_contention_snapshot": hours.select("instance_id", "captured_at", F.col("high").alias("pagelatch_waiters"), F.col("low").alias("pfs_waiters")),
        "plan_cache_snapshot": hours.where("instance_id <> 2").select("instance_id", "captured_at", F.col("low").alias("single_use_plan_count")),
        "io_latency_delta": e.where("k % 4 < 3").select("instance_id", F.date_trunc("hour", "ts").alias("captured_at"), F.concat(F.lit("f"), (F.col("k") % 4).cast("string")).alias("file_logical_name"), F.col("k").cast("double").alias("avg_read_latency_ms"), F.when(F.col("k") % 2 == 0, F.col("k") * 2.0).alias("avg_write_latency_ms")),
        "missing_index_snapshot": e.where("event_type = 'error'").select("instance_id", F.col("ts").alias("captured_at"), F.lit("dbo").alias("schema_name"), F.concat(F.lit("t"), (F.col("k") % 3).cast("string")).alias("table_name"), F.col("k").alias("user_seeks")),
    })
    shot: Snapshot = store.snapshot()
    return shot.read


def deep_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("instance_id")).unionByName(spark.range(1).select(F.lit(99).cast("long").alias("instance_id")))
    found = vitals.deep_vitals(instances, _vital_tables(spark, sf_dir), SINCE, POINTS)
    said = lambda c: F.array_join(F.transform(c, lambda p: F.concat(F.date_format(p["captured_at"], "dd-HH"), F.lit(":"), p["value"].cast("long").cast("string"))), " ").alias(c)
    series = [*(s for _, s, _ in vitals.SURFACES.values()), "io_worst_latency_ms"]
    history = F.array_join(F.transform("missing_index_history", lambda h: F.format_string("%s.%s %d/%d %d", h["schema_name"], h["table_name"], h["days_seen"], h["days_observed"], h["max_user_seeks"])), " ").alias("missing_index_history")
    return found.select("instance_id", "has_data", F.col("captured_at").cast("timestamp_ntz").alias("captured_at"), F.col("cpu_pressure.runnable_tasks").alias("runnable_tasks"), F.col("memory_headroom.page_life_expectancy").alias("ple"), F.col("plan_cache.single_use_plan_count").alias("single_use"), F.size("io_latency").cast("long").alias("files"), *map(said, series), history)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"stored_runs": runs_with_findings, "stored_baselines": merged_baselines, "retained_waits": retained_waits, "deep_vitals": deep_vitals}


def _series(table: str, value: str, name: str) -> str:
    """The newest points of each instance, oldest first, as text."""
    return f"{name} as (select instance_id, string_agg(strftime(tick, '%d-%H') || ':' || v, ' ' order by tick) as {name} from (select instance_id, tick, cast({value} as bigint) as v, row_number() over (partition by instance_id order by tick desc) as age from {table}) where age <= {POINTS} group by 1)"


def oracle_sql() -> dict[str, str]:
    ev = "ev as (select *, user_id % 5 as instance_id, cast(json_extract_string(props, '$.k') as bigint) as k from events)"
    return {
        "stored_runs": "select cast(o_orderkey as varchar) as id, o_orderstatus as mode, count(l_orderkey) as findings, min(l_linestatus) as first_rule from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderstatus",
        "stored_baselines": f"with {ev}, b as (select instance_id, k as query_id, count(*) as count, max(ts) as last_updated, false as later from ev where ts < timestamp '2024-01-15' group by 1, 2 union all select instance_id, k, count(*), max(ts), true from ev where ts >= timestamp '2024-01-15' and k % 3 = 0 group by 1, 2) select instance_id, query_id, count, last_updated from b qualify row_number() over (partition by instance_id, query_id order by later desc) = 1",
        "retained_waits": f"with {ev} select cast(ts as date) as day, event_type as wait_type, count(*) as waits, cast(sum(k) as bigint) as total_ms from ev where ts >= timestamp '{CUTOFF}' group by 1, 2",
        "deep_vitals": f"""with {ev}, h as (select instance_id, date_trunc('hour', ts) as tick, count(*) as n, max(k) as high, min(k) as low from ev group by 1, 2),
            m as (select * from h where high % 2 = 0), p as (select * from h where instance_id <> 2), i as (select instance_id, date_trunc('hour', ts) as tick, max(greatest(k, case when k % 2 = 0 then 2 * k end)) as worst, count(*) as files from ev where k % 4 < 3 group by 1, 2),
            {_series("h", "n", "cpu_runnable_tasks")}, {_series("m", "n * 100", "memory_ple")}, {_series("h", "high", "tempdb_total_waiters")}, {_series("p", "low", "plan_cache_single_use")}, {_series("i", "worst", "io_worst_latency_ms")},
            w as (select instance_id, 't' || k % 3 as t, k, cast(ts as date) as day from ev where event_type = 'error' and ts >= timestamp '{SINCE}'),
            d as (select instance_id, string_agg('dbo.' || t || ' ' || seen || '/' || observed || ' ' || top, ' ' order by seen desc, top desc, t) as missing_index_history from (select instance_id, t, count(distinct day) as seen, max(k) as top from w group by 1, 2) join (select instance_id, count(distinct day) as observed from w group by 1) using (instance_id) group by 1),
            newest as (select instance_id, max(tick) as captured_at from (select instance_id, tick from h union all select instance_id, tick from i) group by 1),
            r as (select r_regionkey as instance_id from region union all select 99)
            select r.instance_id, captured_at is not null as has_data, captured_at, (select arg_max(n, tick) from h where h.instance_id = r.instance_id) as runnable_tasks, (select arg_max(n, tick) * 100 from m where m.instance_id = r.instance_id) as ple, (select arg_max(low, tick) from p where p.instance_id = r.instance_id) as single_use,
                coalesce((select arg_max(files, tick) from i where i.instance_id = r.instance_id), 0) as files, coalesce(cpu_runnable_tasks, '') as cpu_runnable_tasks, coalesce(memory_ple, '') as memory_ple, coalesce(tempdb_total_waiters, '') as tempdb_total_waiters, coalesce(plan_cache_single_use, '') as plan_cache_single_use, coalesce(io_worst_latency_ms, '') as io_worst_latency_ms, coalesce(missing_index_history, '') as missing_index_history
            from r left join newest using (instance_id) left join cpu_runnable_tasks using (instance_id) left join memory_ple using (instance_id) left join tempdb_total_waiters using (instance_id) left join plan_cache_single_use using (instance_id) left join io_worst_latency_ms using (instance_id) left join d using (instance_id)""",
    }
