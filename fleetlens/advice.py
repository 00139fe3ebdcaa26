"""Queries on catalog stand-ins and on newest captures, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import advisor, telemetry, vitals
from fleetlens.sources import catalog, views

#: Rules that the stand-in snapshots have metrics for.
RULES = [("errors_in_hour", "deadlocks", "gt", 1.0, "error"), ("latency_high", "data_latency_ms", "ge", 100.0, "warning"), ("traffic_low", "page_life_seconds", "lt", None, "warning")]


def _k():
    return F.get_json_object("props", "$.k").cast("long")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("instance_id", F.col("user_id") % 5)


def io(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("instance_id", F.date_trunc("hour", "ts").alias("captured_at"), F.when(_k() % 2 == 0, F.col("value")).alias("read_ms"), F.when(_k() % 3 == 0, F.col("value")).alias("write_ms"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.when(_k() % 5 != 0, F.concat("event_type", F.lit("_"), F.col("instance_id").cast("string"))).alias("item"), F.col("ts").alias("captured_at"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _events(spark, sf_dir).withColumn("captured_at", F.date_trunc("hour", "ts")).groupBy("instance_id", "captured_at")
    return by.agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("deadlocks"), F.round(F.avg("value"), 4).alias("data_latency_ms"), (F.count("*") * 100).alias("page_life_seconds"), F.max(_k()).cast("double").alias("memory_gb"))


def _waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.counter_deltas(views.counters(spark, sf_dir)).withColumn("signal_ms", F.col("delta_ms") % 1000)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advisor.table_rows(catalog.partitions(spark, sf_dir))


def _keyed(found: DataFrame) -> DataFrame:
    """Key columns as one text, as values are compared across engines."""
    return found.withColumn("key_columns", F.array_join("key_columns", ","))


def _table_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = catalog.indexes(spark, sf_dir).groupBy("table_name").agg(*[F.sum(c).alias(c) for c in ("seeks", "scans", "lookups", "updates")])
    return uses.join(_rows(spark, sf_dir), "table_name")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "capture_span": lambda s, d: vitals.capture_span([views.query_store(s, d), views.index_usage(s, d)]),
        "newest_samples": lambda s, d: vitals.newest_rows(views.query_store(s, d), ["query_id"], "event_id"),
        "signal_wait_pct": lambda s, d: vitals.signal_wait_pct(_waits(s, d)),
        "io_latency_series": lambda s, d: vitals.io_series(io(s, d)),
        "missing_index_history": lambda s, d: vitals.seen_days(history(s, d), "item"),
        "judged_samples": lambda s, d: vitals.judged_samples(views.query_store(s, d)),
        "baseline_summary": lambda s, d: vitals.baseline_summary(telemetry.baselines(views.query_store(s, d))),
        "events_once": lambda s, d: vitals.events_once(s.read.parquet(f"{d}/conversations.parquet").withColumnRenamed("turn", "captured_at"), "text"),
        "alert_breaches": lambda s, d: vitals.breaches(snapshots(s, d), RULES),
        "table_rows": _rows,
        "unused_index_findings": lambda s, d: advisor.unused_findings(catalog.indexes(s, d)),
        "index_heatmap": lambda s, d: advisor.heatmap(catalog.indexes(s, d)),
        "heatmap_order": lambda s, d: advisor.heatmap_order(catalog.indexes(s, d)),
        "unused_existing": lambda s, d: advisor.unused_existing(catalog.indexes(s, d)),
        "index_pairs": lambda s, d: advisor.index_pairs(catalog.indexes(s, d)),
        "missing_index_findings": lambda s, d: _keyed(advisor.missing_index_findings(catalog.missing_indexes(s, d), _rows(s, d))),
        "create_index": lambda s, d: _keyed(advisor.create_index(catalog.missing_indexes(s, d), _rows(s, d))),
        "missing_without_prefixes": lambda s, d: _keyed(advisor.without_prefixes(catalog.missing_indexes(s, d))).withColumn("included_columns", F.array_join("included_columns", ",")),
        "consolidated_indexes": lambda s, d: _keyed(advisor.consolidated(catalog.missing_indexes(s, d))).withColumn("included_columns", F.array_join("included_columns", ",")),
        "advised_indexes": lambda s, d: _keyed(advisor.advised_indexes(catalog.missing_indexes(s, d), _rows(s, d), catalog.indexes(s, d))).withColumn("included_columns", F.array_join("included_columns", ",")),
        "drop_index": lambda s, d: advisor.drop_index(catalog.indexes(s, d)),
        "merge_index": lambda s, d: advisor.merge_index(catalog.indexes(s, d)),
        "columnstore_candidates": lambda s, d: advisor.columnstore_candidates(_table_uses(s, d)),
    }


_EVENTS = "ev as (select *, user_id % 5 as instance_id, cast(json_extract_string(props, '$.k') as bigint) as k from events)"
_READS = "seeks + scans + lookups"
_SMS = "samples as (select query_id, captured_at, event_id, total_duration_ms / executions as ms from query_store where executions > 0)"


#: Each request's way up to the first one that extends it, again and again.
_CONSOLIDATED = """one as (select table_name, key_columns as keys, max(impact) as impact, max(cost) as cost, cast(sum(seeks) as bigint) as seeks, count(*) as requests from missing group by 1, 2),
extras as (select table_name, key_columns as keys, unnest(included_columns) as x from missing),
ups as (select a.table_name, a.keys, min(b.keys) as up from one a join one b on a.table_name = b.table_name and len(b.keys) > len(a.keys) and b.keys[1 : len(a.keys)] = a.keys group by 1, 2),
way as (select table_name, keys, keys as top from one union all select way.table_name, way.keys, ups.up from way join ups on ups.table_name = way.table_name and ups.keys = way.top),
ended as (select * from way where not exists (select 1 from ups where ups.table_name = way.table_name and ups.keys = way.top)),
sums as (select e.table_name, e.top as keys, max(impact) as impact, max(cost) as cost, cast(sum(seeks) as bigint) as seeks, cast(sum(requests) as bigint) as requests from ended e join one on one.table_name = e.table_name and one.keys = e.keys group by 1, 2),
names as (select e.table_name, e.top as keys, list(distinct x order by x) as extra from ended e join extras x on x.table_name = e.table_name and x.keys = e.keys group by 1, 2),
whole as (select sums.*, coalesce(extra, []) as extra, array_to_string(sums.keys, ',') as key_columns, coalesce(array_to_string(extra, ','), '') as included_columns from sums left join names on names.table_name = sums.table_name and names.keys = sums.keys)"""


def oracle_sql(deltas: str) -> dict[str, str]:
    """``deltas``: the text of the views that end in ``deltas``."""
    w, c, r = f"with recursive {views.SQL}", f"with {views.SQL}, {catalog.SQL}", f"with recursive {views.SQL}, {catalog.SQL}"
    snap = "snap as (select instance_id, date_trunc('hour', ts) as captured_at, count(*) filter (where event_type = 'error') as deadlocks, round(avg(value), 4) as latency, count(*) * 100 as life, cast(max(k) as double) as gb from ev group by all)"
    merged = "max(impact) as impact, max(cost) as cost, cast(sum(seeks) as bigint) as seeks"
    return {
        "capture_span": f"{w} select min(a) as first_capture, max(b) as last_capture from (select min(captured_at) as a, max(captured_at) as b from query_store union all select min(captured_at), max(captured_at) from index_usage)",
        "newest_samples": f"{w} select query_id, event_id, plan_id, captured_at, total_duration_ms, executions, query_sql_text from query_store qualify row_number() over (partition by query_id order by captured_at desc, event_id desc) = 1",
        "signal_wait_pct": f"{w}, {deltas} select instance_id, case when sum(delta_ms) > 0 then round(sum(delta_ms % 1000) / sum(delta_ms) * 100, 4) end as signal_pct from deltas d where captured_at = (select max(captured_at) from deltas e where e.instance_id = d.instance_id) group by 1",
        "io_latency_series": f"with {_EVENTS} select instance_id, date_trunc('hour', ts) as captured_at, greatest(max(case when k % 2 = 0 then value end), max(case when k % 3 = 0 then value end)) as worst_ms from ev group by all",
        "missing_index_history": f"with {_EVENTS}, h as (select case when k % 5 <> 0 then event_type || '_' || instance_id end as item, cast(ts as date) as day from ev) select item, count(distinct day) as days_seen, (select count(distinct day) from h) as days_observed from h where item is not null group by 1",
        "judged_samples": f"{w}, {_SMS}, j as (select *, count(ms) over b as n, avg(ms) over b as mean, stddev_samp(ms) over b as sd from samples window b as (partition by query_id order by captured_at, event_id rows between unbounded preceding and 1 preceding)) select query_id, captured_at, event_id, n, round(mean, 4) as mean_ms, round(ms, 4) as ms from j where n >= 6 and sd > 0 and ms - mean >= 3 * sd and ms - mean >= 5",
        "baseline_summary": f"{w}, {_SMS}, b as (select query_id, count(*) as n, avg(ms) as mean, stddev_samp(ms) as sd, arg_max(ms, (captured_at, event_id)) as last_ms from samples group by 1 having count(*) >= 6) select count(*) as queries, round(sum(mean), 2) as mean_ms, round(sum(last_ms), 2) as last_ms, round((sum(last_ms) / sum(mean) - 1) * 100, 2) as delta_pct, round(greatest(max(case when sd > 0 then (last_ms - mean) / sd end), 0), 2) as worst_z from b",
        "events_once": "select substr(sha256(text), 1, 16) as text_hash, count(*) as times, min(turn) as first_seen from conversations where text is not null group by 1",
        "alert_breaches": f"""with {_EVENTS}, {snap}, limits as (select *, greatest(coalesce(gb, 0) / 4 * 300, 300) as floor from snap)
            select instance_id, captured_at, 'errors_in_hour' as rule_id, 'error' as severity, cast(deadlocks as double) as value, cast(1 as double) as threshold from snap where deadlocks > 1
            union all select instance_id, captured_at, 'latency_high', 'warning', latency, cast(100 as double) from snap where latency >= 100
            union all select instance_id, captured_at, 'traffic_low', 'warning', cast(life as double), floor from limits where life < floor""",
        "table_rows": f"{c} select * from table_rows",
        "unused_index_findings": f"{c} select table_name, index_name, 'dmv.unused_index' as rule, 'warning' as severity from indexes where {_READS} = 0 and updates > 100 and not is_primary_key",
        "index_heatmap": f"{c} select table_name, index_name, {_READS} - updates as score from indexes",
        "heatmap_order": f"{c} select table_name, index_name, {_READS} as reads, updates as writes, {_READS} - updates as score from indexes where (select sum({_READS} + updates) from indexes) > 0",
        "unused_existing": f"{c} select table_name, index_name, updates from indexes where {_READS} = 0 and updates > 100 and not is_primary_key and not is_unique and not is_clustered and not starts_with(lower(index_name), 'pk_')",
        "index_pairs": f"{c} select a.table_name, a.index_name as index_a, b.index_name as index_b, 'dmv.duplicate_or_overlapping_index' as rule, case when a.key_columns = b.key_columns and a.included_columns = b.included_columns then 'error' else 'info' end as severity from indexes a join indexes b on a.table_name = b.table_name and a.key_columns[1] = b.key_columns[1] and a.index_name < b.index_name",
        "missing_index_findings": f"{c} select table_name, array_to_string(key_columns, ',') as key_columns, 'dmv.missing_index' as rule, 'info' as severity from missing left join table_rows using (table_name) where rows >= 1000 or rows is null",
        "create_index": f"""{c}, n as (select *, len(key_columns) as nk, 2 * len(key_columns) + len(included_columns) as units from missing left join table_rows using (table_name) where rows >= 1000 or rows is null),
            s as (select table_name, array_to_string(key_columns, ',') as key_columns, round(cost * impact / 100 * greatest(seeks, 1) / case when nk >= 5 or units >= 12 then cast(3 as double) when nk >= 3 or units >= 6 then cast(1.75 as double) else cast(1 as double) end, 6) as score from n)
            select *, case when score >= 10 then 'high' when score >= 1 then 'medium' else 'low' end as priority from s""",
        "missing_without_prefixes": f"""{c}, one as (select table_name, key_columns, {merged} from missing group by 1, 2),
            extra as (select table_name, key_columns, unnest(included_columns) as x from missing),
            whole as (select a.table_name, a.key_columns, b.key_columns as part, b.impact, b.cost, b.seeks from one a join one b on a.table_name = b.table_name and a.key_columns[1 : len(b.key_columns)] = b.key_columns and len(b.key_columns) <= len(a.key_columns)),
            top as (select * from whole where (table_name, key_columns) not in (select (table_name, part) from whole where len(key_columns) > len(part)))
            select table_name, array_to_string(key_columns, ',') as key_columns, {merged}, coalesce((select string_agg(distinct x, ',' order by x) from extra e where e.table_name = top.table_name and top.key_columns[1 : len(e.key_columns)] = e.key_columns), '') as included_columns from top group by top.table_name, top.key_columns""",
        "consolidated_indexes": f"{r}, {_CONSOLIDATED} select table_name, key_columns, included_columns, impact, cost, seeks, requests from whole",
        "advised_indexes": f"""{r}, {_CONSOLIDATED}, there as (select table_name, index_name, key_columns, included_columns from indexes where not is_primary_key and not is_unique and not is_clustered),
            wanted as (select whole.* from whole left join table_rows using (table_name) where rows >= 1000 or rows is null),
            met as (select w.table_name, w.key_columns, bool_or(len(list_filter(w.extra, lambda x: not list_contains(list_concat(t.key_columns, t.included_columns), x))) = 0) as served,
                min(case when t.key_columns = w.keys then index_name end) as old from wanted w join there t on t.table_name = w.table_name and t.key_columns[1 : len(w.keys)] = w.keys group by 1, 2),
            left_ as (select w.*, old, case when old is null then w.extra else list_sort(list_distinct(list_concat(w.extra, t.included_columns))) end as held, substr('IX_' || regexp_replace(w.table_name || '_' || array_to_string(w.keys, '_'), '[^A-Za-z0-9_]', '', 'g'), 1, 120) as base
                from wanted w left join met using (table_name, key_columns) left join there t on t.table_name = w.table_name and t.index_name = met.old where not coalesce(served, false)),
            s as (select *, case when old is not null then old when turn = 1 then base else base || '_' || turn end as index_name, round(cost * impact / 100 * greatest(seeks, 1) / case when len(keys) >= 5 or 2 * len(keys) + len(extra) >= 12 then cast(3 as double) when len(keys) >= 3 or 2 * len(keys) + len(extra) >= 6 then cast(1.75 as double) else cast(1 as double) end, 6) as score
                from (select *, row_number() over (partition by table_name, base, old is null order by keys) as turn from left_))
            select table_name, key_columns, case when len(held) = 0 then '' else array_to_string(held, ',') end as included_columns, case when old is null then 'create' else 'widen' end as kind, index_name, score, case when score >= 10 then 'high' when score >= 1 then 'medium' else 'low' end as priority,
                'CREATE NONCLUSTERED INDEX [' || index_name || '] ON [' || table_name || '] ([' || array_to_string(keys, '], [') || '])' || case when len(held) = 0 then '' else ' INCLUDE ([' || array_to_string(held, '], [') || '])' end || case when old is null then '' else ' WITH (DROP_EXISTING = ON)' end || ';' as ddl from s""",
        "drop_index": f"{c}, spare as (select * from indexes where {_READS} = 0 and not is_primary_key and not is_unique and not is_clustered) select table_name, index_name, case when updates > 100 then 'write_only' else 'never_touched' end as kind, case when updates >= 100000 then 'high' when updates >= 10000 then 'medium' else 'low' end as priority from spare where updates > 100 or updates = 0",
        "merge_index": f"{c} select a.table_name, a.index_name as retire, min(b.index_name) as keep from indexes a join indexes b on a.table_name = b.table_name and len(b.key_columns) > len(a.key_columns) and b.key_columns[1 : len(a.key_columns)] = a.key_columns where not a.is_primary_key and not a.is_unique group by 1, 2",
        "columnstore_candidates": f"{c}, u as (select table_name, cast(sum(seeks) as bigint) as seeks, cast(sum(scans) as bigint) as scans, sum(lookups) as lookups, sum(updates) as updates from indexes group by 1) select table_name, scans, seeks from u join table_rows using (table_name) where (rows >= 1000000 or reserved_kb >= 1048576) and scans > seeks and scans >= 100 and ({_READS} = 0 or updates < 0.2 * ({_READS}))",
    }
