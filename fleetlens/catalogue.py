"""Queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import advice, fleet_queries, reporting, scenarios, store_queries
from fleetlens.functions import tsql
from fleetlens.operators import rules, telemetry
from fleetlens.plans import queries as plans
from fleetlens.sources import views

TOP, POINTS = 20, 12
#: Background waits of the stand-in data.
IGNORABLE = ["view"]


def _breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value >= 120")
    return events.select((F.col("user_id") % 5).alias("instance_id"), F.col("event_type").alias("rule_id"), F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("at"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts made from supplier rows: (doc_id, sql)."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    parts = [F.lit("SELECT * FROM dbo."), F.regexp_replace("s_name", "[^A-Za-z0-9]", "_"), F.lit(" WITH (NOLOCK) WHERE name LIKE '%"), F.col("s_nationkey").cast("string"), F.lit("' -- note\nGO\nDELETE FROM [order lines]\nSELECT TOP 5 a FROM t /* x /* y */ */ WHERE b NOT IN (SELECT c FROM d)\n")]
    return s.select(F.col("s_suppkey").alias("doc_id"), F.concat(*parts).alias("sql"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "top_queries_by_duration": lambda s, d: telemetry.top_queries(views.query_store(s, d), TOP),
        "top_queries_by_recency": lambda s, d: telemetry.top_queries(views.query_store(s, d), TOP, "recency"),
        "unused_indexes": lambda s, d: telemetry.unused_indexes(views.index_usage(s, d)),
        "index_usage_history": lambda s, d: telemetry.index_history(views.index_usage(s, d)),
        "counter_delta": lambda s, d: telemetry.counter_deltas(views.counters(s, d)),
        "pain_top_wait": lambda s, d: telemetry.top_wait(telemetry.counter_deltas(views.counters(s, d)), IGNORABLE),
        "regressions_in_window": lambda s, d: telemetry.regressions(views.query_store(s, d)),
        "welford_baseline": lambda s, d: telemetry.baselines(views.query_store(s, d)),
        "vital_series_newest_n": lambda s, d: telemetry.newest_points(views.query_store(s, d), POINTS),
        "alert_cooldown": lambda s, d: telemetry.fired_alerts(_breaches(s, d)),
        "script_tokens": lambda s, d: tsql.tokens(corpus(s, d)),
        "script_findings": lambda s, d: rules.findings_of(corpus(s, d)),
        "rule_grades": scenarios.graded,
        "rule_firings": scenarios.firings,
    } | advice.queries() | fleet_queries.queries() | reporting.queries() | plans.queries() | store_queries.queries()


_DELTAS = """
ticks as (select instance_id, captured_at, lag(captured_at) over (partition by instance_id order by captured_at) as before from (select distinct instance_id, captured_at from counters)),
pairs as (select c.instance_id, c.wait_type, c.captured_at, c.total_ms, p.total_ms as prior_ms from counters c
    join ticks t on c.instance_id = t.instance_id and c.captured_at = t.captured_at and t.captured_at - t.before <= interval 1 hour
    left join counters p on p.instance_id = c.instance_id and p.wait_type = c.wait_type and p.captured_at = t.before),
deltas as (select instance_id, wait_type, captured_at, total_ms - coalesce(prior_ms, 0) as delta_ms from pairs
    where (instance_id, captured_at) not in (select (instance_id, captured_at) from pairs where total_ms < prior_ms) and total_ms - coalesce(prior_ms, 0) > 0)
"""
_SAMPLES = "samples as (select query_id, captured_at, event_id, executions, total_duration_ms / executions as ms, row_number() over (partition by query_id order by captured_at desc, event_id desc) as age from query_store where executions > 0)"
_TOP = "select query_id, plan_id, round(sum(total_duration_ms), 4) as duration_ms, cast(sum(executions) as bigint) as executions, max(query_sql_text) as text, max(captured_at) as last_seen from query_store group by 1, 2"


#: The scripts of ``corpus`` by hand: idx, kind, text (null: the table's name), start, end, whether the name and the nation stand before start and before end, line, where the line starts.
_TOKENS = """tokens(idx, kind, text, s, e, ls, le, ms, me, line, base) as (values
    (0, 'Word', 'SELECT', 0, 6, 0, 0, 0, 0, 1, 0), (1, 'Punct', '*', 7, 8, 0, 0, 0, 0, 1, 0), (2, 'Word', 'FROM', 9, 13, 0, 0, 0, 0, 1, 0), (3, 'Word', 'dbo', 14, 17, 0, 0, 0, 0, 1, 0), (4, 'Punct', '.', 17, 18, 0, 0, 0, 0, 1, 0), (5, 'Word', null, 18, 18, 0, 1, 0, 0, 1, 0),
    (6, 'Word', 'WITH', 19, 23, 1, 1, 0, 0, 1, 0), (7, 'Punct', '(', 24, 25, 1, 1, 0, 0, 1, 0), (8, 'Word', 'NOLOCK', 25, 31, 1, 1, 0, 0, 1, 0), (9, 'Punct', ')', 31, 32, 1, 1, 0, 0, 1, 0), (10, 'Word', 'WHERE', 33, 38, 1, 1, 0, 0, 1, 0), (11, 'Word', 'name', 39, 43, 1, 1, 0, 0, 1, 0),
    (12, 'Word', 'LIKE', 44, 48, 1, 1, 0, 0, 1, 0), (13, 'String', null, 49, 52, 1, 1, 0, 1, 1, 0), (14, 'Comment', '-- note', 53, 60, 1, 1, 1, 1, 1, 0), (15, 'Word', 'GO', 61, 63, 1, 1, 1, 1, 2, 61), (16, 'Word', 'DELETE', 64, 70, 1, 1, 1, 1, 3, 64), (17, 'Word', 'FROM', 71, 75, 1, 1, 1, 1, 3, 64),
    (18, 'Word', '[order lines]', 76, 89, 1, 1, 1, 1, 3, 64), (19, 'Word', 'SELECT', 90, 96, 1, 1, 1, 1, 4, 90), (20, 'Word', 'TOP', 97, 100, 1, 1, 1, 1, 4, 90), (21, 'Number', '5', 101, 102, 1, 1, 1, 1, 4, 90), (22, 'Word', 'a', 103, 104, 1, 1, 1, 1, 4, 90), (23, 'Word', 'FROM', 105, 109, 1, 1, 1, 1, 4, 90),
    (24, 'Word', 't', 110, 111, 1, 1, 1, 1, 4, 90), (25, 'Comment', '/* x /* y */ */', 112, 127, 1, 1, 1, 1, 4, 90), (26, 'Word', 'WHERE', 128, 133, 1, 1, 1, 1, 4, 90), (27, 'Word', 'b', 134, 135, 1, 1, 1, 1, 4, 90), (28, 'Word', 'NOT', 136, 139, 1, 1, 1, 1, 4, 90), (29, 'Word', 'IN', 140, 142, 1, 1, 1, 1, 4, 90),
    (30, 'Punct', '(', 143, 144, 1, 1, 1, 1, 4, 90), (31, 'Word', 'SELECT', 144, 150, 1, 1, 1, 1, 4, 90), (32, 'Word', 'c', 151, 152, 1, 1, 1, 1, 4, 90), (33, 'Word', 'FROM', 153, 157, 1, 1, 1, 1, 4, 90), (34, 'Word', 'd', 158, 159, 1, 1, 1, 1, 4, 90), (35, 'Punct', ')', 159, 160, 1, 1, 1, 1, 4, 90)),
names as (select s_suppkey as doc_id, regexp_replace(s_name, '[^A-Za-z0-9]', '_', 'g') as name, cast(s_nationkey as varchar) as nation from supplier),
placed as (select doc_id, idx, kind, case when idx = 5 then name when idx = 13 then '''%' || nation || '''' else text end as text, s + ls * length(name) + ms * length(nation) as start, e + le * length(name) + me * length(nation) as "end", line,
    s + ls * length(name) + ms * length(nation) - base - case when line > 1 then length(name) + length(nation) else 0 end + 1 as col from names, tokens)"""


def oracle_sql() -> dict[str, str]:
    w = f"with recursive {views.SQL}"
    return {
        "top_queries_by_duration": f"{w} {_TOP} order by duration_ms desc nulls last, query_id, plan_id limit {TOP}",
        "top_queries_by_recency": f"{w} {_TOP} order by last_seen desc nulls last, query_id, plan_id limit {TOP}",
        "unused_indexes": f"{w} select table_id, index_id, cast(sum(updates) as bigint) as updates from index_usage group by 1, 2 having sum(seeks) = 0 and sum(scans) = 0 and sum(lookups) = 0 and sum(updates) > 100 order by updates desc, table_id, index_id limit 50",
        "index_usage_history": f"{w} select table_id, index_id, count(distinct case when seeks + scans + lookups > 0 then cast(captured_at as date) end) as days_with_reads, count(distinct case when updates > 0 then cast(captured_at as date) end) as days_with_writes from index_usage group by 1, 2",
        "counter_delta": f"{w}, {_DELTAS} select * from deltas",
        "pain_top_wait": f"{w}, {_DELTAS} select wait_type, cast(sum(delta_ms) as bigint) as total_ms from deltas where wait_type <> 'view' group by 1 order by 2 desc, 1 limit 1",
        "regressions_in_window": f"""{w}, {_SAMPLES}, base as (select query_id, avg(ms) filter (where age > 1) as mean, stddev_samp(ms) filter (where age > 1) as sd, max(ms) filter (where age = 1) as ms, count(*) as n, sum(executions) as executions from samples group by 1)
            select query_id, cast(round(mean) as bigint) as baseline_ms, cast(round(ms) as bigint) as current_ms, round(case when mean > 0 then (ms / mean - 1) * 100 else 0 end, 4) as delta_pct from base
            where n >= 6 and executions >= 10 and sd > 0 and ms - mean >= 3 * sd and ms - mean >= 5 order by current_ms - baseline_ms desc, query_id limit 50""",
        "welford_baseline": f"{w}, {_SAMPLES} select query_id, count(*) as n, round(avg(ms), 6) as mean, round(var_pop(ms) * count(*), 4) as m2, round(max(ms) filter (where age = 1), 6) as last_ms from samples group by 1",
        "vital_series_newest_n": f"{w} select query_id, {POINTS} + 1 - age as place, captured_at, total_duration_ms from (select *, row_number() over (partition by query_id order by captured_at desc, event_id desc) as age from query_store) where age <= {POINTS}",
        "script_tokens": f"with {_TOKENS} select doc_id, idx, kind, text, start, \"end\", line, col from placed",
        "script_findings": f"""with {_TOKENS} select doc_id, rule, severity, line, col, start from placed join (values (1, 'hygiene.select_star', 'warning'), (8, 'hygiene.nolock', 'error'), (13, 'sarg.leading_wildcard', 'warning'), (16, 'hygiene.unbounded_dml', 'critical'), (18, 'modern.missing_schema_prefix', 'info'),
            (20, 'hygiene.top_without_order_by', 'warning'), (24, 'modern.missing_schema_prefix', 'info'), (29, 'sarg.not_in_nullable', 'warning'), (34, 'modern.missing_schema_prefix', 'info')) f(idx, rule, severity) using (idx)""",
        "rule_grades": scenarios.SQL,
        "rule_firings": scenarios.FIRINGS_SQL,
        "alert_cooldown": """with recursive b as (select distinct user_id % 5 as instance_id, event_type as rule_id, epoch_us(ts) // 1000000 as secs from events where value >= 120),
            fired as (select instance_id, rule_id, min(secs) as fired_at from b group by 1, 2 union all select instance_id, rule_id, fired_at from (select f.instance_id, f.rule_id, (select min(b.secs) from b where b.rule_id = f.rule_id and b.instance_id = f.instance_id and b.secs >= f.fired_at + 900) as fired_at from fired f) where fired_at is not null)
            select instance_id, rule_id, fired_at from fired""",
    } | advice.oracle_sql(_DELTAS) | fleet_queries.oracle_sql(_DELTAS) | reporting.oracle_sql() | plans.oracle_sql() | store_queries.oracle_sql()
