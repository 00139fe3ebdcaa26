"""Queries of reports over stand-in findings, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import reports

MOST, TOP = 2, 3
IGNORED = ["VIEW", "click.*", "purchase.r1"]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings projected from events: a user's events are those of a script of 30 lines."""
    k = F.get_json_object("props", "$.k").cast("long")
    severity = F.element_at(F.array(*map(F.lit, reports.SEVERITIES)), (F.floor(k / 4) % 4 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("doc_id"), F.concat("event_type", F.lit(".r"), (k % 3).cast("string")).alias("rule"), severity.alias("severity"), F.when(k % 7 > 0, (1 + k % 40).cast("int")).alias("line"), F.lit(1).alias("col"), F.col("event_id").alias("start"))


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.lit(30).alias("n_lines"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "report_order": lambda s, d: reports.report_order(findings(s, d)).select("doc_id", "start", "place"),
        "ignored_findings": lambda s, d: reports.ignore(findings(s, d), IGNORED),
        "capped_findings": lambda s, d: reports.cap_per_rule(findings(s, d), MOST).select("doc_id", "rule", "start", "more"),
        "failing_scripts": lambda s, d: reports.failing(findings(s, d)),
        "sarif_levels": lambda s, d: findings(s, d).groupBy(reports.sarif_level(F.col("severity")).alias("level")).agg(F.count("*").alias("n")),
        "severity_timeline": lambda s, d: reports.timeline(_scripts(s, d), findings(s, d)),
        "rule_groups": lambda s, d: reports.rule_groups(findings(s, d)),
        "object_summary": lambda s, d: reports.object_summary(findings(s, d), TOP),
        "rule_incidence": lambda s, d: reports.incidence(findings(s, d)),
    }


_VIEW = """with e as (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events),
findings as (select user_id as doc_id, event_type || '.r' || (k % 3) as rule, ['critical', 'error', 'warning', 'info'][k // 4 % 4 + 1] as severity, k // 4 % 4 as rank,
    case when k % 7 > 0 then cast(1 + k % 40 as int) end as line, 1 as col, event_id as start from e)"""
_COUNTS = ", ".join(f"cast(count(*) filter (where severity = '{s}') as bigint) as {s}" for s in reports.SEVERITIES)


def oracle_sql() -> dict[str, str]:
    return {
        "report_order": f"{_VIEW} select doc_id, start, row_number() over (partition by doc_id order by rank, start, rule, line nulls first) as place from findings",
        "ignored_findings": f"{_VIEW} select doc_id, rule, severity, line, col, start from findings where split_part(rule, '.', 1) not in ('view', 'click') and rule <> 'purchase.r1'",
        "capped_findings": f"{_VIEW} select doc_id, rule, start, greatest(n - {MOST}, 0) as more from (select *, count(*) over (partition by doc_id, rule) as n, row_number() over (partition by doc_id, rule order by rank, line nulls first, col, start) as place from findings) where place <= {MOST}",
        "failing_scripts": f"{_VIEW} select doc_id, min(rank) <= 1 as failed, count(*) as n_findings from findings group by 1",
        "sarif_levels": f"{_VIEW} select case when rank < 2 then 'error' when rank = 2 then 'warning' else 'note' end as level, count(*) as n from findings group by 1",
        "severity_timeline": f"{_VIEW}, counts as (select doc_id, coalesce(line, 1) as line, {_COUNTS} from findings group by 1, 2), lines as (select c_custkey as doc_id, unnest(range(1, 31)) as line from customer) select l.doc_id, l.line, {', '.join(f'coalesce({s}, 0) as {s}' for s in reports.SEVERITIES)} from lines l left join counts c on c.doc_id = l.doc_id and c.line = l.line",
        "rule_groups": f"{_VIEW} select rule, ['critical', 'error', 'warning', 'info'][worst + 1] as severity, n, row_number() over (order by worst, n desc, rule) as place from (select rule, min(rank) as worst, count(*) as n from findings group by 1)",
        "object_summary": f"{_VIEW}, by_rule as (select doc_id, rule, count(*) as n, row_number() over (partition by doc_id order by count(*) desc, rule) as place from findings group by 1, 2), tops as (select doc_id, string_agg(rule || '=' || n, ',' order by place) as top_rules from by_rule where place <= {TOP} group by 1) select f.doc_id, {_COUNTS}, any_value(top_rules) as top_rules from findings f join tops t on t.doc_id = f.doc_id group by 1",
        "rule_incidence": f"{_VIEW} select rule, count(*) as n, count(distinct doc_id) as n_objects from findings group by 1",
    }
