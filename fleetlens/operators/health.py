"""Issues of an instance: one schema, one row an issue, ranks and scores by lane.

An issue is (instance_id, issue_id, source, rule, severity, table_name, impact).
Severities that aren't known count as info, lanes as reliability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of a severity, its base impact, most points a lane can lose, grades.
POINTS = {"critical": 25, "error": 12, "warning": 4, "info": 1}
BASE_IMPACT = {"critical": 9000, "error": 7000, "warning": 4000, "info": 1000}
LANE_CAPS = {"reliability": 80, "opportunity": 60, "operational": 80}
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]
SOURCES = {"advisor": 0, "monitor": 1}
MATURE_SECONDS = 6 * 3600


def _of(c: Column, values: dict[str, int], other: int) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.coalesce(c, F.lit(""))), F.lit(other))


def severity_rank(severity: Column) -> Column:
    return _of(severity, {s: i for i, s in enumerate(POINTS)}, len(POINTS) - 1)


def lane(rule: Column, severity: Column) -> Column:
    return F.when(rule.startswith("structure."), "opportunity").when(severity.isin("critical", "error"), "reliability").otherwise("opportunity")


def impact(severity: Column, rows: Column, kilobytes: Column) -> Column:
    """Base of the severity and up to 999 for the table's size, by rows or megabytes; unknown sizes add nothing."""
    mb = F.greatest(F.floor(kilobytes / 1024), F.lit(1))
    share = F.greatest(F.when(rows > 0, F.log10(rows) / 9), F.when(kilobytes > 0, F.log10(mb) / 6), F.lit(0.0))
    return _of(severity, BASE_IMPACT, 1000) + F.round(999 * F.least(share, F.lit(1.0))).cast("int")


def one_an_issue(issues: DataFrame) -> DataFrame:
    """One row an instance and issue: the advisor's before the monitor's before others', then the greatest impact, then by rule and table."""
    best = F.min_by(F.struct("source", "rule", "severity", "table_name", "impact"), F.struct(_of(F.col("source"), SOURCES, 2), -F.col("impact"), "rule", "table_name"))
    return issues.groupBy("instance_id", "issue_id").agg(best.alias("best")).select("instance_id", "issue_id", "best.*")


def action_plan(issues: DataFrame, n: int = 6) -> DataFrame:
    """The first n issues of each instance that are more than info, with their place."""
    order = Window.partitionBy("instance_id").orderBy(severity_rank(F.col("severity")), F.desc("impact"), "issue_id")
    return issues.where(F.col("severity") != "info").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def grade(score: Column) -> Column:
    found = F.lit("F")
    for least, name in reversed(GRADES):
        found = F.when(score >= least, name).otherwise(found)
    return found


def lane_scores(instances: DataFrame, issues: DataFrame) -> DataFrame:
    """A row for each of ``instances`` (instance_id, monitored_seconds, counter_seconds, signals): three scores, the worst and its grade, and whether it is provisional.

    Without issues and signals the scores are 98 after six hours of history, else
    a provisional 95. Young counters make any score provisional. Null history is
    none, a null counter age isn't young, null signals are none.
    """
    known = F.when(F.col("lane").isin("opportunity", "operational"), F.col("lane")).otherwise("reliability")
    lost = issues.select("instance_id", known.alias("lane"), _of(F.col("severity"), POINTS, 1).alias("points"))
    by = lost.groupBy("instance_id").agg(*[F.sum(F.when(F.col("lane") == x, F.col("points"))).alias(x) for x in LANE_CAPS])
    all_ = instances.join(by, "instance_id", "left")
    silent = F.coalesce(*LANE_CAPS).isNull() & (F.coalesce("signals", F.lit(0)) == 0)
    mature = F.coalesce("monitored_seconds", F.lit(0)) >= MATURE_SECONDS
    score = lambda x: F.when(silent & mature, 98).when(silent, 95).otherwise(100 - F.least(F.coalesce(x, F.lit(0)), F.lit(LANE_CAPS[x]))).cast("int").alias(f"{x}_score")
    young = F.coalesce(F.col("counter_seconds") < MATURE_SECONDS, F.lit(False))
    scored = all_.select("instance_id", *[score(x) for x in LANE_CAPS], ((silent & ~mature) | young).alias("learning"))
    headline = F.least(*[f"{x}_score" for x in LANE_CAPS])
    return scored.select("*", headline.alias("score"), grade(headline).alias("grade"))
