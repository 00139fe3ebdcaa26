"""What becomes of findings: order, suppression, caps, thresholds, levels, timelines and groups.

Findings have (doc_id, rule, severity, line, col, start); a null or unknown
severity ranks last. An empty table of findings gives an empty result, but for
the timeline, which has a row for every line of every script.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities from the gravest on.
SEVERITIES = ("critical", "error", "warning", "info")


def rank(severity: Column) -> Column:
    """0 for critical to 3 for info, 4 for any other."""
    ranked = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        ranked = F.when(severity == s, i).otherwise(ranked)
    return ranked


def report_order(findings: DataFrame, emitted: str = "rule") -> DataFrame:
    """Each script's findings with ``place`` by severity and offset (none: 0); ``emitted`` settles ties."""
    by = Window.partitionBy("doc_id").orderBy(rank(F.col("severity")), F.coalesce("start", F.lit(0)), emitted, "line", "col")
    return findings.withColumn("place", F.row_number().over(by))


def lint_order(findings: DataFrame) -> list[Column]:
    """Sort keys of a listing over all scripts."""
    return [F.col("doc_id"), rank(F.col("severity")), F.col("line"), F.col("col"), F.col("rule")]


def matches(spec: Column, rule: Column) -> Column:
    """Whether a suppression names a rule: ``*`` or ``all``, a family, ``family.*`` or the rule itself, in any case."""
    s, r = F.lower(F.trim(spec)), F.lower(rule)
    stem = F.when(s.endswith(".*"), F.expr("null")).otherwise(s)
    prefix = F.regexp_replace(s, r"\.\*$", "")
    family = s.endswith(".*") & ((r == prefix) | r.startswith(F.concat(prefix, F.lit("."))))
    bare = ~s.contains(".") & r.startswith(F.concat(stem, F.lit(".")))
    return F.coalesce((s != "") & (s.isin("*", "all") | family | (s == r) | bare), F.lit(False))


def directives(tokens: DataFrame, marker: str = "lint-ignore") -> DataFrame:
    """(doc_id, line, spec) of ``marker``, ``marker-next-line`` and ``marker-file`` in comments; a null line is the whole script.

    After the marker come rules, apart by commas or blanks; none means all. In
    a comment of several lines, the next line is the one after it closes.
    """
    lines = tokens.where("kind = 'Comment'").select("doc_id", F.col("line").alias("first"), F.regexp_count("text", F.lit("\n")).alias("breaks"), F.posexplode(F.split("text", "\r?\n")).alias("offset", "said"))
    parts = lines.select("doc_id", "first", "breaks", "offset", F.regexp_extract("said", rf"(?i){marker}(-file|-next-line)?(?![\w-])(?:\s*[:=])?([^\n]*)", 0).alias("whole"), F.lower(F.regexp_extract("said", rf"(?i){marker}(-file|-next-line)?(?![\w-])", 1)).alias("form"), F.regexp_extract("said", rf"(?i){marker}(?:-file|-next-line)?(?![\w-])(?:\s*[:=])?([^\n]*)", 1).alias("rest")).where("whole != ''")
    at = F.when(F.col("form") == "-file", F.lit(None)).when(F.col("form") == "-next-line", F.col("first") + F.col("breaks") + 1).otherwise(F.col("first") + F.col("offset"))
    named = F.filter(F.split(F.regexp_replace("rest", r"\*/\s*$", ""), "[, \t]+"), lambda s: s != "")
    return parts.select("doc_id", at.cast("int").alias("line"), F.explode(F.when(F.size(named) == 0, F.array(F.lit("*"))).otherwise(named)).alias("spec"))


def suppress(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings with ``suppressed``: whether a directive of their script or line names their rule.

    Directives are gathered by script and line first, so that the join adds no rows.
    """
    by = suppressions.groupBy("doc_id", F.col("line").alias("_line")).agg(F.collect_set("spec").alias("_specs"))
    script = by.where("_line is null").select("doc_id", F.col("_specs").alias("_script"))
    here = by.where("_line is not null").select("doc_id", F.col("_line").alias("line"), F.col("_specs").alias("_here"))
    none = F.array().cast("array<string>")
    both = findings.join(script, "doc_id", "left").join(here, ["doc_id", "line"], "left").withColumn("_specs", F.concat(F.coalesce("_script", none), F.coalesce("_here", none)))
    return both.withColumn("suppressed", F.exists("_specs", lambda s: matches(s, F.col("rule")))).select(*findings.columns, "suppressed")


def ignore(findings: DataFrame, specs: Sequence[str]) -> DataFrame:
    """Findings that none of ``specs`` names."""
    hit = F.lit(False)
    for s in specs:
        hit |= matches(F.lit(s), F.col("rule"))
    return findings.where(~hit)


def cap_per_rule(findings: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` findings of each rule in a script, and how many ``more`` there are."""
    by = Window.partitionBy("doc_id", "rule")
    placed = findings.withColumn("_place", F.row_number().over(by.orderBy(rank(F.col("severity")), "line", "col", F.coalesce("start", F.lit(0))))).withColumn("more", F.greatest(F.count("*").over(by) - most, F.lit(0)))
    return placed.where(F.col("_place") <= most).drop("_place")


def failing(findings: DataFrame, threshold: str = "error") -> DataFrame:
    """(doc_id, failed, n_findings): scripts that hold a finding as grave as ``threshold``."""
    limit = SEVERITIES.index(threshold)
    return findings.groupBy("doc_id").agg(F.bool_or(rank(F.col("severity")) <= limit).alias("failed"), F.count("*").alias("n_findings"))


def sarif_level(severity: Column) -> Column:
    """The exchange format's level."""
    return F.when(severity.isin("error", "critical"), "error").when(severity == "warning", "warning").otherwise("note")


def timeline(scripts: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, line, critical, error, warning, info) of every line of ``scripts`` (doc_id, n_lines), zeros kept.

    A finding without a line counts for line 1; one beyond the script for none.
    A script of no lines has one.
    """
    counts = findings.groupBy("doc_id", F.coalesce("line", F.lit(1)).cast("long").alias("line")).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    lines = scripts.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.coalesce("n_lines", F.lit(1)), F.lit(1)).cast("long"))).alias("line"))
    return lines.join(counts, ["doc_id", "line"], "left").na.fill(0, list(SEVERITIES))


def rule_groups(findings: DataFrame) -> DataFrame:
    """(rule, severity, n, place): rules by gravest severity, then count, then name."""
    by = findings.groupBy("rule").agg(F.min(rank(F.col("severity"))).alias("_rank"), F.count("*").alias("n"))
    worst = F.when(F.col("_rank") < len(SEVERITIES), F.element_at(F.array(*map(F.lit, SEVERITIES)), F.least(F.col("_rank"), F.lit(len(SEVERITIES) - 1)) + 1))
    # One row for each rule is left here, which are few, so that one window over all of them is small.
    return by.withColumn("severity", worst).withColumn("place", F.row_number().over(Window.orderBy("_rank", F.col("n").desc(), "rule"))).select("rule", "severity", "n", "place")


def object_summary(findings: DataFrame, top: int = 5) -> DataFrame:
    """A script's counts by severity and its ``top`` rules by count, as ``rule=n`` joined by commas."""
    by_rule = findings.groupBy("doc_id", "rule").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count("*").alias("n"))
    placed = by_rule.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "rule")))
    named = F.sort_array(F.collect_list(F.when(F.col("place") <= top, F.struct("place", F.concat_ws("=", "rule", F.col("n").cast("string")).alias("said")))))
    return placed.groupBy("doc_id").agg(*[F.sum(s).alias(s) for s in SEVERITIES], F.array_join(F.transform(named, lambda x: x["said"]), ",").alias("top_rules"))


def incidence(findings: DataFrame) -> DataFrame:
    """(rule, n, n_objects): how often a rule fires and in how many scripts."""
    return findings.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_objects"))
