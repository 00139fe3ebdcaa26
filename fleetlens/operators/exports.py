"""Findings as JSON, SARIF 2.1.0 and lines for people: rows of text, a file's findings in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators import reports, texts

SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def json_lines(findings: DataFrame) -> DataFrame:
    """(path, json): a row for each file with its findings (path, rule, severity, line, col, start) in order; nulls are left out of an object."""
    told = texts.explained(findings)
    one = F.struct("severity", "rule", "line", "col", "message", "recommendation")
    order = F.struct(_rank().alias("rank"), F.coalesce("line", F.lit(0)).alias("l"), F.coalesce("col", F.lit(0)).alias("c"), F.col("rule").alias("r"))
    by = told.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), one.alias("finding")))).alias("found"))
    return by.select("path", F.to_json(F.struct("path", F.transform("found", lambda x: x["finding"]).alias("findings"))).alias("json"))


def _rank():
    return reports.rank(F.col("severity"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(path, rule, result): each finding as the JSON of a SARIF result."""
    told = texts.explained(findings)
    level = reports.sarif_level(F.col("severity"))
    region = F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine"), F.greatest(F.coalesce("col", F.lit(1)), F.lit(1)).alias("startColumn"))
    where = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.concat_ws(" ", "message", "recommendation").alias("text")).alias("message"), where.alias("locations"))
    return told.select("path", "rule", F.to_json(result).alias("result"))


def sarif(findings: DataFrame, tool: str = "fleetlens") -> DataFrame:
    """One row (sarif), the document of all findings with the rules they name; meant for one repository's findings."""
    results = sarif_results(findings)
    rules = results.select("rule").distinct().select(F.to_json(F.struct(F.col("rule").alias("id"))).alias("rule_json")).agg(F.array_join(F.array_sort(F.collect_list("rule_json")), ",").alias("rules"))
    found = results.agg(F.array_join(F.array_sort(F.collect_list("result")), ",").alias("results"))
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}","rules":['
    return found.join(F.broadcast(rules), F.lit(True)).select(F.concat(F.lit(head), F.coalesce("rules", F.lit("")), F.lit(']}},"results":['), F.coalesce("results", F.lit("")), F.lit("]}]}")).alias("sarif"))  # both sides are one row


def lines(findings: DataFrame, per_rule: int | None = 3) -> DataFrame:
    """(path, place, text): a line a finding as people read it, at most ``per_rule`` of a rule and file, worst first."""
    told = texts.explained(findings)
    if per_rule is not None:
        nth = F.row_number().over(Window.partitionBy("path", "rule").orderBy("line", "col"))
        told = told.withColumn("nth", nth).where(F.col("nth") <= per_rule)
    place = F.row_number().over(Window.partitionBy("path").orderBy(_rank(), "line", "col", "rule"))
    text = F.format_string("%s:%d:%d  %s  %s  %s", "path", F.coalesce("line", F.lit(1)), F.coalesce("col", F.lit(1)), F.upper("severity"), "rule", "message")
    return told.select("path", place.alias("place"), text.alias("text"))


def exit_code(findings: DataFrame, fail_on: str = "error") -> DataFrame:
    """One row (exit_code): 1 if a finding is as bad as ``fail_on`` or worse, else 0."""
    limit = {"critical": 0, "error": 1, "warning": 2, "info": 3}[fail_on]
    return findings.agg(F.coalesce(F.max((_rank() <= limit).cast("int")), F.lit(0)).alias("exit_code"))
