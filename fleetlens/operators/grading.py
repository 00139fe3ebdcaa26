"""Grades findings against scenarios that say what must, may and must not fire.

A spec is a rule, ``family.*`` or either with ``@line``. The line binds only
where a rule must fire. A null list counts as empty. A scenario's lists and
its own findings are small; all scenarios are graded side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = "array<string>"


def _covers(spec: Column, rule: Column) -> Column:
    name = F.split_part(spec, F.lit("@"), F.lit(1))
    stem = F.regexp_replace(name, r"\.\*$", "")
    return F.when(name.endswith(".*"), (rule == stem) | rule.startswith(F.concat(stem, F.lit(".")))).otherwise(rule == name)


def _met(spec: Column, finding: Column) -> Column:
    line = F.split_part(spec, F.lit("@"), F.lit(2)).try_cast("int")
    return _covers(spec, finding["rule"]) & (line.isNull() | F.coalesce(line == finding["line"], F.lit(False)))


def grade(scenarios: DataFrame, fired: DataFrame) -> DataFrame:
    """(scenario_id, tp, fn, forbidden, unexpected, passed) of scenarios (scenario_id, must, also, must_not) and findings (scenario_id, rule, line).

    ``unexpected`` are rules that fired and that no list names.
    """
    by = fired.groupBy("scenario_id").agg(F.collect_set(F.struct("rule", "line")).alias("_fired"))
    t = scenarios.join(by, "scenario_id", "left").withColumn("_fired", F.coalesce("_fired", F.filter(F.array(F.struct(F.lit("").alias("rule"), F.lit(0).alias("line"))), lambda _: F.lit(False))))
    must, also, never = (F.coalesce(c, F.array().cast(_NONE)) for c in ("must", "also", "must_not"))
    rules = F.array_distinct(F.transform("_fired", lambda f: f["rule"]))
    met = lambda s: F.exists("_fired", lambda f: _met(s, f))
    name = lambda specs: F.transform(specs, lambda s: F.split_part(s, F.lit("@"), F.lit(1)))
    named = lambda specs, r: F.exists(specs, lambda s: _covers(s, r))
    t = t.select(
        "scenario_id",
        name(F.filter(must, met)).alias("tp"),
        name(F.filter(must, lambda s: ~met(s))).alias("fn"),
        name(F.filter(never, lambda s: F.exists("_fired", lambda f: _covers(s, f["rule"])))).alias("forbidden"),
        F.sort_array(F.filter(rules, lambda r: ~named(F.concat(must, also, never), r))).alias("unexpected"),
    )
    return t.withColumn("passed", (F.size("fn") == 0) & (F.size("forbidden") == 0) & (F.size("unexpected") == 0))


def by_rule(graded: DataFrame) -> DataFrame:
    """(rule, tp, fp, fn): an unexpected or forbidden rule counts as false positive."""
    said = lambda column, kind: F.transform(column, lambda r: F.struct(r.alias("rule"), F.lit(kind).alias("kind")))
    each = graded.select(F.explode(F.concat(said("tp", "tp"), said("fn", "fn"), said("forbidden", "fp"), said("unexpected", "fp"))).alias("x"))
    return each.groupBy("x.rule").agg(*[F.count_if(F.col("x.kind") == k).alias(k) for k in ("tp", "fp", "fn")])


def scores(counts: DataFrame) -> DataFrame:
    """One row (precision, recall, f1) of counts by rule; with nothing to count, precision and recall are 1."""
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    share = lambda other: F.when(F.col("tp") + F.col(other) == 0, 1.0).otherwise(F.try_divide("tp", F.col("tp") + F.col(other)))
    t = total.select(share("fp").alias("precision"), share("fn").alias("recall"))
    both = F.col("precision") + F.col("recall")
    return t.withColumn("f1", F.when(both == 0, 0.0).otherwise(F.try_divide(2 * F.col("precision") * F.col("recall"), both)))


def gate(graded: DataFrame, least: float = 0.95) -> DataFrame:
    """One row (open, n_failed, f1): whether all scenarios passed and f1 is ``least`` or more."""
    failed = graded.agg(F.count_if(~F.col("passed")).alias("n_failed"))
    # Both sides are one row each.
    return failed.join(F.broadcast(scores(by_rule(graded)).select("f1")), F.lit(True)).select(((F.col("n_failed") == 0) & (F.col("f1") >= least)).alias("open"), "n_failed", "f1")
