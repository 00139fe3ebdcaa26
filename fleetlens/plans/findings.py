"""Findings and self-costs of plan operators, as filters over their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that count as many, as a big sort, executions as many, and the skew and memory limits (KB).
HIGH_ROWS, BIG, MANY_EXECUTIONS, SKEW_ROWS, SKEW = 10_000, 100_000, 1_000, 1_000, 100
GRANT_KB, GRANT_EXCESS, LARGE_KB, HUGE_KB = 10 * 1024, 4, 100 * 1024, 1024 * 1024
#: Warnings with a rule of their own.
WARNINGS = {
    "PlanAffectingConvert": ("plan.implicit_conversion", "error"),
    "NoJoinPredicate": ("plan.missing_join_predicate", "error"),
    "SpillToTempDb": ("plan.spill", "warning"),
    "SortSpillDetails": ("plan.spill", "warning"),
    "HashSpillDetails": ("plan.spill", "warning"),
    "MemoryGrantWarning": ("plan.memory_grant_warning", "warning"),
    "ColumnsWithNoStatistics": ("plan.missing_statistics", "warning"),
}


def treemap(operators: DataFrame) -> DataFrame:
    """(plan_id, seq, parent_seq, name, value): an operator's own share of the cost, 0.0001 at least."""
    name = F.concat(F.coalesce("physical_op", F.lit("")), F.lit(" ("), F.col("node_id").cast("string"), F.lit(")"))
    return operators.where("seq is not null").select("plan_id", "seq", "parent_seq", name.alias("name"), F.col("self_cost").alias("value"))


def _bracketed(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda c: F.concat(F.lit("["), F.replace(c, F.lit("]"), F.lit("]]")), F.lit("]"))), ", ")


def _index_name(*parts: Column) -> Column:
    return F.concat(F.lit("[IX_"), F.regexp_replace(F.concat_ws("_", *parts), "[^A-Za-z0-9_]", "_"), F.lit("]"))


def _index_ddl(name: Column, schema: Column, table: Column, keys: Column, included: Column, rebuilt: bool = False) -> Column:
    """The statement that makes an index; an object without a schema is dbo's."""
    extra = F.when(F.size(included) > 0, F.concat(F.lit(" INCLUDE ("), _bracketed(included), F.lit(")"))).otherwise("")
    where = F.concat(F.lit("["), F.coalesce(schema, F.lit("dbo")), F.lit("].["), table, F.lit("]"))
    return F.concat(F.lit("CREATE NONCLUSTERED INDEX "), name, F.lit(" ON "), where, F.lit(" ("), _bracketed(keys), F.lit(")"), extra, F.lit(" WITH (DROP_EXISTING = ON);" if rebuilt else ";"))


def _missing_ddl(m: Column) -> Column:
    """Null where the plan names no table or no key columns: a statement without keys would fix nothing."""
    ddl = _index_ddl(_index_name(m["table"], F.array_join(m["keys"], "_")), m["schema"], m["table"], m["keys"], m["included"])
    return F.when(F.size(m["keys"]) > 0, ddl)


def covering_ddl() -> Column:
    """For a lookup: the seek's index beside it, rebuilt with the columns that the lookup fetches; without such a seek a new index on the columns that the lookup seeks by. Null without keys or a table."""
    wanted = F.array_except("output_columns", F.coalesce("sibling_keys", F.array().cast("array<string>")))
    rebuilt = _index_ddl(F.concat(F.lit("["), F.col("sibling"), F.lit("]")), F.col("schema"), F.col("table"), F.col("sibling_keys"), wanted, rebuilt=True)
    new = _index_ddl(_index_name(F.col("table"), F.array_join("seek_columns", "_")), F.col("schema"), F.col("table"), F.col("seek_columns"), F.array_except("output_columns", "seek_columns"))
    return F.when(F.size("sibling_keys") > 0, rebuilt).when(F.col("sibling").isNull() & (F.size("seek_columns") > 0), new)


def _sort_ddl() -> Column:
    """An index in the order of a sort, with what the sort hands on."""
    ddl = _index_ddl(_index_name(F.col("sort_table"), F.array_join("sort_columns", "_")), F.lit("dbo"), F.col("sort_table"), F.col("sort_columns"), F.array_except("output_columns", "sort_columns"))
    return F.when(F.size("sort_columns") > 0, ddl)


def _rules() -> list[tuple[str, Column, Column]]:
    """(rule, severity, condition) of an operator's own figures."""
    op, rows, lit = F.lower("physical_op"), F.col("estimated_rows"), F.lit
    more, less = F.greatest("estimated_rows", "actual_rows"), F.least("estimated_rows", "actual_rows")
    lookup = op.isin("key lookup", "rid lookup")
    often = F.greatest(F.col("estimated_executions"), F.coalesce("actual_executions", lit(0.0))) >= MANY_EXECUTIONS
    granted, used = F.col("granted_kb"), F.col("used_kb")
    return [
        ("plan.table_scan", lit("warning"), op == "table scan"),
        ("plan.sort_large", F.when(rows >= BIG, "warning").otherwise("info"), (op == "sort") & (rows >= HIGH_ROWS)),
        ("plan.hash_join_large", lit("info"), (op == "hash match") & F.lower("logical_op").contains("join") & (rows >= BIG)),
        ("plan.scan_residual_predicate", lit("warning"), op.isin("index scan", "clustered index scan") & F.col("residual").isNotNull() & ~F.col("seeks") & (rows >= HIGH_ROWS)),
        ("plan.lookup", F.when(often, "error").otherwise("warning"), lookup),
        ("index.wide_covering_request", lit("info"), lookup & (F.size("output_columns") > 5)),
        ("plan.estimate_actual_skew", lit("error"), F.col("actual_rows").isNotNull() & F.col("estimated_rows").isNotNull() & (more >= SKEW_ROWS) & (more / F.greatest(less, lit(1.0)) >= SKEW)),
        ("plan.memory_grant_excessive", lit("warning"), used.isNotNull() & (granted >= GRANT_KB) & (granted >= GRANT_EXCESS * F.greatest(used, lit(1.0)))),
        ("plan.memory_grant_large", F.when(granted >= HUGE_KB, "warning").otherwise("info"), used.isNull() & (granted >= LARGE_KB)),
        ("plan_xml.parse_error", lit("error"), F.col("error").isNotNull()),
    ]


def _of_warning(w: Column) -> Column:
    rule, severity = F.concat(F.lit("plan.warning."), w), F.lit("warning")
    for name, (its_rule, its_severity) in WARNINGS.items():
        rule, severity = F.when(w == name, its_rule).otherwise(rule), F.when(w == name, its_severity).otherwise(severity)
    return F.struct(rule.alias("rule"), severity.alias("severity"), w.alias("detail"), F.lit(None).cast("string").alias("ddl"))


def findings(operators: DataFrame) -> DataFrame:
    """(plan_id, seq, node_id, rule, severity, detail, ddl) of all operators, a projection of their rows.

    ``detail`` is a sibling index, a warning or a missing index; ``ddl`` the
    statement that makes or widens an index, where the plan names its columns.
    """
    none = F.lit(None).cast("string")
    shaped = lambda rule, severity, detail, ddl: F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), detail.cast("string").alias("detail"), ddl.alias("ddl"))
    ddl = {"plan.lookup": covering_ddl(), "plan.sort_large": _sort_ddl()}
    own = [F.when(F.coalesce(hit, F.lit(False)), shaped(rule, severity, F.col("sibling") if rule == "plan.lookup" else none, ddl.get(rule, none))) for rule, severity, hit in _rules()]
    said = F.transform(F.coalesce("warnings", F.array().cast("array<string>")), _of_warning)
    told = lambda m: F.concat_ws("|", m["impact"], F.coalesce(m["table"], F.lit("")), F.array_join(m["keys"], ","), F.array_join(m["included"], ","))
    missing = F.transform(F.col("missing_indexes"), lambda m: shaped("plan.missing_index", F.lit("warning"), told(m), _missing_ddl(m)))
    found = F.concat(F.filter(F.array(*own), lambda f: f.isNotNull()), said, F.coalesce(missing, F.array().cast("array<struct<rule:string,severity:string,detail:string,ddl:string>>")))
    return operators.select("plan_id", "seq", "node_id", F.explode(found).alias("f")).select("plan_id", "seq", "node_id", "f.rule", "f.severity", "f.detail", "f.ddl")


def report(operators: DataFrame) -> DataFrame:
    """Findings with their ``place`` in the plan's report, in pre-order within a rule."""
    return findings(operators).withColumn("place", F.row_number().over(Window.partitionBy("plan_id").orderBy("seq", "rule", "detail")))
