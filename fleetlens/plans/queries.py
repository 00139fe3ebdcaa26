"""Queries of plans over stand-in plans, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.plans import findings, showplan


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of a sort and a scan for each order: (plan_id, xml), with rows and costs from its key and customer."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    parts = [F.lit('<ShowPlanXML xmlns="urn:plan"><QueryPlan MemoryGrant="'), customer, F.lit('000"><RelOp NodeId="0" PhysicalOp="Nested Loops" LogicalOp="Inner Join" EstimateRows="1" EstimatedTotalSubtreeCost="'), (F.col("o_custkey") + 100).cast("string"), F.lit('"><NestedLoops><RelOp NodeId="1" PhysicalOp="Sort" LogicalOp="Sort" EstimateRows="'), key, F.lit('0" EstimatedTotalSubtreeCost="'), customer, F.lit('"><Warnings NoJoinPredicate="1"/></RelOp><RelOp NodeId="2" PhysicalOp="Table Scan" LogicalOp="Table Scan" EstimateRows="1" EstimatedTotalSubtreeCost="25"/></NestedLoops></RelOp></QueryPlan></ShowPlanXML>')]
    return o.select(F.col("o_orderkey").alias("plan_id"), F.concat(*parts).alias("xml"))


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for each part: a missing index, and a lookup beside a seek on the table of its brand, whose name is spelt in two cases; every third has no such seek."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    table, column, key = F.col("p_brand"), F.col("p_type"), F.col("p_partkey").cast("string")
    seek = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit('<RelOp NodeId="1" PhysicalOp="Index Seek"><OutputList/><IndexScan><SeekPredicates><SeekPredicateNew><SeekKeys><Prefix><RangeColumns><ColumnReference Column="k'), key, F.lit('"/></RangeColumns></Prefix></SeekKeys></SeekPredicateNew></SeekPredicates><Object Schema="[s]" Table="['), F.lower(table), F.lit(']" Index="[ix'), key, F.lit(']"/></IndexScan></RelOp>'))).otherwise("")
    parts = [
        F.lit('<ShowPlanXML><QueryPlan><MissingIndexes><MissingIndexGroup Impact="'), F.col("p_size").cast("string"), F.lit('"><MissingIndex Schema="[s]" Table="['), table, F.lit(']"><ColumnGroup Usage="INEQUALITY"><Column Name="[b]"/></ColumnGroup><ColumnGroup Usage="EQUALITY"><Column Name="['), column, F.lit(']"/></ColumnGroup></MissingIndex></MissingIndexGroup></MissingIndexes><RelOp NodeId="0" PhysicalOp="Nested Loops">'), seek,
        F.lit('<RelOp NodeId="2" PhysicalOp="KEY LOOKUP"><OutputList><ColumnReference Column="'), column, F.lit('"/></OutputList><IndexScan><SeekPredicates><RangeColumns><ColumnReference Column="id"/></RangeColumns></SeekPredicates><Object Schema="[s]" Table="['), table, F.lit(']" Index="[pk]"/></IndexScan></RelOp></RelOp></QueryPlan></ShowPlanXML>'),
    ]
    return p.select(F.col("p_partkey").alias("plan_id"), F.concat(*parts).alias("xml"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "plan_treemap": lambda s, d: findings.treemap(showplan.operators(plans(s, d))),
        "plan_findings": lambda s, d: findings.findings(showplan.operators(plans(s, d))).select("plan_id", "seq", "rule", "severity"),
        "plan_index_ddl": lambda s, d: findings.findings(showplan.operators(lookups(s, d))).select("plan_id", "seq", "rule", "severity", "detail", "ddl"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "plan_treemap": """select o_orderkey as plan_id, n.seq, case when n.seq > 0 then 0 end as parent_seq, n.name, cast(case n.seq when 0 then 75.0 when 1 then greatest(o_custkey, 0.0001) else 25.0 end as double) as value
            from orders, (values (0, 'Nested Loops (0)'), (1, 'Sort (1)'), (2, 'Table Scan (2)')) n(seq, name)""",
        "plan_findings": """select o_orderkey as plan_id, 2 as seq, 'plan.table_scan' as rule, 'warning' as severity from orders
            union all select o_orderkey, 1, 'plan.missing_join_predicate', 'error' from orders
            union all select o_orderkey, 1, 'plan.sort_large', case when o_orderkey >= 10000 then 'warning' else 'info' end from orders where o_orderkey >= 1000
            union all select o_orderkey, 0, 'plan.memory_grant_large', case when o_custkey * 1000 >= 1048576 then 'warning' else 'info' end from orders where o_custkey * 1000 >= 102400""",
        "plan_index_ddl": """with p as (select p_partkey as plan_id, p_brand as t, p_type as c, p_size, 'k' || p_partkey as k, 'ix' || p_partkey as ix, p_partkey % 3 > 0 as beside from part)
            select plan_id, 0 as seq, 'plan.missing_index' as rule, 'warning' as severity, p_size || '|' || t || '|' || c || ',b|' as detail, 'CREATE NONCLUSTERED INDEX [IX_' || regexp_replace(t || '_' || c || '_b', '[^A-Za-z0-9_]', '_', 'g') || '] ON [s].[' || t || '] ([' || c || '], [b]);' as ddl from p
            union all select plan_id, case when beside then 2 else 1 end, 'plan.lookup', 'warning', case when beside then ix end,
                case when beside then 'CREATE NONCLUSTERED INDEX [' || ix || '] ON [s].[' || t || '] ([' || k || ']) INCLUDE ([' || c || ']) WITH (DROP_EXISTING = ON);' else 'CREATE NONCLUSTERED INDEX [IX_' || regexp_replace(t, '[^A-Za-z0-9_]', '_', 'g') || '_id] ON [s].[' || t || '] ([id]) INCLUDE ([' || c || ']);' end from p""",
    }
