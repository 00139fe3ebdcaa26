"""Stand-ins for telemetry tables, projected from the star schema and the event stream.

No table of the test data holds real counters, so that each view is a plain
projection that SQL can repeat; ``SQL`` has the same views as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each captured interval of a query and plan."""
    k = F.get_json_object("props", "$.k").cast("long")
    return _table(spark, sf_dir, "events").select(F.col("event_id"), F.col("user_id").alias("query_id"), (k % 3).alias("plan_id"), F.col("ts").alias("captured_at"), F.col("value").alias("total_duration_ms"), (1 + k % 5).alias("executions"), F.col("event_type").alias("query_sql_text"))


def index_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of reads and updates of an index; reads are the discounted or undiscounted lines of three kinds, so that some indexes have none."""
    when = lambda hit, n: F.when(hit, n).otherwise(0).cast("long")
    quantity, high = F.col("l_quantity").cast("long"), F.col("l_discount") >= 0.085
    return _table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("table_id"), F.col("l_partkey").alias("index_id"), F.col("l_shipdate").alias("captured_at"), when((F.col("l_returnflag") == "A") & (F.col("l_discount") >= 0.095), quantity).alias("seeks"), when((F.col("l_returnflag") == "R") & high, quantity).alias("scans"), when((F.col("l_linestatus") == "F") & (F.col("l_discount") < 0.005), F.lit(1)).alias("lookups"), when(F.col("l_returnflag") == "N", quantity).alias("updates"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative milliseconds by wait type at hourly captures; they start anew each week, as after a restart."""
    ms = F.round(F.col("value") * 1000).cast("long")
    by = _table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("instance_id"), F.col("event_type").alias("wait_type"), F.date_trunc("hour", "ts").alias("captured_at"), ms.alias("ms"))
    by = by.groupBy("instance_id", "wait_type", "captured_at").agg(F.sum("ms").alias("ms"))
    week = F.floor(F.datediff(F.to_date("captured_at"), F.lit("2024-01-01").cast("date")) / 7)
    total = F.sum("ms").over(Window.partitionBy("instance_id", "wait_type", "week").orderBy("captured_at").rowsBetween(Window.unboundedPreceding, 0))
    return by.withColumn("week", week).select("instance_id", "wait_type", "captured_at", total.alias("total_ms"))


SQL = """
query_store as (select event_id, user_id as query_id, cast(json_extract_string(props, '$.k') as bigint) % 3 as plan_id, ts as captured_at, value as total_duration_ms,
    1 + cast(json_extract_string(props, '$.k') as bigint) % 5 as executions, event_type as query_sql_text from events),
index_usage as (select l_suppkey % 10 as table_id, l_partkey as index_id, l_shipdate as captured_at,
    case when l_returnflag = 'A' and l_discount >= 0.095 then cast(trunc(l_quantity) as bigint) else 0 end as seeks, case when l_returnflag = 'R' and l_discount >= 0.085 then cast(trunc(l_quantity) as bigint) else 0 end as scans,
    case when l_linestatus = 'F' and l_discount < 0.005 then 1 else 0 end as lookups, case when l_returnflag = 'N' then cast(trunc(l_quantity) as bigint) else 0 end as updates from lineitem),
hourly as (select user_id % 5 as instance_id, event_type as wait_type, date_trunc('hour', ts) as captured_at, cast(sum(cast(round(value * 1000) as bigint)) as bigint) as ms from events group by all),
counters as (select instance_id, wait_type, captured_at, cast(sum(ms) over (partition by instance_id, wait_type, date_diff('day', date '2024-01-01', cast(captured_at as date)) // 7 order by captured_at) as bigint) as total_ms from hourly)
"""
