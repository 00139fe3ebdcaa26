"""Stand-ins for catalog tables, projected from parts and line items; ``SQL`` has the same views as text.

Each part is an index of its brand's table, and a request for one. Key columns
are the first one to three of the words of its name and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.sources import views


def _keys() -> Column:
    return F.slice(F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))), 1, 1 + F.col("p_size") % 3)


def _included() -> Column:
    return F.when(F.col("p_size") % 4 == 0, F.array(F.lower("p_type"))).otherwise(F.array().cast("array<string>"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("table_name", F.lower("p_brand"))


def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index a part, with its uses over all line items; tables of the first brands are only read."""
    uses = views.index_usage(spark, sf_dir).groupBy("index_id").agg(*[F.sum(c).alias(c) for c in ("seeks", "scans", "lookups", "updates")])
    p = _parts(spark, sf_dir).select("table_name", F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string")).alias("index_name"), _keys().alias("key_columns"), _included().alias("included_columns"), (F.col("p_size") == 1).alias("is_primary_key"), (F.col("p_size") % 10 == 0).alias("is_unique"), (F.col("p_size") % 25 == 0).alias("is_clustered"), F.col("p_partkey").alias("index_id"), (F.col("p_size") * 10).cast("long").alias("reserved_kb"))
    read_only = F.col("table_name").startswith("brand#1")
    known = [F.when(read_only, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c) if c == "updates" else F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("seeks", "scans", "lookups", "updates")]
    return p.join(uses, "index_id", "left").select("table_name", "index_name", "key_columns", "included_columns", "is_primary_key", "is_unique", "is_clustered", "reserved_kb", *known)


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("table_name", F.col("p_name").alias("index_name"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 4).alias("index_id"), (F.col("p_partkey") * 10).alias("row_count"), (F.col("p_size") * 1000).cast("long").alias("reserved_kb"))


def missing_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("table_name", _keys().alias("key_columns"), _included().alias("included_columns"), F.col("p_size").cast("double").alias("impact"), (F.col("p_retailprice") / 1000).alias("cost"), (F.col("p_partkey") % 50).alias("seeks"))


SQL = """
parts as (select *, lower(p_brand) as table_name, list_concat(string_split(p_name, ' '), [lower(p_type)])[1 : 1 + p_size % 3] as key_columns, case when p_size % 4 = 0 then [lower(p_type)] else cast([] as varchar[]) end as included_columns from part),
uses as (select index_id, sum(seeks) as seeks, sum(scans) as scans, sum(lookups) as lookups, sum(updates) as updates from index_usage group by 1),
indexes as (select table_name, replace(p_name, ' ', '_') || '_' || p_partkey as index_name, key_columns, included_columns, p_size = 1 as is_primary_key, p_size % 10 = 0 as is_unique, p_size % 25 = 0 as is_clustered, cast(p_size * 10 as bigint) as reserved_kb,
    cast(coalesce(seeks, 0) as bigint) as seeks, cast(coalesce(scans, 0) as bigint) as scans, cast(coalesce(lookups, 0) as bigint) as lookups, cast(case when starts_with(table_name, 'brand#1') then 0 else coalesce(updates, 0) end as bigint) as updates from parts left join uses on index_id = p_partkey),
partitions as (select table_name, p_name as index_name, case when p_size % 7 <> 0 then p_size % 4 end as index_id, p_partkey * 10 as row_count, cast(p_size * 1000 as bigint) as reserved_kb from parts),
missing as (select table_name, key_columns, included_columns, cast(p_size as double) as impact, p_retailprice / 1000 as cost, p_partkey % 50 as seeks from parts),
table_rows as (select table_name, cast(coalesce(sum(case when index_id in (0, 1) then row_count end), max(row_count)) as bigint) as rows, cast(sum(reserved_kb) as bigint) as reserved_kb from partitions group by 1)
"""
