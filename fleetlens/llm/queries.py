"""The numbered queries: each operator over its whole table, with digest columns, and SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import ball_kmeans, conversation_repair, decontamination, license_scans, lm_scoring, mixing, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, token_counts, url_filters, warc_archives
from fleetlens.llm._common import ensure_checkpoint_dir, table
from fleetlens.llm.oracles import ORACLES


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    return url_filters.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), outcomes)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.find_hits(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixing.taken_by_document(mixed).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return lm_scoring.score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html").withColumn("captured_at", F.timestamp_seconds(1_704_067_200 + F.col("page_id")))
    return warc_archives.archived(pages, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_benchmark_decontamination, op3_mixing, op4_quality_rules, op5_license_scans, op6_substring_dedup, op7_suffix_array_dedup, op8_token_counts, op9_simhash_near_dedup, op10_lm_scoring, op11_conversation_repair, op12_warc, op13_centroid_clustering)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
