"""Documents to a training mix: rules, near-duplicates, repeated passages, benchmark leaks, weights.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontamination, mixing, near_copies, quality_rules, simhash_dedup, suffix_dedup
from fleetlens.llm._common import ensure_checkpoint_dir, remove_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands or the base rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group by op9's rule stays, that of the least doc_id; no stage, as op9's three words and three bits miss edited copies."""
    return simhash_dedup.keep_one(docs)


def similar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles stays, that of the least doc_id."""
    return near_copies.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a smaller doc_id holds too are cut out."""
    return suffix_dedup.keep_unrepeated(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents: how many of their words it takes and the slot of its schedule that takes them first."""
    taken = mixing.taken_by_document(mixing.mix(docs.select("doc_id", "text", "source")))
    return taken.where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


STAGES = [("quality rules", quality), ("near duplicates", similar_documents), ("repeated passages", repeated_passages), ("benchmark leaks", leaks), ("mixing", mix)]

#: Compression and fingerprints can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again; a stage's table goes once the next one stands."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove_folder(spark, f"{folder}/{i - 1}")
    return docs.select(*[F.col(c) for c in docs.columns])
