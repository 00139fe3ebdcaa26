"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points go through the sources' cumulative weights: the point of
each slot names the source that the slot takes a block from. Slots are ranked
within their source, and the n-th slot of a source takes the n-th block of equal
size of its shuffled word stream, which repeats as often as the target asks.

Nothing here collects: sums by source, ranks and places in the stream come from
counts by (source, part), so that a source of a third of all rows is spread over
many tasks. Only the table of sources, one row each, is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm._common import WORD, ensure_checkpoint_dir

GOLDEN = 0.6180339887498949
#: Slots of a schedule; the block size follows from it, so that errors don't depend on the data's size.
SLOTS = 1 << 20
#: Each source is taken so often at most.
MOST = 3
_PART = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, size).

    Sources by code point, null last, have ``weights`` in turn and share all
    words; a target stops at ``most`` times its source's size and the excess goes
    to the others by weight. That is min(most * size, level * weight) for one
    level, which sums over the sources sorted by the size a weight has give.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # strings compare by code point (UTF-8 bytes); one row a source
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place - 1) % len(weights) + 1).cast("long")).withColumn("cap", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # sources before the first that the level doesn't fill are full
    by = by.withColumn("nth", F.row_number().over(fill)).withColumn("level", level)
    by = by.withColumn("first", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))).over(every)["level"])
    return by.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.coalesce(F.col("first"), F.lit(0.0)) * F.col("weight")).alias("target"))


def schedule(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, source_no, rank, first, end): which stretch [first, end) of a source's repeated stream each slot takes.

    ``targets`` has source_no, target. Targets of all sources sum to T; a block
    has ceil(T / slots) words. Slots that a source has beyond its blocks stay
    empty; blocks beyond its slots, a few by the points' discrepancy, follow at
    the end, so that each source gives its target, rounded.
    """
    spark = targets.sparkSession
    every = Window.partitionBy()
    block = F.greatest(F.ceil(F.round(F.sum("target").over(every)) / slots), F.lit(1))
    cumulated = F.sum("target").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0))
    t = targets.select("source_no", F.round("target").cast("long").alias("words"), block.alias("block"), cumulated.alias("high"), "target", F.sum("target").over(every).alias("total")).where("total > 0 and target > 0")
    t = t.select("source_no", "words", "block", ((F.col("high") - F.col("target")) / F.col("total")).alias("low"), (F.col("high") / F.col("total")).alias("high"), F.ceil(F.col("total") / F.col("block")).alias("n_slots"), F.ceil(F.col("words") / F.col("block")).alias("need"))
    # a grid over [0, 1) makes the range join an equality join with few sources a cell
    cells = t.select("*", F.explode(F.sequence(F.least(F.floor(F.col("low") * _PART), F.lit(_PART - 1)), F.least(F.floor(F.col("high") * _PART), F.lit(_PART - 1)))).alias("cell"))
    point = F.col("slot") * GOLDEN - F.floor(F.col("slot") * GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot")).select("slot", point.alias("point")).withColumn("cell", F.floor(F.col("point") * _PART))
    hit = points.join(cells, "cell").where("slot < n_slots and point >= low and point < high").select("slot", "source_no", F.floor(F.col("slot") / _PART).alias("part"), "need", "words", "block")
    # ranks: slots counted by part, parts added up, slots ranked within their part
    parts = hit.groupBy("source_no", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("source_no", "part").orderBy("slot"))
    ranked = hit.withColumn("within", within).join(parts.select("source_no", "part", "before"), ["source_no", "part"]).select("slot", "source_no", (F.col("before") + F.col("within") - 1).alias("rank"), "need", "words", "block").where("rank < need")
    had = parts.groupBy("source_no").agg(F.sum("n").alias("had"))
    rest = t.join(had, "source_no", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < need")
    rest = rest.select("n_slots", "source_no", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank"), "need", "words", "block").select((F.col("n_slots") + F.col("rank")).alias("slot"), "source_no", "rank", "need", "words", "block")
    return ranked.unionByName(rest).select("slot", "source_no", "rank", (F.col("rank") * F.col("block")).alias("first"), F.least((F.col("rank") + 1) * F.col("block"), F.col("words")).alias("end"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, slots: int = SLOTS) -> DataFrame:
    """(doc_id, part, nth, size, source, source_size, target, slot, words): what each slot takes of each document, and one row without slot for a document that the mix takes nothing of.

    ``docs`` is (doc_id, text, source). A null text has no words. A document's
    place in its source's stream comes from a hash of its id, then the id, then
    its size: reruns agree, rows that repeat an id are documents of their own,
    and a null id hashes as an empty one. Sources may be null or empty; extra
    columns are left aside. No document is taken more than ``most`` times.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    # texts are read once: sums, places and rows all come from this small table
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).checkpoint()
    targets = source_targets(sized, weights, most).withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = sized.withColumn("key", key).withColumn("part", F.substring("key", 1, 3))
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.join(targets, parts["source"].eqNullSafe(targets["source"])).select(parts["source"].alias("p_source"), parts["part"].alias("p_part"), "before", "source_no", "source_size", "target")
    within = F.coalesce(F.sum("size").over(Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("within", within).withColumn("nth", F.row_number().over(Window.partitionBy("source", "part").orderBy("key", "doc_id", "size")))
    placed = placed.join(parts, placed["source"].eqNullSafe(parts["p_source"]) & (placed["part"] == parts["p_part"])).select("doc_id", "source", "size", "part", "nth", "source_no", "source_size", "target", (F.col("before") + F.col("within")).alias("at"))
    # stretches of the repeated stream, cut at blocks
    block = F.greatest(F.ceil(F.round("total") / slots), F.lit(1))
    total = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("total")).select(block.alias("block"))
    words = F.round("target").cast("long")
    epochs = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.ceil(words / F.col("source_size"))).otherwise(0)
    turns = placed.join(F.broadcast(total)).select("*", F.explode_outer(F.when(epochs > 0, F.sequence(F.lit(0).cast("long"), epochs - 1))).alias("epoch"))
    low = F.col("epoch") * F.col("source_size") + F.col("at")
    turns = turns.withColumn("low", low).withColumn("high", F.least(low + F.col("size"), words))
    pieces = turns.select("*", F.explode_outer(F.when(F.col("low") < F.col("high"), F.sequence(F.floor(F.col("low") / F.col("block")), F.floor((F.col("high") - 1) / F.col("block"))))).alias("rank"))
    slot = schedule(targets.select("source_no", "target"), slots).withColumnRenamed("source_no", "s_no").withColumnRenamed("rank", "s_rank")
    taken = pieces.join(slot, (pieces["source_no"] == slot["s_no"]) & (pieces["rank"] == slot["s_rank"]), "left")
    return taken.select("doc_id", "part", "nth", "size", "source", "source_size", "target", "slot", F.when(F.col("slot").isNotNull(), F.least("high", "end") - F.greatest("low", "first")).otherwise(0).cast("long").alias("words"))


def taken_by_document(mixed: DataFrame) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, first_slot) from ``mix``; one row a document."""
    # (source, part, nth) is a document's place, which tells rows that repeat an id apart
    return mixed.groupBy("doc_id", "source", "size", "part", "nth").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("words").alias("taken"), F.min("slot").alias("first_slot")).select("doc_id", "size", "source", "source_size", "target", "taken", "first_slot")
