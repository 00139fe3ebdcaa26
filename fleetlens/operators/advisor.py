"""Findings and recommendations from catalog tables.

Tables are keyed by ``table_name`` (lower-cased by the caller's views). Unknown
row counts are null: a rule with a row limit fires on unknown only where it says
so. Index pairs come from equality joins on the table and the leading key
column, never from all pairs of a table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from fleetlens.functions.spread import spread

#: Limits of the findings and recommendations.
UNUSED_UPDATES, SMALL_ROWS, LARGE_ROWS, HUGE_ROWS = 100, 1_000, 100_000, 1_000_000
PRIMARY_KEY_ROWS, FORWARDED_RECORDS = 100, 1_000
WIDE_KEY_COLUMNS, WIDE_KEY_BYTES = 3, 16
HIGH_UPDATES, MEDIUM_UPDATES = 100_000, 10_000
FRAGMENTED_PCT, FRAGMENTED_PAGES, LOW_FILL = 30.0, 1_000, 70
STALE_PCT, STALE_LARGE_PCT, STALE_ROWS = 10.0, 20.0, 1_000
SCANS_LEAST, COLUMNSTORE_KB = 100, 1 << 20
SKEW_PLANS, SKEW_EXECUTIONS, SKEW_RATIO, SKEW_READS = 2, 50, 10.0, 1_000_000
LOB_TYPES = ["text", "ntext", "image"]

#: Indexes in a block of ``index_pairs``; fewer make smaller groups and more copies of a row, one for each block of its leading column.
PAIRS_BLOCK = 2_048
#: Indexes of a block that follow each other by name and are met as one array; the pairs of an index with one array are held at once.
PAIRS_RUN = 64


def table_rows(partitions: DataFrame) -> DataFrame:
    """(table_name, rows, reserved_kb): rows of the heap or clustered index (index_id 0 or 1), else the most of any index."""
    own = F.sum(F.when(F.col("index_id").isin(0, 1) | (F.col("index_id").isNull() & F.col("index_name").isNull()), F.col("row_count")))
    return partitions.groupBy("table_name").agg(F.coalesce(own, F.max("row_count")).alias("rows"), F.sum("reserved_kb").alias("reserved_kb"))


def _reads() -> Column:
    return F.col("seeks") + F.col("scans") + F.col("lookups")


def unused_findings(indexes: DataFrame) -> DataFrame:
    """Indexes that nobody reads and over 100 updates touched; heaps (no index name) and primary keys don't count."""
    hit = indexes.where((_reads() == 0) & (F.col("updates") > UNUSED_UPDATES) & F.col("index_name").isNotNull() & ~F.coalesce("is_primary_key", F.lit(False)))
    return hit.select("table_name", "index_name", F.lit("dmv.unused_index").alias("rule"), F.lit("warning").alias("severity"))


def heatmap(indexes: DataFrame) -> DataFrame:
    return indexes.select("table_name", "index_name", (_reads() - F.col("updates")).alias("score"))


def heatmap_order(indexes: DataFrame) -> DataFrame:
    """(table_name, index_name, reads, writes, score) as a heatmap lists them: the most used first, then by score and names. None where nothing was used at all."""
    rows = indexes.select("table_name", "index_name", _reads().alias("reads"), F.col("updates").alias("writes"), (_reads() - F.col("updates")).alias("score"))
    used = rows.agg(F.sum(F.col("reads") + F.col("writes")).alias("used")).where("used > 0").select(F.lit(True).alias("used"))
    return rows.join(F.broadcast(used)).drop("used").orderBy(F.desc_nulls_last(F.col("reads") + F.col("writes")), F.desc_nulls_last("score"), "table_name", "index_name")  # one row


def unused_existing(indexes: DataFrame, least: int = UNUSED_UPDATES) -> DataFrame:
    """(table_name, index_name, updates): indexes with over ``least`` updates and no read. Heaps, unique and clustered ones and primary keys, by their flag or a name like PK_, don't count."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    key = F.lower("index_name").startswith("pk_") | (F.lower("index_name") == "pk")
    return indexes.where((_reads() == 0) & (F.col("updates") > least) & ~key & ~flag("is_primary_key") & ~flag("is_unique") & ~flag("is_clustered")).select("table_name", "index_name", "updates")


def index_pairs(indexes: DataFrame) -> DataFrame:
    """(table_name, index_a, index_b, rule, severity): index pairs that lead with the same column; error where keys and the set of included columns agree.

    The rows are all pairs of a leading column. Its indexes are dealt by name to
    blocks of some ``PAIRS_BLOCK``, and any two blocks meet once, in a group of
    their own, so that the pairs of one common column are made by many tasks. An
    index meets a block by runs of sorted names, where most runs lie whole before
    or behind it: the join passes a row a run, and names are compared by pairs
    only in the runs around the index.
    """
    lower = lambda c: F.transform(c, lambda x: F.lower(x))
    extra = F.array_sort(lower(F.coalesce("included_columns", F.array().cast("array<string>"))))
    i = indexes.where("index_name is not null and size(key_columns) > 0").select("table_name", F.lower(F.get("key_columns", F.lit(0))).alias("lead"), "index_name", F.to_json(F.struct(lower("key_columns").alias("keys"), extra.alias("extra"))).alias("shape"))
    blocks = i.groupBy("table_name", "lead").agg(F.ceil(F.count("*") / PAIRS_BLOCK).alias("blocks"))
    home, met = ["table_name", "lead", "block"], ["table_name", "lead", "low", "high"]
    dealt = spread(i.join(blocks, ["table_name", "lead"]).withColumn("block", F.pmod(F.xxhash64("index_name"), "blocks")), *home)
    a = dealt.select("table_name", "lead", F.col("block").alias("low"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("high"), F.col("index_name").alias("a"), F.col("shape").alias("shape_a"))
    numbered = dealt.withColumn("run", F.floor((F.row_number().over(Window.partitionBy(*home).orderBy("index_name", "shape")) - 1) / PAIRS_RUN))
    runs = numbered.groupBy(*home, "run").agg(F.min("index_name").alias("first"), F.max("index_name").alias("last"), F.collect_list(F.struct(F.col("index_name").alias("b"), F.col("shape").alias("shape_b"))).alias("there"))
    b = runs.select("table_name", "lead", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("low"), F.col("block").alias("high"), "first", "last", "there")
    side = F.when(F.col("a") < F.col("first"), -1).when(F.col("a") > F.col("last"), 1).otherwise(0).alias("side")
    faced = spread(a, *met).join(spread(b, *met).hint("merge"), met).where("low < high or a < last")  # equal names share a block
    sided = faced.select("table_name", (F.col("low") < F.col("high")).alias("apart"), "a", "shape_a", side, "there")
    pairs = sided.select("table_name", "apart", "a", "shape_a", "side", F.inline("there"))
    ahead = (F.col("side") < 0) | ((F.col("side") == 0) & (F.col("a") < F.col("b")))
    names = F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("index_a"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("index_b")
    return pairs.where(F.col("apart") | ahead).select("table_name", *names, F.lit("dmv.duplicate_or_overlapping_index").alias("rule"), F.when(F.col("shape_a") == F.col("shape_b"), "error").otherwise("info").alias("severity"))


def missing_index_findings(missing: DataFrame, rows: DataFrame) -> DataFrame:
    """Missing indexes of tables that aren't known to be small."""
    return missing.join(rows, "table_name", "left").where((F.col("rows") >= SMALL_ROWS) | F.col("rows").isNull()).select("table_name", "key_columns", F.lit("dmv.missing_index").alias("rule"), F.lit("info").alias("severity"))


def structure_findings(tables: DataFrame) -> DataFrame:
    """(table_name, rule, severity) from a row by table: rows, is_heap, forwarded_records, has_primary_key, clustered_types, clustered_bytes.

    Null flags don't fire. A table whose clustered key holds a uniqueidentifier isn't called wide as well.
    """
    rows = F.col("rows")
    by_size = F.when(rows >= HUGE_ROWS, "error").when(rows >= LARGE_ROWS, "warning").when(rows >= SMALL_ROWS, "info")
    heap = F.when((by_size == "info") & (F.coalesce("forwarded_records", F.lit(0)) >= FORWARDED_RECORDS), "warning").otherwise(by_size)
    guid = F.exists("clustered_types", lambda t: F.lower(t) == "uniqueidentifier")
    wide = (F.size("clustered_types") > WIDE_KEY_COLUMNS) | (F.col("clustered_bytes") > WIDE_KEY_BYTES)
    fires = [
        ("structure.heap_table", F.when(F.col("is_heap"), heap)),
        ("structure.no_primary_key", F.when(~F.col("has_primary_key") & (rows >= PRIMARY_KEY_ROWS), F.when(rows >= HUGE_ROWS, "error").otherwise("warning"))),
        ("structure.guid_clustered_key", F.when(guid, F.when(rows < SMALL_ROWS, "info").otherwise("warning"))),
        ("structure.wide_clustered_key", F.when(~F.coalesce(guid, F.lit(False)) & wide, "info")),
    ]
    found = F.filter(F.array(*[F.struct(F.lit(r).alias("rule"), s.alias("severity")) for r, s in fires]), lambda f: f["severity"].isNotNull())
    return tables.select("table_name", F.explode(found).alias("f")).select("table_name", "f.*")


def lob_findings(columns: DataFrame) -> DataFrame:
    return columns.where(F.lower("type_name").isin(LOB_TYPES)).select("table_name", "column_name", F.lit("structure.deprecated_lob_type").alias("rule"), F.lit("warning").alias("severity"))


def write_cost(n_keys: Column, n_included: Column) -> Column:
    """Divisor of a new index's score: 3 for a costly index, 1.75 for a middling one."""
    units = 2 * n_keys + n_included
    return F.when((n_keys >= 5) | (units >= 12), 3.0).when((n_keys >= 3) | (units >= 6), 1.75).otherwise(1.0)


def create_index(missing: DataFrame, rows: DataFrame) -> DataFrame:
    """(table_name, key_columns, score, priority): what a missing index is worth against what its writes cost. Tables known to be small are left out."""
    score = F.col("cost") * F.col("impact") / 100 * F.greatest(F.col("seeks"), F.lit(1)) / write_cost(F.size("key_columns"), F.size(F.coalesce("included_columns", F.array().cast("array<string>"))))
    found = missing.join(rows, "table_name", "left").where((F.col("rows") >= SMALL_ROWS) | F.col("rows").isNull()).select("table_name", "key_columns", F.round(score, 6).alias("score"))
    return found.withColumn("priority", F.when(F.col("score") >= 10, "high").when(F.col("score") >= 1, "medium").otherwise("low"))


def without_prefixes(missing: DataFrame) -> DataFrame:
    """Missing indexes that no other one of the table extends: keys that are a prefix of longer keys fold into these.

    Rows with equal keys are one: most impact and cost, all seeks. A folded row's
    seeks go to each index that extends it. Pairs meet by table and prefix, so
    that only prefixes are joined.
    """
    one = missing.groupBy("table_name", "key_columns").agg(F.max("impact").alias("impact"), F.max("cost").alias("cost"), F.sum("seeks").alias("seeks"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("included_columns")))).alias("included_columns"))
    prefixes = one.select("table_name", F.col("key_columns").alias("whole"), F.explode(F.transform(F.sequence(F.lit(1), F.size("key_columns")), lambda n: F.slice("key_columns", 1, n))).alias("key_columns"))
    met = prefixes.join(one, ["table_name", "key_columns"])
    extended = met.where("size(whole) > size(key_columns)").select("table_name", "key_columns").distinct()
    folded = met.groupBy("table_name", "whole").agg(F.max("impact").alias("impact"), F.max("cost").alias("cost"), F.sum("seeks").alias("seeks"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("included_columns")))).alias("included_columns"))
    return folded.withColumnRenamed("whole", "key_columns").join(extended, ["table_name", "key_columns"], "left_anti")


def _plain(columns: Column) -> Column:
    """Column names to compare by: lower case, without brackets; null as none."""
    return F.transform(F.coalesce(columns, F.array().cast("array<string>")), lambda c: F.lower(F.btrim(c, F.lit("[] "))))


def _together(lists: str) -> Column:
    """All names of a column of lists, each once by any case and brackets, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(_plain(F.col(lists))))))


def _roots(t: pa.Table) -> pa.Table:
    """``root`` of each key list of one table and leading column: the list that it ends up in when each folds into the first of those that extend it."""
    keys = [tuple(k) for k in t.column("plain").to_pylist()]
    place = dict(zip(keys, zip(t.column("place").to_pylist(), keys, strict=True), strict=True))
    into: dict[tuple, tuple] = {}
    for k in keys:
        for n in range(1, len(k)):
            if k[:n] in place and (k[:n] not in into or place[k] < place[into[k[:n]]]):
                into[k[:n]] = k

    def root(k: tuple) -> tuple:
        while k in into:
            k = into[k]
        return k

    return t.append_column("root", pa.array([list(root(k)) for k in keys], pa.list_(pa.string())))


def consolidated(missing: DataFrame) -> DataFrame:
    """(table_name, key_columns, included_columns, impact, cost, seeks, requests): index requests without those that a longer one serves.

    A request whose keys are a prefix of another's on its table folds into the
    first such one, by ``place`` where ``missing`` has it and by the keys else,
    and that one into the first that extends it, so that each request's seeks
    count once. The survivor has the most impact and cost, all seeks and all
    included columns. Names compare without case and brackets; keys come back
    as the first such request spells them. Requests without keys are left out.

    Equal key lists are one row before lists meet; what meets in a task is a
    table's different lists with one leading column, of which a server keeps a few hundred.
    """
    place = F.col("place").cast("long") if "place" in missing.columns else F.lit(0).cast("long")
    said = missing.where("size(key_columns) > 0").select("table_name", "key_columns", "included_columns", "impact", "cost", "seeks", place.alias("place"), _plain(F.col("key_columns")).alias("plain"))
    evidence = [F.max("impact").alias("impact"), F.max("cost").alias("cost"), F.sum("seeks").alias("seeks"), _together("included_columns").alias("included_columns")]
    one = spread(said.withColumn("lead", F.element_at("plain", 1)), "table_name", "lead", "plain").groupBy("table_name", "lead", "plain").agg(F.min("place").alias("place"), F.min_by("key_columns", F.struct("place", "key_columns")).alias("key_columns"), *evidence, F.count("*").alias("requests"))
    schema = StructType([*one.schema.fields, StructField("root", ArrayType(StringType()))])
    rooted = one.groupBy("table_name", "lead").applyInArrow(_roots, schema)
    own = F.col("plain") == F.col("root")
    return rooted.groupBy("table_name", "root").agg(F.max(F.when(own, F.col("key_columns"))).alias("key_columns"), *evidence, F.sum("requests").alias("requests")).select("table_name", "key_columns", "included_columns", "impact", "cost", "seeks", "requests")


def advised_indexes(missing: DataFrame, rows: DataFrame, indexes: DataFrame) -> DataFrame:
    """(table_name, key_columns, included_columns, kind, index_name, score, priority, ddl): what to build for ``consolidated`` requests beside the indexes there are.

    A request is served, and left out, where an index has its keys first and all
    its columns. One with just its keys is widened in place (kind ``widen``);
    else there is a new index (``create``), whose name is free on its table:
    requests that would share one are numbered. Primary keys, unique and
    clustered indexes neither serve nor widen. Tables known to be small are left out.
    """
    names = F.concat(F.col("plain"), _plain(F.col("included_columns")))
    wanted = consolidated(missing).withColumn("plain", _plain(F.col("key_columns"))).join(rows.select("table_name", "rows"), "table_name", "left").where((F.col("rows") >= SMALL_ROWS) | F.col("rows").isNull()).drop("rows")
    flag = lambda c: F.coalesce(c, F.lit(False))
    there = indexes.where(F.col("index_name").isNotNull() & ~flag("is_primary_key") & ~flag("is_unique") & ~flag("is_clustered")).withColumn("plain", _plain(F.col("key_columns"))).where("size(plain) > 0")
    shapes = spread(there.select("table_name", "index_name", "plain", _plain(F.col("included_columns")).alias("included_columns")), "table_name", "plain", "included_columns").groupBy("table_name", "plain", "included_columns").agg(F.min("index_name").alias("index_name"))  # indexes of one shape serve alike
    firsts = shapes.select("table_name", F.col("index_name").alias("old"), F.col("plain").alias("old_keys"), names.alias("old_columns"), F.col("included_columns").alias("old_included"), F.explode(F.transform(F.sequence(F.lit(1), F.size("plain")), lambda n: F.slice("plain", 1, n))).alias("plain"))
    met = wanted.select("table_name", "plain", "included_columns").join(firsts, ["table_name", "plain"])
    serves = F.size(F.array_except("included_columns", "old_columns")) == 0
    same = F.when(F.col("plain") == F.col("old_keys"), F.struct("old", "old_included"))
    found = met.groupBy("table_name", "plain").agg(F.max(serves).alias("served"), F.min(same).alias("same"))
    left = wanted.join(found, ["table_name", "plain"], "left").where(~F.coalesce("served", F.lit(False)))
    widened = F.col("same").isNotNull()
    included = F.when(widened, F.array_sort(F.array_union("included_columns", F.col("same.old_included")))).otherwise(F.col("included_columns"))
    base = F.substring(F.concat(F.lit("IX_"), F.regexp_replace(F.concat_ws("_", "table_name", F.array_join("plain", "_")), "[^A-Za-z0-9_]", "")), 1, 120)
    score = F.round(F.col("cost") * F.col("impact") / 100 * F.greatest(F.col("seeks"), F.lit(1)) / write_cost(F.size("key_columns"), F.size("included_columns")), 6)
    t = left.select("table_name", "plain", "key_columns", included.alias("included_columns"), F.when(widened, "widen").otherwise("create").alias("kind"), F.col("same.old").alias("old"), base.alias("base"), score.alias("score"))
    number = F.regexp_extract(F.lower("index_name"), "_([0-9]{1,9})$", 1)
    stem = F.when(F.length(number) > 0, F.regexp_replace(F.lower("index_name"), "_[0-9]{1,9}$", ""))
    used = F.explode(F.array(F.struct(F.lower("index_name").alias("stem"), F.lit(1).alias("n")), F.struct(stem.alias("stem"), F.try_to_number(number, F.lit("999999999")).cast("int").alias("n"))))
    said = indexes.where("index_name is not null").select("table_name", used.alias("u")).where("u.stem is not null").select("table_name", "u.stem", "u.n")
    taken = spread(said, "table_name", "stem").groupBy("table_name", "stem").agg(F.array_sort(F.collect_set("n")).alias("used"))
    named = t.withColumn("stem", F.lower("base")).join(taken, ["table_name", "stem"], "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    turn = F.row_number().over(Window.partitionBy("table_name", "stem", "kind").orderBy("plain"))
    free = F.element_at(F.array_except(F.sequence(F.lit(1), F.size("used") + turn), F.col("used")), turn)
    name = F.when(F.col("kind") == "widen", F.col("old")).when(free == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), free.cast("string")))
    out = named.withColumn("index_name", name).withColumn("priority", F.when(F.col("score") >= 10, "high").when(F.col("score") >= 1, "medium").otherwise("low"))
    include = F.when(F.size("included_columns") > 0, F.concat(F.lit(" INCLUDE ("), _column_list(F.col("included_columns")), F.lit(")"))).otherwise("")
    rebuilt = F.when(F.col("kind") == "widen", " WITH (DROP_EXISTING = ON)").otherwise("")
    ddl = F.concat(F.lit("CREATE NONCLUSTERED INDEX "), quoted(F.col("index_name")), F.lit(" ON "), quoted(F.col("table_name")), F.lit(" ("), _column_list(F.col("plain")), F.lit(")"), include, rebuilt, F.lit(";"))
    return out.select("table_name", "key_columns", "included_columns", "kind", "index_name", "score", "priority", ddl.alias("ddl"))


def drop_index(indexes: DataFrame, counters_young: bool = False, monitored_days: int = 0) -> DataFrame:
    """(table_name, index_name, kind, priority): indexes only written to, and those never touched. Heaps, primary keys, unique and clustered ones stay."""
    spare = indexes.where((_reads() == 0) & F.col("index_name").isNotNull() & ~F.coalesce("is_primary_key", F.lit(False)) & ~F.coalesce("is_unique", F.lit(False)) & ~F.coalesce("is_clustered", F.lit(False)))
    high = "medium" if counters_young else "high"
    written = F.when(F.col("updates") >= HIGH_UPDATES, high).when(F.col("updates") >= MEDIUM_UPDATES, "medium").otherwise("low")
    idle = F.lit("medium" if monitored_days >= 7 else "low")
    kind = F.when(F.col("updates") > UNUSED_UPDATES, "write_only").when(F.col("updates") == 0, "never_touched")
    return spare.withColumn("kind", kind).where("kind is not null").select("table_name", "index_name", "kind", F.when(F.col("kind") == "write_only", written).otherwise(idle).alias("priority"))


def merge_index(indexes: DataFrame) -> DataFrame:
    """(table_name, retire, keep): non-unique indexes whose key is a strict left prefix of another's, each with the least such index by name."""
    i = indexes.where("index_name is not null and size(key_columns) > 0").select("table_name", "index_name", F.transform("key_columns", lambda x: F.lower(x)).alias("keys"), F.coalesce("is_primary_key", F.lit(False)).alias("pk"), F.coalesce("is_unique", F.lit(False)).alias("uq"))
    prefixes = i.where("size(keys) > 1").select("table_name", F.col("index_name").alias("keep"), F.explode(F.transform(F.sequence(F.lit(1), F.size("keys") - 1), lambda n: F.slice("keys", 1, n))).alias("keys"))
    first = spread(prefixes, "table_name", "keys").groupBy("table_name", "keys").agg(F.min("keep").alias("keep"))  # one row a prefix: an index meets no more than one
    met = spread(i.where("not pk and not uq"), "table_name", "keys").join(first, ["table_name", "keys"]).select("table_name", F.col("index_name").alias("retire"), "keep")
    return spread(met, "table_name", "retire").groupBy("table_name", "retire").agg(F.min("keep").alias("keep"))


def columnstore_candidates(tables: DataFrame) -> DataFrame:
    """Large tables (rows, reserved_kb) that are scanned more than sought and seldom changed."""
    large = (F.col("rows") >= HUGE_ROWS) | (F.col("reserved_kb") >= COLUMNSTORE_KB)
    calm = (_reads() == 0) | (F.col("updates") < 0.2 * _reads())
    return tables.where(large & (F.col("scans") > F.col("seeks")) & (F.col("scans") >= SCANS_LEAST) & calm).select("table_name", "scans", "seeks")


def rebuild_index(physical: DataFrame) -> DataFrame:
    """(table_name, index_name, reason): fragmented indexes of some size, and loosely filled ones that are mostly read."""
    fragmented = (F.col("fragmentation_pct") >= FRAGMENTED_PCT) & (F.col("pages") >= FRAGMENTED_PAGES)
    loose = (F.col("fill_factor") > 0) & (F.col("fill_factor") < LOW_FILL) & (_reads() > 0) & (10 * F.col("updates") <= _reads())
    reason = F.when(fragmented, "fragmented").when(loose, "fill_factor")
    return physical.withColumn("reason", reason).where("reason is not null").select("table_name", "index_name", "reason")


def update_statistics(stats: DataFrame) -> DataFrame:
    """Statistics with many changes since they were made; ones that update themselves need a large table."""
    pct = F.col("modifications") * 100.0 / F.col("rows")
    manual = F.col("no_recompute") & (pct >= STALE_PCT) & (F.col("modifications") >= STALE_ROWS)
    return stats.where((F.col("rows") > 0) & (manual | (F.col("rows") >= LARGE_ROWS) & (pct >= STALE_LARGE_PCT))).select("table_name", "stats_name", F.round(pct, 4).alias("changed_pct"))


def parameter_sniffing(skew: DataFrame) -> DataFrame:
    """Queries with several plans whose worst execution reads ten times the mean."""
    hit = (F.col("plans") >= SKEW_PLANS) & (F.col("executions") >= SKEW_EXECUTIONS) & (F.col("avg_reads") > 0) & (F.col("max_reads") / F.col("avg_reads") >= SKEW_RATIO)
    return skew.where(hit).select("query_id", F.round(F.col("max_reads") / F.col("avg_reads"), 4).alias("ratio"), F.when(F.col("max_reads") >= SKEW_READS, "high").otherwise("medium").alias("priority"))


def quoted(*names: Column) -> Column:
    """A dotted name with brackets around its parts."""
    return F.concat_ws(".", *[F.concat(F.lit("["), F.replace(n, F.lit("]"), F.lit("]]")), F.lit("]")) for n in names])


def _column_list(columns: Column) -> Column:
    return F.array_join(F.transform(columns, lambda c: F.concat(F.lit("["), c, F.lit("]"))), ", ")


def create_ddl(found: DataFrame) -> DataFrame:
    """``found`` (table_name, key_columns, included_columns) with ``ddl``, the statement that creates the index; names follow the key columns."""
    extra = F.coalesce("included_columns", F.array().cast("array<string>"))
    name = F.substring(F.concat(F.lit("IX_"), F.regexp_replace(F.concat_ws("_", "table_name", F.array_join("key_columns", "_")), "[^A-Za-z0-9_]", "")), 1, 120)
    include = F.when(F.size(extra) > 0, F.concat(F.lit(" INCLUDE ("), _column_list(extra), F.lit(")"))).otherwise("")
    return found.withColumn("ddl", F.concat(F.lit("CREATE NONCLUSTERED INDEX ["), name, F.lit("] ON "), quoted(F.col("table_name")), F.lit(" ("), _column_list(F.col("key_columns")), F.lit(")"), include, F.lit(";")))


def drop_ddl(found: DataFrame, index: str = "index_name") -> DataFrame:
    return found.withColumn("ddl", F.concat(F.lit("DROP INDEX "), quoted(F.col(index)), F.lit(" ON "), quoted(F.col("table_name")), F.lit(";")))


def workload_boost(per_day: Column) -> Column:
    """What a score gains by how often queries on the table run: 1 where they don't, 2 at nine times a day."""
    return F.when(per_day > 0, 1 + F.log(1 + per_day) / F.log(F.lit(10.0))).otherwise(1.0)


def boosted(found: DataFrame, workload: DataFrame) -> DataFrame:
    """``found`` (table_name, score) with the score raised by the busiest row of ``workload`` (table_name, execution_count, window_hours) on its table, and executions_per_day."""
    busiest = workload.where("window_hours > 0").groupBy("table_name").agg(F.max(F.col("execution_count") * 24.0 / F.col("window_hours")).alias("executions_per_day"))
    joined = found.join(busiest, "table_name", "left")
    return joined.withColumn("score", F.round(F.col("score") * workload_boost(F.col("executions_per_day")), 6))


def with_days_seen(found: DataFrame, history: DataFrame) -> DataFrame:
    """``found`` with ``note``: on how many of the observed days of ``history`` (table_name, days_seen, days_observed) the request showed; null where that is unknown."""
    noted = history.select("table_name", F.format_string("seen on %d of %d days", "days_seen", "days_observed").alias("note"))
    return found.join(noted, "table_name", "left")


def merge_same_keys(indexes: DataFrame) -> DataFrame:
    """(table_name, keep, retire, kind, priority, reclaimed_kb, confidence): indexes of one table with equal key columns, each against the one that stays.

    kind exact: the included columns are the same set too; a primary key or
    unique index stays, else the first by name, and neither kind is retired.
    kind overlapping: neither side is unique and included columns differ; the
    one with more reads stays. Groups have a representative, so that n equal
    indexes give n - 1 rows, not all pairs.
    """
    lower = lambda c: F.transform(c, lambda x: F.lower(x))
    flag = lambda c: F.coalesce(c, F.lit(False))
    i = indexes.where("index_name is not null and size(key_columns) > 0").select("table_name", "index_name", F.array_join(lower("key_columns"), "\x1f").alias("keys"), F.array_join(F.array_sort(lower(F.coalesce("included_columns", F.array().cast("array<string>")))), "\x1f").alias("extra"), (flag("is_primary_key") | flag("is_unique")).alias("bound"), _reads().alias("reads"), F.coalesce("reserved_kb", F.lit(0)).alias("kb"))
    exact = Window.partitionBy("table_name", "keys", "extra").orderBy(F.desc("bound"), "index_name")
    e = i.withColumn("keep", F.first("index_name").over(exact)).withColumn("place", F.row_number().over(exact))
    equal = e.where((F.col("place") > 1) & ~F.col("bound")).select("table_name", "keep", F.col("index_name").alias("retire"), F.lit("exact").alias("kind"), "kb", "reads")
    heads = e.where((F.col("place") == 1) & ~F.col("bound"))
    similar = Window.partitionBy("table_name", "keys").orderBy(F.desc_nulls_last("reads"), "index_name")
    o = heads.withColumn("keep", F.first("index_name").over(similar)).withColumn("place", F.row_number().over(similar))
    overlapping = o.where("place > 1").select("table_name", "keep", F.col("index_name").alias("retire"), F.lit("overlapping").alias("kind"), "kb", "reads")
    return equal.unionByName(overlapping).select("table_name", "keep", "retire", "kind", F.when(F.col("kind") == "overlapping", "low").otherwise(merge_priority(F.col("kb"))).alias("priority"), F.col("kb").alias("reclaimed_kb"), F.when(F.col("reads").isNull(), "estimated").otherwise("observed").alias("confidence"))


def merge_priority(reclaimed_kb: Column) -> Column:
    return F.when(reclaimed_kb > 0, "medium").otherwise("low")


def alter_column(columns: DataFrame) -> DataFrame:
    """(table_name, column_name, ddl, priority): legacy LOB columns and the statement that gives each its modern type."""
    kind = F.lower("type_name")
    modern = F.when(kind == "text", "varchar(max)").when(kind == "ntext", "nvarchar(max)").otherwise("varbinary(max)")
    ddl = F.concat(F.lit("ALTER TABLE "), quoted(F.col("table_name")), F.lit(" ALTER COLUMN "), quoted(F.col("column_name")), F.lit(" "), modern, F.lit(";"))
    return columns.where(kind.isin(LOB_TYPES)).select("table_name", "column_name", ddl.alias("ddl"), F.lit("medium").alias("priority"))


#: Kinds whose evidence is counters that a restart clears.
USAGE_KINDS = ("create_index", "drop_index", "merge_index", "columnstore")


def stamped(found: DataFrame, counter_age_seconds: int | None) -> DataFrame:
    """``found`` (kind, confidence) with counter_age_seconds on what counters tell; under a day of them makes observed estimated."""
    usage = F.col("kind").isin(*USAGE_KINDS)
    age = F.when(usage, F.lit(counter_age_seconds).cast("long"))
    return found.withColumns({"counter_age_seconds": age, "confidence": F.when(F.coalesce(age < 86_400, F.lit(False)) & (F.col("confidence") == "observed"), "estimated").otherwise(F.col("confidence"))})
