"""Scripts, plans and bundles from files: found, decoded and told apart."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

_DDL = "path string, text string, lossy boolean, note string"
_SCHEMA = pa.schema([("path", pa.string()), ("text", pa.string()), ("lossy", pa.bool_()), ("note", pa.string())])
#: Marks at the beginning of a file and the encodings they tell.
_MARKS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
#: Of a file without a mark, the bytes that the guess of UTF-16 looks at.
_SNIFF = 512


def found(spark: SparkSession, path: str, pattern: str = "*.[sS][qQ][lL]") -> DataFrame:
    """(path, content) of all files below ``path`` whose names fit, as bytes; a file is one row."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def decoded(raw: bytes) -> tuple[str, bool, str | None]:
    """(text, whether signs were guessed, what was done): UTF-8 or UTF-16 by mark, UTF-16 by its zero bytes, UTF-8, else Windows-1252."""
    for mark, encoding in _MARKS:
        if raw.startswith(mark):
            body = raw[len(mark) :]
            try:
                return body.decode(encoding), False, None if encoding == "utf-8" else f"read as {encoding}"
            except UnicodeDecodeError:
                return body.decode(encoding, "replace"), True, f"broken {encoding}"
    head = raw[:_SNIFF]
    if len(head) >= 4:
        even, odd = head[0::2].count(0), head[1::2].count(0)
        for zeros, others, encoding in ((odd, even, "utf-16-le"), (even, odd, "utf-16-be")):
            if zeros * 10 >= 7 * (len(head) // 2) and others == 0:
                return raw.decode(encoding, "replace"), False, f"read as {encoding} without a mark"
    try:
        return raw.decode("utf-8"), False, None
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace"), True, "not UTF-8; read as Windows-1252"


def texts(files: DataFrame) -> DataFrame:
    """(path, text, lossy, note) of (path, content); a null content is an empty text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [decoded(x or b"") for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), *[pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_SCHEMA)[1:], strict=True)]], schema=_SCHEMA) if rows else pa.RecordBatch.from_pylist([], _SCHEMA)

    return files.select("path", "content").mapInArrow(scan, _DDL)


def kind(text: Column) -> Column:
    """empty, plan, sql or unknown, by what a text holds; comments alone are empty."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    plan = F.substring(F.ltrim(text), 1, 4096).rlike(r"(?i)<ShowPlanXML\b")
    statement = bare.rlike(r"(?i)\b(select|insert|update|delete|merge|create|alter|drop|exec|execute|declare|set|use|begin|grant|with|print|truncate|if|while|return|go)\b")
    return F.when(F.coalesce(F.trim(F.regexp_replace(bare, r"[\s;]+", " ")), F.lit("")) == "", "empty").when(plan, "plan").when(statement, "sql").otherwise("unknown")


def input_findings(files: DataFrame) -> DataFrame:
    """(path, rule, severity, message) of what is odd about the files of ``texts`` themselves."""
    of = kind(F.col("text"))
    each = F.array(
        F.when(F.col("lossy"), F.struct(F.lit("lint.encoding").alias("rule"), F.lit("info").alias("severity"), F.col("note").alias("message"))),
        F.when(of == "empty", F.struct(F.lit("lint.empty_file").alias("rule"), F.lit("info").alias("severity"), F.lit("nothing to read in this file").alias("message"))),
        F.when(of == "unknown", F.struct(F.lit("lint.unrecognized_input").alias("rule"), F.lit("warning").alias("severity"), F.lit("neither a script nor a plan").alias("message"))),
    )
    return files.select("path", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("path", "x.*")


def scripts(files: DataFrame) -> DataFrame:
    """(doc_id, path, sql) of the texts that aren't plans or empty; doc_id is a hash of the path."""
    return files.where(kind(F.col("text")).isin("sql", "unknown")).select(F.xxhash64("path").alias("doc_id"), "path", F.col("text").alias("sql"))


def _fields(*names: str, kind=StringType()) -> list[StructField]:
    return [StructField(n, kind) for n in names]


_NAMED = _fields("schema_name", "table_name")
#: The row sets of a catalog bundle; all fields may be absent, unknown is null.
ROW_SETS = {
    "index_usage": [*_NAMED, *_fields("index_name"), *_fields("user_seeks", "user_scans", "user_lookups", "user_updates", kind=LongType()), StructField("no_stats_row", BooleanType())],
    "indexes": [*_NAMED, *_fields("index_name", "type_desc"), StructField("key_columns", ArrayType(StringType())), StructField("included_columns", ArrayType(StringType())), StructField("key_types", ArrayType(StringType())), *_fields("is_primary_key", "is_unique", "is_clustered", kind=BooleanType()), *_fields("key_bytes", "fill_factor", kind=LongType())],
    "missing_indexes": [*_NAMED, *_fields("equality_columns", "inequality_columns", "included_columns", kind=ArrayType(StringType())), *_fields("avg_user_impact", "avg_total_user_cost", kind=DoubleType()), *_fields("user_seeks", kind=LongType())],
    "partition_stats": [*_NAMED, *_fields("index_name"), *_fields("index_id", "row_count", "reserved_kb", kind=LongType())],
    "workload": [*_NAMED, *_fields("execution_count", kind=LongType()), *_fields("window_hours", kind=DoubleType())],
    "missing_index_history": [*_NAMED, *_fields("days_seen", "days_observed", kind=LongType())],
    "index_usage_history": [*_NAMED, *_fields("index_name"), *_fields("days_with_reads", "days_with_writes", kind=LongType())],
    "physical": [*_NAMED, *_fields("index_name"), *_fields("fragmentation_pct", kind=DoubleType()), *_fields("pages", "forwarded_records", kind=LongType())],
    "stats": [*_NAMED, *_fields("stats_name"), *_fields("rows", "modification_counter", kind=LongType()), StructField("no_recompute", BooleanType())],
    "deprecated_columns": [*_NAMED, *_fields("column_name", "type_name")],
    "query_skew": [*_fields("query_hash"), *_fields("plan_count", "executions", "max_reads", kind=LongType()), *_fields("avg_reads", kind=DoubleType())],
}
BUNDLE = StructType([*[StructField(n, ArrayType(StructType(f))) for n, f in ROW_SETS.items()], StructField("scanned_database", StringType()), StructField("counters_since", StringType()), StructField("counter_age_secs", LongType())])


def bundles(files: DataFrame) -> DataFrame:
    """(path, bundle) of ``texts`` that are bundles: one JSON object; a text that isn't has a null bundle."""
    return files.select("path", F.from_json("text", BUNDLE).alias("bundle"))


def row_set(bundles: DataFrame, name: str) -> DataFrame:
    """The rows of one set of all bundles, with their path and object key: lower-case schema.table without brackets."""
    rows = bundles.select("path", F.explode(F.col("bundle").getField(name)).alias("x")).select("path", "x.*")
    if "table_name" not in rows.columns:
        return rows
    plain = lambda c: F.lower(F.translate(c, "[]\"", ""))
    return rows.withColumn("object_key", F.concat_ws(".", plain(F.col("schema_name")), plain(F.col("table_name"))))
