"""Sources and sinks: dictionary files, frequency files, and versioned JSON stores.

A dictionary file is tab-separated: reading, value, comment, one entry a line in order. A frequency file has `key:number`
lines; the first colon splits, malformed lines are skipped. A store is one JSON document {"version", "entries"}; a missing or
malformed one is empty, its version isn't checked, and of entries with one key the last counts. Lines end in LF only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VERSION = 1
USAGE_ENTRY = "struct<lookupKey:string,value:string,count:bigint,lastSelectedAt:string>"
USER_ENTRY = "struct<id:string,reading:string,value:string,comment:string,createdAt:string,updatedAt:string>"
TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def frequency(rows: DataFrame) -> DataFrame:
    """(value, freq) of the well-formed lines in column value."""
    ok = r"^([^:]*):([+-]?[0-9]+)\z"
    number = F.expr(r"try_cast(regexp_extract(value, '^[^:]*:([+-]?[0-9]+)\\z', 1) AS BIGINT)")
    return rows.where(F.col("value").rlike(ok)).select(F.regexp_extract("value", ok, 1).alias("value"), number.alias("freq")).where("freq is not null")


def load_frequency(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files' rows; a file that can't be read is skipped."""
    out = frequency(spark.createDataFrame([], "value string"))
    for p in paths:
        try:
            out = out.unionByName(frequency(lines(spark, p)))
        except AnalysisException:
            continue
    return out


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """dictionary(pos, reading, value, comment); pos follows the order of files and lines."""
    rows = lines(spark, path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    part = F.split("value", "\t", -1)
    # lines of one block are numbered in their order, blocks in any: sorted, numbers rise with files and lines
    ordered = rows.where(F.size(part) >= 2).select("file", "block", "line", part[0].alias("reading"), part[1].alias("value"), F.coalesce(F.get(part, 2), F.lit("")).alias("comment"))
    return ordered.orderBy("file", "block", "line").select(F.monotonically_increasing_id().alias("pos"), "reading", "value", "comment")


def _entries(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """A store's entries with their place."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        text = spark.createDataFrame([], "value string")
    parsed = text.select(F.from_json("value", f"version int, entries array<{entry}>").alias("s"))
    return parsed.select(F.posexplode("s.entries").alias("pos", "e")).select(F.col("pos").cast("long").alias("pos"), "e.*")


def load_usage(spark: SparkSession, path: str) -> DataFrame:
    """usage(lookup_key, value, count, last_selected_at)."""
    rows = _entries(spark, path, USAGE_ENTRY)
    last = rows.groupBy(F.col("lookupKey").alias("lookup_key"), "value").agg(F.max_by(F.struct("count", "lastSelectedAt"), "pos").alias("x"))
    return last.select("lookup_key", "value", "x.count", F.to_timestamp("x.lastSelectedAt", TIME).alias("last_selected_at"))


def load_user_entries(spark: SparkSession, path: str) -> DataFrame:
    rows = _entries(spark, path, USER_ENTRY)
    return rows.select("pos", "id", "reading", "value", "comment", F.to_timestamp("createdAt", TIME).alias("created_at"), F.to_timestamp("updatedAt", TIME).alias("updated_at"))


def _document(entries: DataFrame, order: list[str]) -> DataFrame:
    """One row with the store's JSON document. A store is one file that one program reads, so its entries meet in one row."""
    key = F.struct(*[F.col(c) for c in order], F.col("e"))
    ordered = F.transform(F.array_sort(F.collect_list(key)), lambda x: x["e"])
    return entries.agg(F.to_json(F.struct(ordered.alias("entries"), F.lit(VERSION).alias("version"))).alias("value"))


def usage_document(usage: DataFrame) -> DataFrame:
    """The usage store's document, entries by key and value."""
    e = F.struct("count", F.date_format("last_selected_at", TIME).alias("lastSelectedAt"), F.col("lookup_key").alias("lookupKey"), "value")
    return _document(usage.select("lookup_key", "value", e.alias("e")), ["lookup_key", "value"])


def user_document(entries: DataFrame) -> DataFrame:
    """The user dictionary's document, entries in order of pos."""
    e = F.struct("comment", F.date_format("created_at", TIME).alias("createdAt"), "id", "reading", F.date_format("updated_at", TIME).alias("updatedAt"), "value")
    return _document(entries.select("pos", e.alias("e")), ["pos"])


def save(document: DataFrame, path: str) -> None:
    """Writes the document into the folder `path`, replacing the one there in one step: readers see the old one or the new one."""
    spark = document.sparkSession
    fresh = f"{path}/_new-{uuid.uuid4().hex}"  # readers skip names that start so
    document.coalesce(1).write.text(fresh)
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = fs_path(path).getFileSystem(conf)
    part = next(s.getPath() for s in files.listStatus(fs_path(fresh)) if s.getPath().getName().startswith("part-"))
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(part, files.makeQualified(fs_path(f"{path}/document.json")), overwrite)
    files.delete(fs_path(fresh), True)
