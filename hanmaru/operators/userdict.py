"""The user's own entries: upserts, renames, deletes, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfc_key

KEY = ("reading", "value")


COLUMNS = ["id", "reading", "value", "comment", "created_at", "updated_at"]
#: Entries that were there before come before all changes.
BEFORE = -(1 << 40)


def _applied(entries: DataFrame, changes: DataFrame, place: Column) -> DataFrame:
    """Entries after the changes, with `seq`, the place of the first row that made them.

    Two aggregates by key, joined on it: a key's last delete, and what its later saves make.
    """
    old = entries.select(*COLUMNS, place.cast("long").alias("seq"), F.lit("save").alias("op"))
    new = changes.where((F.col("op") == "delete") | ((F.length("reading") > 0) & (F.length("value") > 0))).select(*COLUMNS, F.col("seq").cast("long").alias("seq"), "op")
    both = old.unionByName(new).withColumn("rk", nfc_key(F.col("reading"))).withColumn("vk", nfc_key(F.col("value")))
    gone = both.groupBy("rk", "vk").agg(F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("gone"))
    live = both.join(gone, ["rk", "vk"]).where((F.col("op") == "save") & (F.col("seq") > F.coalesce("gone", F.lit(2 * BEFORE))))
    first, last = F.struct("id", "created_at", "reading", "value"), F.struct("comment", "updated_at")
    return (
        live.groupBy("rk", "vk").agg(F.min_by(first, "seq").alias("f"), F.max_by(last, "seq").alias("l"), F.min("seq").alias("seq"))
        .select("f.id", "f.reading", "f.value", "l.comment", "f.created_at", "l.updated_at", "seq")
    )


def applied(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """entries(id, reading, value, comment, created_at, updated_at) after changes(seq, op, ...) in order of seq.

    op 'save' keeps the id and creation time of an entry with the same reading and value and takes comment and update time;
    'delete' removes it, and means nothing if there is none. Saves without reading or value are ignored. A save after a
    delete starts anew.
    """
    return _applied(entries, changes, F.lit(-1)).drop("seq")


def applied_in_order(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """`applied` for entries with pos: those there before stand first, in their order, then new ones in order of seq."""
    return _applied(entries, changes, F.col("pos") + BEFORE).withColumnRenamed("seq", "pos")


def renames(edits: DataFrame) -> DataFrame:
    """Changes of edits(seq, old_reading, old_value, ...): a new reading or value deletes the old key, then saves the new one."""
    cols = ["id", "comment", "created_at", "updated_at"]
    moved = (F.col("old_reading") != F.col("reading")) | (F.col("old_value") != F.col("value"))
    drop = edits.where(moved).select(*cols, F.col("old_reading").alias("reading"), F.col("old_value").alias("value"), (F.col("seq") * 2).alias("seq"), F.lit("delete").alias("op"))
    return drop.unionByName(edits.select(*cols, "reading", "value", (F.col("seq") * 2 + 1).alias("seq"), F.lit("save").alias("op")))


def matching(entries: DataFrame, query: Column) -> DataFrame:
    """Entries whose reading or value contains the trimmed query, in any case; an empty query matches all."""
    q = F.lower(F.trim(query))
    return entries.where((q == "") | F.contains(F.lower("reading"), q) | F.contains(F.lower("value"), q))
