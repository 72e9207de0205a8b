"""Selection logs: usage upserts, debounced writes, clauses committed or cancelled, and time limits in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(events: DataFrame) -> DataFrame:
    """usage(lookup_key, value, count, last_selected_at) from (seq, lookup_key, value, ts).

    The last selection is the one processed last, by seq, not the latest by clock. Events with an empty key or value are none.
    """
    good = events.where((F.length("lookup_key") > 0) & (F.length("value") > 0))
    return good.groupBy("lookup_key", "value").agg(F.count("*").alias("count"), F.max_by("ts", "seq").alias("last_selected_at"))


def merged_usage(old: DataFrame, events: DataFrame) -> DataFrame:
    """old with the events added: counts sum up, and the new selection time replaces the old one."""
    new = upserted(events).withColumn("fresh", F.lit(1))
    both = old.select("lookup_key", "value", "count", "last_selected_at").withColumn("fresh", F.lit(0)).unionByName(new)
    return both.groupBy("lookup_key", "value").agg(F.sum("count").alias("count"), F.max_by("last_selected_at", "fresh").alias("last_selected_at"))


def debounced(events: DataFrame, key: str, gap: str) -> DataFrame:
    """(key, writes from, to, n): a write follows a key's events once none has come for `gap`."""
    w = F.session_window("ts", gap)
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("w")


def flushed(events: DataFrame, kind: Column) -> DataFrame:
    """(client_id, seq, commit_seq, lookup_key, value): choices that a commit writes out.

    kind is 'select', 'commit' or 'cancel'. A choice belongs to the next commit or cancel of its client; a cancel drops it,
    a choice made anew for the same slot replaces the former one, and choices nothing closes stay pending.
    """
    ahead = Window.partitionBy("client_id").orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    marked = events.withColumn("kind", kind)
    close = F.first(F.when(F.col("kind").isin("commit", "cancel"), F.struct("seq", "kind")), ignorenulls=True).over(ahead)
    chosen = marked.withColumn("close", close).where((F.col("kind") == "select") & (F.col("close.kind") == "commit"))
    latest = chosen.groupBy("client_id", F.col("close.seq").alias("commit_seq"), "slot").agg(F.max_by(F.struct("seq", "lookup_key", "value"), "seq").alias("x"))
    return latest.select("client_id", "commit_seq", "slot", "x.seq", "x.lookup_key", "x.value")


def within_limit(events: DataFrame, arms: Column, asks: Column, limit_s: float, once: bool) -> DataFrame:
    """asks that come at most limit_s seconds after the client's last arming (inclusive): (client_id, seq, armed_seq).

    once: the first ask after an arming uses it up, in time or not.
    """
    past = Window.partitionBy("client_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("arm", F.last(F.when(arms, F.struct("seq", "ts")), ignorenulls=True).over(past)).where(asks)
    if once:
        nth = F.row_number().over(Window.partitionBy("client_id", "arm.seq").orderBy("seq"))
        rows = rows.withColumn("nth", nth).where("nth = 1")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("arm.ts").cast("timestamp"))
    return rows.where(F.col("arm").isNotNull() & (micros <= int(limit_s * 1e6))).select("client_id", "seq", F.col("arm.seq").alias("armed_seq"))
