"""Choices, commits and time limits as keyed state of a stream: the rows of `operators.usage`, one micro-batch after the other.

A batch window over all of a client's events isn't possible on a stream; here a client's state is the open choice of each of
its slots, or its last arming. Arrival order is the only order: within a micro-batch rows are taken by seq.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.usage import debounced
from ..sources.versions import shared_folder

FLUSHED = "client_id long, commit_seq long, slot string, seq long, lookup_key string, value string"
MATCHED = "client_id long, seq long, armed_seq long"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[Any]:
    yield from pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples(index=False)


class Flushes(StatefulProcessor):
    """A map of the open choices by slot. A commit writes them out, a cancel drops them."""

    def init(self, handle: Any) -> None:
        self.open = handle.getMapState("open", "slot string", "seq long, lookup_key string, value string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        before, out = dict(held), []
        for e in _in_order(rows):
            if e.kind == "select":
                held[e.slot] = int(e.seq), e.lookup_key, e.value
            elif e.kind in ("commit", "cancel"):
                if e.kind == "commit":
                    out += [(key[0], e.seq, slot, *choice) for slot, choice in held.items()]
                held = {}
        for slot in before.keys() - held.keys():
            self.open.removeKey((slot,))
        for slot, choice in held.items():
            if before.get(slot) != choice:
                self.open.updateValue((slot,), choice)
        yield pd.DataFrame(out, columns=_names(FLUSHED))

    def close(self) -> None:
        pass


class Limits(StatefulProcessor):
    """The last arming, and whether an ask has used it up."""

    def __init__(self, micros: int, once: bool) -> None:
        self.micros, self.once = micros, once

    def init(self, handle: Any) -> None:
        self.armed = handle.getValueState("armed", "seq long, at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        armed, out = self.armed.get() if self.armed.exists() else None, []
        for e in _in_order(rows):
            if e.asks and armed is not None:
                if e.at - armed[1] <= self.micros:
                    out.append((key[0], e.seq, armed[0]))
                armed = None if self.once else armed
            if e.arms:
                armed = int(e.seq), int(e.at)
        if armed is None:
            self.armed.clear()
        else:
            self.armed.update(armed)
        yield pd.DataFrame(out, columns=_names(MATCHED))

    def close(self) -> None:
        pass


def flushed(events: DataFrame) -> DataFrame:
    """`operators.usage.flushed` of a stream (client_id, seq, kind, slot, lookup_key, value)."""
    rows = events.select(F.col("client_id").cast("long").alias("client_id"), F.col("seq").cast("long").alias("seq"), "kind", "slot", "lookup_key", "value")
    return rows.groupBy("client_id").transformWithStateInPandas(Flushes(), FLUSHED, "Append", "None")


def within_limit(events: DataFrame, arms: Column, asks: Column, limit_s: float, once: bool) -> DataFrame:
    """`operators.usage.within_limit` of a stream (client_id, seq, ts)."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    rows = events.select(F.col("client_id").cast("long").alias("client_id"), F.col("seq").cast("long").alias("seq"), at, arms.alias("arms"), asks.alias("asks"))
    return rows.groupBy("client_id").transformWithStateInPandas(Limits(int(limit_s * 1e6), once), MATCHED, "Append", "None")


def debounced_stream(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """`operators.usage.debounced` of a stream: a write comes once the watermark, `late` behind the latest event, says that no
    event can join it any more."""
    return debounced(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), key, gap)


def run_through(spark: SparkSession, out: DataFrame, name: str) -> DataFrame:
    """All rows that a stream over what its source holds now gives, as a table in the shared folder."""
    import uuid

    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        q = out.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start(f"{folder}/rows")
        q.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")
