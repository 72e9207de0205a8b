"""Streaming usage: choices of sessions merged into a usage table of hash buckets, of which a micro-batch rewrites those it meets.

A manifest says for each bucket which batch wrote it last. A batch reads the buckets of its keys, merges them with its
choices, writes them under its own number, and publishes the next manifest; readers see the table before or after. A batch
that runs again finds its manifest and changes nothing; one that was lost before it published overwrites its own files. Each
bucket is one file a version, so nothing has to be compacted; `vacuum` removes the files that no kept manifest names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.usage import merged_usage, upserted
from ..sources import versions

USAGE = "lookup_key string, value string, count long, last_selected_at timestamp"
BUCKETS, KEEP = 64, 3


def _manifests(path: str) -> str:
    return f"{path}/manifests"


def _state(spark: SparkSession, path: str, before: int | None = None) -> dict:
    """The newest manifest, or the newest before a batch."""
    found = [v for v in versions.published(spark, _manifests(path)) if before is None or v < before]
    return versions.content(spark, _manifests(path), max(found)) if found else {"buckets": {}, "size": None}


def _files(path: str, buckets: dict[str, int]) -> list[str]:
    return [f"{path}/data/{batch:020d}/bucket={b}" for b, batch in buckets.items()]


def _rows(spark: SparkSession, path: str, buckets: dict[str, int]) -> DataFrame:
    return spark.read.schema(USAGE).parquet(*_files(path, buckets)) if buckets else spark.createDataFrame([], USAGE)


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The table's newest version, or the newest before a batch; empty if there is none."""
    return _rows(spark, path, _state(spark, path, before)["buckets"])


def writer(path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over (seq, lookup_key, value, ts). The number of buckets is the one the table began with."""

    def write(events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        if batch in versions.published(spark, _manifests(path)):
            return  # this batch is in the table
        state = _state(spark, path, batch)
        size = state["size"] or buckets
        bucket = F.pmod(F.xxhash64("lookup_key", "value"), F.lit(size)).alias("bucket")
        met = [str(r.bucket) for r in upserted(events).select(bucket).distinct().collect()]  # at most `size` numbers
        if met:
            old = {b: v for b, v in state["buckets"].items() if b in met}
            merged = merged_usage(_rows(spark, path, old), events).select("*", bucket)
            one_file = merged.repartition(min(size, len(met)), "bucket").sortWithinPartitions("bucket", "lookup_key", "value")
            one_file.write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/data/{batch:020d}")
        versions.publish(spark, _manifests(path), batch, {"size": size, "buckets": state["buckets"] | dict.fromkeys(met, batch)})

    return write


def vacuum(spark: SparkSession, path: str, keep: int = KEEP) -> list[str]:
    """Keeps the newest `keep` manifests and the files that they name; returns the names of the buckets removed."""
    found = sorted(versions.published(spark, _manifests(path)))
    used = {f for v in found[-keep:] for f in _files(path, versions.content(spark, _manifests(path), v)["buckets"])}
    gone = []
    for v in versions.names(spark, f"{path}/data"):
        if not found or int(v) > found[-1]:
            continue  # a batch under way
        every = [f"{path}/data/{v}/{b}" for b in versions.names(spark, f"{path}/data/{v}") if b.startswith("bucket=")]
        if all(f not in used for f in every):
            versions.remove(spark, f"{path}/data/{v}")
            gone += every
            continue
        for f in every:
            if f not in used:
                versions.remove(spark, f)
                gone.append(f)
    for v in found[:-keep]:
        versions.remove(spark, f"{_manifests(path)}/{v:020d}.json")
    return gone
