"""Streams of choices give the rows of the batch operators, whatever the micro-batches."""

import pytest
from pyspark.sql import functions as F

from hanmaru.operators import usage as U
from hanmaru.plans import tables as T
from hanmaru.streaming import choices as C


def parts(spark, sf_dir, tmp_path, n=3):
    events = T.events(spark, sf_dir).cache()
    edges = [r.seq for r in events.orderBy("seq").collect()][:: -(-events.count() // n)] + [1 << 60]
    for lo, hi in zip(edges, edges[1:], strict=False):
        events.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def rows(df):
    return sorted(map(str, df.collect()))


def test_flushes(spark, sf_dir, tmp_path):
    events, stream = parts(spark, sf_dir, tmp_path)
    got = C.run_through(spark, C.flushed(stream), "t")
    assert rows(got) == rows(U.flushed(events, F.col("kind")).select(*got.columns))


@pytest.mark.parametrize("once", [True, False])
def test_limits(spark, sf_dir, tmp_path, once):
    events, stream = parts(spark, sf_dir, tmp_path)
    arms, asks = F.col("slot") == "signup", F.col("slot") == "view"
    assert rows(C.run_through(spark, C.within_limit(stream, arms, asks, 8 * 3600, once), "t")) == rows(U.within_limit(events, arms, asks, 8 * 3600, once))


def test_debounced_writes_come_with_the_watermark(spark, sf_dir, tmp_path):
    events, stream = parts(spark, sf_dir, tmp_path)
    got = C.run_through(spark, C.debounced_stream(stream, "client_id", "6 hours", "1 hour"), "t")
    due = events.agg(F.max("ts")).first()[0]
    every = U.debounced(events.withColumn("ts", F.col("ts").cast("timestamp")), "client_id", "6 hours")
    assert rows(got) == rows(every.where(F.col("last_ts") + F.expr("interval 7 hours") <= F.lit(due))) and 0 < got.count() < every.count()
