"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: \x20 and \x09 to \x0D.
WS = r"[\x20\x09-\x0D]+"
#: Bytes of text that are worked on at once.
SLICE = 4_000_000
#: Multiplier of the rolling hashes.
PRIME = 0x9E3779B97F4A7C15


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local master (as in tests)
    gets a folder in /tmp; a cluster's executors wouldn't share that, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints/hanmaru"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words in text; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, WS), "")), F.lit(0)).cast("long")


def fold_ascii(text: bytes) -> bytes:
    """Lower-cases A-Z and leaves all other bytes alone."""
    return text.lower()  # bytes.lower() touches ASCII letters only


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: (a long, b long) links to (node long, root long), root the smallest node.

    Alternates large-star and small-star steps until a round moves no link, which takes some log2(nodes)**2 rounds at most. Each step
    deals the links out by node once; its grouped minimum and the equi-join with it both use that shuffle, so that a round is three
    stages with a small plan: a driver keeps what it knows of every task and plan. Links never grow in number, and each round's go to
    the shared folder. As the minimum stands in the same plan, AQE doesn't split that join where one node has very many links.
    Nodes without links don't appear. Self links and nulls are ignored.
    """
    pairs = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links"
    )
    while True:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        ).repartition("u")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # m is u at most; a plain v > u would be pushed below the shuffle, which then couldn't serve the minimum
        up = both.join(low.hint("merge"), "u").where(F.col("v") > F.greatest("u", "m"))
        large = up.select(F.col("v").alias("hi"), F.col("m").alias("lo"), (F.col("m") != F.col("u")).alias("moved")).repartition("hi")
        large = large.groupBy("hi", "lo").agg(F.max("moved").alias("moved"))
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        other = F.col("lo") != F.col("m")
        small = large.join(down.hint("merge"), "hi").select(F.when(other, F.col("lo")).otherwise(F.col("hi")).alias("hi"), F.col("m").alias("lo"), (F.col("moved") | other).alias("moved"))
        pairs = cut(small, "links")
        if pairs.where("moved").isEmpty():  # every hi has one lo, which is nobody's hi
            break
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


def marked(rows: DataFrame, ids: DataFrame, key: Column, most_bits: int = 27) -> DataFrame:
    """rows with a column maybe__: false where the key is not among the ids' column `id` for certain.

    A bitmap of hash slots is sent out, some 16 for each id but at most 2**most_bits (16 MB), so its size is bounded; where ids
    are more than it can tell apart, more rows say maybe. A join has the last word.
    """
    bits = min(most_bits, max(16, (16 * max(1, ids.count()) - 1).bit_length()))
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << bits))
    maps = ids.select(slot(F.col("id")).alias("s")).groupBy(F.shiftright("s", 15).alias("page__")).agg(F.bitmap_construct_agg(F.pmod(F.col("s"), F.lit(1 << 15))).alias("bitmap__"))
    test = "coalesce((cast(conv(hex(substring(bitmap__, cast(pmod(s__, 32768) as int) div 8 + 1, 1)), 16, 10) as int) >> cast(pmod(s__, 8) as int)) & 1 = 1, false)"
    some = rows.withColumn("s__", slot(key)).join(F.broadcast(maps), F.shiftright("s__", 15) == F.col("page__"), "left")
    return some.select(*rows.columns, F.expr(test).alias("maybe__"))


def likely_in(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose long `key` isn't among ids; none that belongs is lost, and a join has the last word."""
    return marked(rows, ids.select(F.col(key).alias("id")), F.col(key)).where("maybe__").drop("maybe__")


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each group: of the least doc_id (null last), then of the least hash of the text.

    found has a row for each row of docs: doc_id, h (xxhash64 of the text) and grp, which equal rows share. Only rows that go
    or repeat, and a few more, are shuffled with their texts.
    """
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("h"))
    first = found.groupBy("grp").agg(F.min(rank).alias("first"), F.count("*").alias("size")).where("size > 1").drop("size")
    keys = found.join(first, "grp").groupBy("doc_id", "h").agg(F.max((rank == F.col("first")).cast("int")).alias("keep__"), F.count("*").alias("n"))
    touched = cut(keys.where("keep__ = 0 or n > 1").select(F.col("doc_id").alias("id__"), F.col("h").alias("h__"), "keep__"), "repeats")
    both = lambda i, h: F.xxhash64(F.coalesce(i, F.lit(-1).cast("long")), h)
    # docs travel as one column, so their names can't clash with those here
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    split = marked(rows, touched.select(both(F.col("id__"), F.col("h__")).alias("id")), both(F.col("doc_id"), F.col("h")))
    met = split.where("maybe__").join(touched, F.col("doc_id").eqNullSafe(F.col("id__")) & (F.col("h") == F.col("h__")), "left")
    lone = met.where("keep__ is null").select("doc.*")
    one = met.where("keep__ = 1").dropDuplicates(["doc_id", "h"]).select("doc.*")
    return split.where("not maybe__").select("doc.*").unionByName(lone).unionByName(one)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no order."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts one after the other, number of words of each text)."""
    import pyarrow.compute as pc

    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(trimmed)
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False).astype(bool)
    words = lists.flatten()
    if blank.any():  # a text without words is one empty word until here
        words = words.filter(pa.array(~np.repeat(blank, sizes)))
        sizes[blank] = 0
    return words, sizes


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    from xxhash import xxh64_intdigest

    d = words.dictionary_encode()
    of = np.fromiter((xxh64_intdigest(w, 1) for w in d.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(d.dictionary))
    return of[d.indices.to_numpy()] if len(d) else np.zeros(0, np.uint64)


def span_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span first..end (end exclusive) of the elements that h hashes; equal spans hash alike wherever they stand."""
    n = len(h)
    power = np.full(n + 1, PRIME, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(h * power[:n])))  # a plain 0 would turn all into floats
    back = np.full(n + 1, pow(PRIME, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    return mixed((total[end] - total[first]) * back[first] + end.astype(np.uint64) - first.astype(np.uint64))


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `size` bytes of the column, one row at least."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to
