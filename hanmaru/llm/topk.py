"""Exact top-k search by inner product with vector-approximation files.

Equal vectors are one, with the few smallest ids of its rows that can matter. Beside the table of exact vectors stands a
file of cells: one byte a component, that says in which of CELLS equal stretches of that component's range it lies. A cell's
lower corner scores s with a query, and the vector itself s + slack at most, where slack depends on the query alone.

Queries go in batches of bounded size that are sent out. A first scan of the cells gives each query the vectors of the highest
bounds; their exact vectors are read, and the k-th exact score so far is a bound for the whole table. A second scan of the
cells finds all other vectors whose upper bound reaches it; only those are read, and then the k-th result is certain.

Fixed cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; only
vectors of as many components as the query are its candidates; a query's own id is never its candidate, however often it
occurs, and repeated candidate rows count one by one; a repeated query row with equal vector is asked once; ties go to the
smaller vec_id; components so large that a score leaves 64 bits have their score cut off at the end of the range; empty
vectors score 0; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

K, SCALE, CELLS = 5, 256, 256
#: Bytes of query vectors that are sent out at once, scores that a task holds at once, and how many times k vectors the first scan gives.
BATCH_BYTES, SCORES, AHEAD = 8_000_000, 2_000_000, 4
#: Sums of products below this are exact in float64.
EXACT_SUM = 2.0**52
FOUND = "query_id long, rank int, vec_id long, score long"


def quantised(x: Column, scale: int = SCALE) -> Column:
    """floor(scale * component), for vectors whose components are all finite; null for others."""
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))

    def whole(c: Column) -> Column:  # floor gives a long, which numbers that are whole anyway may not fit
        y = F.lit(scale) * c.cast("double")
        return F.when(F.abs(y) < EXACT_SUM, F.floor(y).cast("double")).otherwise(y)

    return F.when(x.isNotNull() & fine, F.transform(x, whole))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows; cut off at the ends of 64 bits."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < EXACT_SUM:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q, x, strict=True)]
    return np.array([max(-(2**63), min(2**63 - 1, w)) for w in whole], np.int64)


class Batch:
    """Queries of one length: their numbers, vectors, and what the cells' ranges make of them."""

    def __init__(self, number: np.ndarray, x: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        self.number, self.x = number, x
        with np.errstate(all="ignore"):
            self.base, self.step = x @ low, x * width
            self.rise = np.maximum(x, 0) @ width  # how far a vector of the cell may lie above its lower corner
            self.blur = 1e-9 * (np.abs(x) @ (np.abs(low) + CELLS * width)) + 1e-6

    def corners(self, cells: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, queries by vectors; where numbers run over, any score is possible."""
        with np.errstate(all="ignore"):
            s = self.step @ cells.T.astype(np.float64) + (self.base + self.rise + self.blur)[:, None]
        return np.where(np.isnan(s), np.inf, s)


def top_k(vectors: DataFrame, every: int, k: int = K, scale: int = SCALE, reads: list[int] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, its k highest scores.

    `reads`, if given, gets the number of exact vectors read for each batch of queries.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("x")).where("vec_id is not null and x is not null")
    # of equal vectors the k + 1 smallest ids matter (one may be the query's own), each as often as it occurs, k times at most
    counted = v.groupBy("x", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    few = counted.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    whole = cut(few.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("ids")).select(F.monotonically_increasing_id().alias("rid"), F.size("x").alias("d"), "x", "ids"), "vectors")
    queries = cut(v.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "x"]).select(F.monotonically_increasing_id().alias("q"), "vec_id", F.size("x").alias("d"), "x"), "queries")

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for d, x in by_length(b.column(0)):
                lo, hi = held.get(d, (np.full(d, np.inf), np.full(d, -np.inf)))
                held[d] = np.minimum(lo, x.min(axis=0)), np.maximum(hi, x.max(axis=0))
        for d, (lo, hi) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(lo), pa.array(hi)], names=["d", "i", "lo", "hi"])

    asked = {r.d: r["count"] for r in queries.groupBy("d").count().collect()}
    ranges = whole.select("x").mapInArrow(extent, "d int, i int, lo double, hi double").groupBy("d", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    edges: dict[int, tuple[np.ndarray, np.ndarray]] = {d: (np.zeros(d), np.zeros(d)) for d in asked}
    for r in ranges.toLocalIterator():
        if r.d in edges:
            with np.errstate(all="ignore"):
                edges[r.d][0][r.i], edges[r.d][1][r.i] = r.lo, r.hi / CELLS - r.lo / CELLS

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column(0).to_numpy(zero_copy_only=False)
            d_of = np.diff(b.column(1).offsets.to_numpy())
            for d, x in by_length(b.column(1)):
                low, width = edges[d]
                with np.errstate(all="ignore"):
                    c = np.nan_to_num((x - low) / np.where(width > 0, width, 1.0))
                c = np.clip(c, 0, CELLS - 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(rid[d_of == d]), pa.array(np.full(len(c), d, np.int32)), pa.array([r.tobytes() for r in c], pa.binary())], names=["rid", "d", "cells"])

    cells = cut(whole.where(F.col("d").isin(list(asked))).select("rid", "x").mapInArrow(cells_of, "rid long, d int, cells binary"), "cells")

    def scan(sent, bound) -> DataFrame:
        """(q, rid): each task's AHEAD * k + 1 highest upper bounds of each query, or all that reach the bound."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batch, least, most = Batch(*sent.value), bound.value if bound else None, AHEAD * k + 1
            n = len(batch.number)
            held_s, held_r = np.full((n, 0), -np.inf), np.zeros((n, 0), np.int64)
            for b in batches:
                rid = b.column(0).to_numpy(zero_copy_only=False)
                code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(rid), batch.x.shape[1])
                size = max(1, SCORES // n)
                for a in range(0, len(rid), size):
                    s = batch.corners(code[a : a + size])
                    own = rid[a : a + size]
                    if least is not None:
                        q, at = np.nonzero(s >= least[:, None])
                        yield pa.RecordBatch.from_arrays([pa.array(batch.number[q]), pa.array(own[at]), pa.array(s[q, at])], names=["q", "rid", "s"])
                        continue
                    s, r = np.hstack((held_s, s)), np.hstack((held_r, np.broadcast_to(own, s.shape)))
                    if s.shape[1] > most:
                        top = np.argpartition(-s, most - 1, axis=1)[:, :most]
                        s, r = np.take_along_axis(s, top, 1), np.take_along_axis(r, top, 1)
                    held_s, held_r = s, r
            if least is None and held_s.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.number, held_s.shape[1])), pa.array(held_r.ravel()), pa.array(held_s.ravel())], names=["q", "rid", "s"])

        return cells.where(F.col("d") == sent.value[1].shape[1]).select("rid", "cells").mapInArrow(run, "q long, rid long, s double")

    def read(pairs: DataFrame, sent) -> DataFrame:
        """(q, vec_id, score): exact scores of the pairs (q, rid), with the ids of equal vectors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batch = Batch(*sent.value)
            for b in batches:
                if b.num_rows:
                    q = b.column(0).to_numpy(zero_copy_only=False)
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(q), batch.x.shape[1])
                    score = exact_scores(batch.x[np.searchsorted(batch.number, q)], x)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score)], names=["q", "ids", "score"])

        got = pairs.join(whole.select("rid", "x", "ids"), "rid").select("q", "x", "ids").mapInArrow(run, "q long, ids array<struct<vec_id:bigint,n:bigint>>, score long")
        each = got.select("q", "score", F.explode("ids").alias("i")).select("q", "score", "i.vec_id", "i.n").join(queries.select("q", F.col("vec_id").alias("query_id")), "q").where("vec_id <> query_id")
        return each.select("q", "query_id", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).drop("col")

    def best(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= k)

    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/topk-{uuid.uuid4().hex}"
    spark.createDataFrame([], FOUND).write.parquet(path)
    for d, n in sorted(asked.items()):
        size = max(1, BATCH_BYTES // (8 * max(1, d)))
        parts = -(-n // size)
        for part in range(parts):
            mine = queries.where((F.col("d") == d) & (F.pmod(F.xxhash64("q"), F.lit(parts)) == part)).select("q", "x").toArrow().sort_by("q").combine_chunks()
            number = mine["q"].to_numpy().astype(np.int64)
            if not len(number):
                continue
            x = np.asarray(mine["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(number), d)
            sent = spark.sparkContext.broadcast((number, x, *edges[d]))  # plain arrays: executors may not know this package's classes
            order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "rid"))
            ahead = scan(sent, None).withColumn("nth", order).where(F.col("nth") <= AHEAD * k + 1).select("q", "rid")
            first = best(read(ahead, sent)).where(F.col("rank") == k).select("q", "score").toArrow()
            least = np.full(len(number), -np.inf)
            # an upper bound may lie a little below an exact score of 64 bits, as floats are coarse there
            least[np.searchsorted(number, first["q"].to_numpy())] = first["score"].to_numpy().astype(np.float64) * (1 - 1e-12 * np.sign(first["score"].to_numpy())) - 1e-6
            bound = spark.sparkContext.broadcast(least)
            pairs = cut(scan(sent, bound).select("q", "rid"), "candidates")
            if reads is not None:
                reads.append(pairs.count())
            # each batch's rows are written, so that what was sent out for it can go
            best(read(pairs, sent)).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
            sent.destroy()
            bound.destroy()
    return spark.read.schema(FOUND).parquet(path)


def by_length(x: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The lists of each length as a matrix."""
    d_of = np.diff(x.offsets.to_numpy())
    for d in np.unique(d_of).tolist():
        rows = x.filter(pa.array(d_of == d))
        yield d, np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), d)


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(q.x) = len(v.x)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
