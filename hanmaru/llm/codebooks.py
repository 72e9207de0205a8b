"""Vector code compression: product codebooks fitted by whole-number rounds, searched with a kd-tree for each codebook.

Vectors are cut into equal parts, each with a codebook of its own. A codebook begins as that part of the rows of smallest
ids. In every round its entries go out as a kd-tree; each task finds the nearest entry of its rows' parts by branch and bound
and adds the parts up, and the tasks' sums, one row for each entry, move the entries. All is done in whole numbers, so the
order in which sums meet changes nothing. What goes out or comes back is bounded by parts times entries, whatever the rows.

Fixed cases: rows whose vector is null or holds null or non-finite components take no part; the length of the vectors is the
one of the first kept id (of smaller components, where that id repeats), rows of other lengths take no part, and neither does
any row if it isn't a multiple of the parts; rows without an id are coded but begin no entry; repeated rows count each;
components beyond 62 bits are cut off there, and errors at 64; fewer rows than entries give fewer entries; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .topk import quantised

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries of a leaf of the kd-tree.
LEAF = 8
#: Components below this have squared distances that fit 64 bits; beyond the largest they are cut off.
PLAIN, LARGEST, MOST = 1 << 28, 1 << 62, (1 << 63) - 1
#: Node of a kd-tree: box (low, high), then the entries of a leaf or two children.
Node = tuple


def kd_tree(entries: np.ndarray, ids: np.ndarray | None = None) -> Node:
    """Splits the entries in two at the middle of their widest component until few or equal ones are left."""
    ids = np.arange(len(entries)) if ids is None else ids
    own = entries[ids]
    low, high = own.min(axis=0), own.max(axis=0)
    wide = int(np.argmax(high - low))
    if len(ids) <= LEAF or low[wide] == high[wide]:
        return low, high, ids, None
    values = np.unique(own[:, wide])
    left = own[:, wide] < values[len(values) // 2]
    return low, high, kd_tree(entries, ids[left]), kd_tree(entries, ids[~left])


def nearest(x: np.ndarray, entries: np.ndarray, tree: Node) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) of each row; of equally near ones the lowest index.

    All rows go down the tree together, each to the nearer box first; a box is entered as long as it may hold an entry that is
    as near as the best so far, so entries of equal distance are all seen.
    """
    best, at = np.full(len(x), (1 << 200) if x.dtype == object else MOST, x.dtype), np.full(len(x), len(entries), np.int64)

    def apart(node: Node, rows: np.ndarray) -> np.ndarray:
        out = np.maximum(np.maximum(node[0] - x[rows], x[rows] - node[1]), 0)
        return (out * out).sum(axis=1)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node[3] is None:
            gap = x[rows][:, None, :] - entries[node[2]][None]
            d = (gap * gap).sum(axis=2)
            own = d.argmin(axis=1)  # indexes ascend in a leaf, so the first is the lowest
            d, own = d[np.arange(len(rows)), own], node[2][own]
            better = ((d < best[rows]) | ((d == best[rows]) & (own < at[rows]))).astype(bool)
            best[rows[better]], at[rows[better]] = d[better], own[better]
            return
        a, b = apart(node[2], rows), apart(node[3], rows)
        left = (a <= b).astype(bool)
        for near, far, mine, bound in ((node[2], node[3], left, b), (node[3], node[2], ~left, a)):
            visit(near, rows[mine])
            again = (bound[mine] <= best[rows[mine]]).astype(bool)
            visit(far, rows[mine][again])

    visit(tree, np.arange(len(x)))
    return at, best


def matrix(x: pa.Array, width: int) -> np.ndarray:
    """Lists of `width` whole numbers each as rows of 64 bits, or of Python's numbers where squares would leave those."""
    flat = np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(x), width)
    out = np.clip(flat, -LARGEST, LARGEST).astype(np.int64)
    return out.astype(object) if np.abs(flat).max(initial=0) >= PLAIN else out


def assign(x: np.ndarray, books: np.ndarray, trees: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), rows by parts."""
    wide = x.dtype == object or books.dtype == object
    x, books = (x.astype(object), books.astype(object)) if wide else (x, books)
    size = x.shape[1] // len(books)
    found = [nearest(x[:, p * size : (p + 1) * size], books[p], trees[p]) for p in range(len(books))]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def grown(books: np.ndarray) -> tuple[np.ndarray, list[Node]]:
    """Codebooks in the type they need, and the kd-tree of each."""
    books = books.astype(np.int64) if all(abs(int(v)) < PLAIN for v in books.ravel()) else books
    return books, [kd_tree(b) for b in books]


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after a round: each entry the floor of its parts' mean, unused ones as before."""
    parts, entries, size = books.shape
    sent = rows.sparkSession.sparkContext.broadcast(grown(books))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, trees = sent.value
        total, count = np.zeros((parts, entries, size), object), np.zeros((parts, entries), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(0), parts * size)
            codes, _ = assign(x, own, trees)
            exact = x.dtype != object and b.num_rows * PLAIN < 1 << 53  # then floats add whole numbers up without loss
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                for i in range(size):
                    c = x[:, p * size + i]
                    if exact:
                        total[p, :, i] += np.bincount(codes[:, p], c, entries).astype(np.int64).astype(object)
                    else:
                        add = np.zeros(entries, object)
                        np.add.at(add, codes[:, p], c.astype(object))
                        total[p, :, i] += add
        p, e = np.nonzero(count)
        tens = pa.array([Decimal(int(v)) for v in total[p, e].ravel()], pa.decimal128(38, 0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * size), tens)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), lists], names=["p", "e", "n", "t"])

    partial = rows.select("x").mapInArrow(sums, "p int, e int, n long, t array<decimal(38,0)>")
    summed = partial.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.get("t", F.lit(i))).alias(f"t{i}") for i in range(size)])
    out = books.astype(object)
    for r in summed.collect():  # at most a row for each entry
        out[r.p, r.e] = [int(r[f"t{i}"]) // r.n for i in range(size)]
    sent.destroy()
    return out


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 256) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row; code has two hex digits (or more, should entries ask
    for them) for each part."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), quantised(F.col("embedding"), scale).alias("x")).where("x is not null")
    first = kept.where("vec_id is not null").orderBy("vec_id", "x").select(F.size("x").alias("d")).first()
    width = first.d if first and first.d and first.d % parts == 0 else 0
    empty = spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    if not width:
        return empty
    rows = cut(kept.where(F.size("x") == width), "codes")
    seeds = rows.where("vec_id is not null").orderBy("vec_id", "x").limit(entries).select("x").toArrow()["x"].combine_chunks()
    seed = matrix(seeds, width).astype(object)
    books = np.stack([seed[:, p * (width // parts) : (p + 1) * (width // parts)] for p in range(parts)])
    for _ in range(rounds):
        books = moved(rows, books)
    sha = hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(grown(books))
    digits = max(2, len(f"{entries - 1:x}"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, trees = sent.value
        hexes = [f"{e:0{digits}x}" for e in range(own.shape[1])]
        for b in batches:
            if b.num_rows:
                codes, d = assign(matrix(b.column(2), width), own, trees)
                error = [min(MOST, int(v)) for v in d.sum(axis=1)] if d.dtype == object else d.sum(axis=1)
                text = ["".join([hexes[c] for c in row]) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    done = cut(rows.select("vec_id", "label", "x").mapInArrow(coded, f"vec_id long, label {label}, code string, error long"), "coded")
    # sums stand in a table of their own: Spark sends it out if it is small, and can split a hot label's join if it isn't
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(MOST))).cast("long")
    by_label = cut(done.groupBy(F.col("label").alias("label__")).agg(total.alias("label_error")), "label_errors")
    met = done.join(by_label, F.col("label").eqNullSafe(F.col("label__")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round(k: int, last: bool = False) -> str:
    """SQL of round k: assignments of every part, then the entries that follow."""
    near = f"""a{k} AS (SELECT rid, p.part, min(list_sum(list_transform(range(1, len(p.c) + 1), lambda i: (p.c[i] - e.c[i]) * (p.c[i] - e.c[i]))) * {ENTRIES} + entry) AS m
  FROM p JOIN e{k} e ON p.part = e.part GROUP BY rid, p.part)"""
    if last:
        return near
    return f"""{near},
t{k} AS (SELECT part, entry, i, CAST(sum(v) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM (
    SELECT p.part, CAST(m % {ENTRIES} AS BIGINT) AS entry, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS v FROM p JOIN a{k} a ON p.rid = a.rid AND p.part = a.part) GROUP BY ALL),
m{k} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM t{k} GROUP BY part, entry),
e{k + 1} AS (SELECT e.part, e.entry, coalesce(m.c, e.c) AS c FROM e{k} e LEFT JOIN m{k} m ON e.part = m.part AND e.entry = m.entry)"""


ORACLE_SQL = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT rid, part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] AS c FROM (SELECT rid, x, unnest(range(0, {PARTS})) AS part FROM v)),
e0 AS (SELECT part, rid - 1 AS entry, c FROM p WHERE rid <= {ENTRIES}),
{",".join(_round(k) for k in range(ROUNDS))},
{_round(ROUNDS, last=True)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS sha FROM e{ROUNDS}),
d AS (SELECT rid, string_agg(format('{{:02x}}', CAST(m % {ENTRIES} AS INT)), '' ORDER BY part) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM d JOIN v USING (rid), h
"""
