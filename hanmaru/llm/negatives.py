"""Hard-negative mining: windows of inner products searched as annuli in vantage-point trees over norm-augmented vectors.

With one more component, sqrt(M**2 - |x|**2) for a row and 0 for an anchor, M the largest norm, an inner product s becomes the
distance sqrt(|anchor|**2 + M**2 - 2 s): a window of scores is an annulus around the anchor, and higher scores lie nearer.

The top of the tree is grown on a bounded sample and splits space into regions; every row goes to its region, regions of many
rows are dealt over several shards, and each shard's task grows the rest of the tree over all its rows. Anchors travel to the
shards whose region meets their annulus, first to the nearest region alone, then to the others that may still hold something
better than the k-th row found there. In a shard a queue yields an anchor's nearest leaves, and from the bound found there a
block of anchors goes down the tree together; each leaves out the nodes that can't hold a row of its annulus that belongs
among its first k. Anchors of a shard that very many meet are dealt over copies of it.
Positives are found in the same way, with the window of all scores and rows of the anchor's own label.

Only the top of the tree (LEAVES vectors) and counts of rows by region come to the driver. Scores are whole numbers, computed
from the vectors themselves, so bounds may err by the rounding of floats, for which there is room (SLACK), and results don't.

Fixed cases: rows without id, label or vector, or with a null or non-finite component, take no part; only rows of as many
components as the anchor are compared with it; a row that repeats in id, label and vector counts once, and an anchor is never
its own partner, be its id repeated with another label or vector; ties go to the smaller id; an anchor whose positive score is
below zero has an empty window; scores beyond 64 bits are cut off there; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .topk import EXACT_SUM, SCALE, exact_scores, quantised

EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: Percent of the positive's score between which a negative's lies.
LOW, HIGH = 50, 95
#: Rows of a shard, regions at most, rows of the sample that the top of the tree is grown on, rows of a tree's leaf.
SHARD_ROWS, LEAVES, SAMPLE, LEAF = 20_000, 512, 4096, 96
#: Anchors that one copy of a shard serves, and that are searched together.
ANCHORS, BLOCK = 20_000, 256
#: Leaves that a search reads for one anchor alone, and rows of a leaf that are scored at a time.
FIRST, PIECE = 2, 2048
SLACK = 1e-6
TOP = (1 << 63) - 1
WINDOWS = "array<struct<id:bigint,hi:bigint,lo:bigint>>"


def grown(x: np.ndarray, extra: np.ndarray, leaf: int, deepest: int = 64) -> tuple[list, np.ndarray, list]:
    """A vantage-point tree: (nodes, order, leaves). A node is (vantage row, least and largest distance inside and outside,
    child inside, child outside), a child below 0 the leaf ~child, and a leaf a stretch (first, end) of order."""
    nodes: list = []
    leaves: list = []
    order = np.arange(len(x))

    def grow(a: int, z: int, depth: int) -> int:
        own = order[a:z]
        if z - a > leaf and depth < deepest:
            v = own[len(own) // 2]
            with np.errstate(all="ignore"):
                d = np.nan_to_num(np.sqrt(((x[own] - x[v]) ** 2).sum(axis=1) + (extra[own] - extra[v]) ** 2))
            rank = np.argsort(d, kind="stable")
            half = len(own) // 2
            if d[rank[0]] < d[rank[-1]]:
                while half > 1 and d[rank[half - 1]] == d[rank[half]]:  # equal distances stay together
                    half -= 1
                if d[rank[half - 1]] == d[rank[half]]:
                    half = int(np.searchsorted(d[rank], d[rank[half]], side="right"))
                order[a:z], d = own[rank], d[rank]
                at = len(nodes)
                nodes.append(None)
                inside, outside = grow(a, a + half, depth + 1), grow(a + half, z, depth + 1)
                nodes[at] = (int(v), float(d[0]), float(d[half - 1]), float(d[half]), float(d[-1]), inside, outside)
                return at
        leaves.append((a, z))
        return ~(len(leaves) - 1)

    grow(0, len(x), 0)
    return nodes, order, leaves


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt(np.maximum(np.nan_to_num(most - (x * x).sum(axis=1)), 0.0))


def span(queries: np.ndarray, most: float) -> np.ndarray:
    """|anchor|**2 + M**2 of each anchor."""
    with np.errstate(all="ignore"):
        return np.nan_to_num((queries * queries).sum(axis=1) + most)


def far(total, score):
    """Distance at which a row of this score lies from an anchor."""
    return np.sqrt(np.maximum(np.asarray(total) - 2.0 * np.asarray(score, np.float64), 0.0))


def to_vantages(queries: np.ndarray, total: np.ndarray, vantages: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        d = np.sqrt(np.maximum(total[:, None] - 2.0 * (queries @ vantages.T), 0.0))
    return d


class Shard:
    """The rows of one shard, in the order of their tree."""

    def __init__(self, x: np.ndarray, label: np.ndarray, ids: list[list[int]], most: float) -> None:
        self.nodes, order, self.leaves = grown(x, augmented(x, most), LEAF)
        self.x, self.label, self.ids, self.most = x[order], label[order], [ids[i] for i in order.tolist()], most
        self.vantages = x[[n[0] for n in self.nodes]] if self.nodes else x[:0]
        self.largest = float(np.abs(x).max(initial=0))

    def search(self, queries: np.ndarray, own: list[int], label: list[int], windows: list[list[tuple[int, int, int]]], k: int, same: bool) -> Iterator[tuple[int, int, int, int]]:
        """(query, window, score, id): the first k rows of each window (id, hi, lo) of each query.

        A query looks into its FIRST nearest leaves by itself, which gives it a bound. Then all queries go down the tree
        together, so that a leaf's scores are one product for all that may still find a row in it.
        """
        total = span(queries, self.most)
        dv = np.where(np.isfinite(d := to_vantages(queries, total, self.vantages)), d, np.nan)
        plain = self.largest * np.abs(queries).max(initial=0) * max(1, queries.shape[1]) < EXACT_SUM
        windows = [[w for w in ws if w[2] <= w[1]] for ws in windows]
        slack = SLACK * (np.sqrt(total) + 1)
        best: list[list[list[tuple[int, int]]]] = [[[] for _ in ws] for ws in windows]  # (-score, id), first ones first
        need = [[lo for _, _, lo in ws] for ws in windows]
        labels = np.asarray(label)
        least = np.array([min(x, default=0) for x in need], np.int64)
        most = np.array([max((hi for _, hi, _ in ws), default=0) for ws in windows], np.int64)
        near, edge = far(total, most) - slack, far(total, least) + slack
        seen = np.zeros((len(queries), len(self.leaves)), bool)

        def take(q: int, rows: list[int], scores: list[int]) -> None:
            changed = False
            for i, score in zip(rows, scores, strict=True):
                for w, (_, hi, _) in enumerate(windows[q]):
                    if need[q][w] <= score <= hi:
                        got = best[q][w]
                        for row in self.ids[i]:
                            if row != own[q]:
                                insort(got, (-score, row))
                        del got[k:]
                        if len(got) == k and -got[-1][0] > need[q][w]:
                            need[q][w], changed = -got[-1][0], True
            if changed and (low := min(need[q])) > least[q]:
                least[q] = low
                edge[q] = far(total[q], low) + slack[q]

        def read(leaf: int, qs: np.ndarray) -> None:
            qs = qs[~seen[qs, leaf]]
            seen[qs, leaf] = True
            first, end = self.leaves[leaf]
            for a in range(first, end if len(qs) else first, PIECE):
                z = min(a + PIECE, end)
                rows = self.x[a:z]
                s = (queries[qs] @ rows.T).astype(np.int64) if plain else np.stack([exact_scores(np.broadcast_to(x, rows.shape), rows) for x in queries[qs]])
                fits = ((self.label[a:z] == labels[qs, None]) == same) & (s >= least[qs, None]) & (s <= most[qs, None])
                for i in np.flatnonzero(fits.any(axis=1)).tolist():
                    at = np.flatnonzero(fits[i])
                    take(int(qs[i]), (a + at).tolist(), s[i, at].tolist())

        def children(node: int, qs: np.ndarray, bound: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
            """Both children with the bounds of queries, and whether these reach their annulus; distances that ran over bound nothing."""
            _, a, b, c, z, inside, outside = self.nodes[node]
            d = dv[qs, node]
            return [(child, np.fmax(bound, np.fmax(d - hi, lo - d)), ~(d + hi < near[qs])) for lo, hi, child in ((a, b, inside), (c, z, outside))]

        def walk(node: int, qs: np.ndarray, bound: np.ndarray) -> None:
            if node < 0:
                read(~node, qs)
                return
            for child, low, reach in sorted(children(node, qs, bound), key=lambda x: float(x[1].sum())):
                on = reach & (low <= edge[qs])
                if on.any():
                    walk(child, qs[on], low[on])

        asking = np.flatnonzero([bool(ws) for ws in windows])
        for q in asking:
            one = np.array([q])
            heap: list[tuple[float, int]] = [(0.0, 0 if self.nodes else ~0)]
            left = FIRST
            while heap and left:
                bound, node = heapq.heappop(heap)
                if bound > edge[q]:
                    break
                if node < 0:
                    read(~node, one)
                    left -= 1
                    continue
                for child, low, reach in children(node, one, np.array([bound])):
                    if reach[0] and low[0] <= edge[q]:
                        heapq.heappush(heap, (float(low[0]), child))
        if len(asking):
            walk(0 if self.nodes else ~0, asking, np.zeros(len(asking)))
        for q in asking.tolist():
            for (w, _, _), got in zip(windows[q], best[q], strict=True):
                for score, row in got:
                    yield q, w, -score, row


def regions(nodes: list) -> list[list[tuple[int, bool, float]]]:
    """For each leaf of the top tree the (node, inside, distance of the edge) above it."""
    out: dict[int, list] = {}

    def walk(at: int, path: list) -> None:
        if at < 0:
            out[~at] = path
            return
        _, _, edge, _, _, inside, outside = nodes[at]
        walk(inside, [*path, (at, True, edge)])
        walk(outside, [*path, (at, False, edge)])

    walk(0 if nodes else ~0, [])
    return [out[i] for i in range(len(out))]


def region_of(x: np.ndarray, extra: np.ndarray, nodes: list, vantages: np.ndarray, v_extra: np.ndarray) -> np.ndarray:
    """The leaf of the top tree that each row belongs to: inside where its distance is at most the edge's."""
    out = np.zeros(len(x), np.int32)

    def walk(at: int, rows: np.ndarray) -> None:
        if at < 0:
            out[rows] = ~at
        elif len(rows):
            _, _, edge, _, _, inside, outside = nodes[at]
            with np.errstate(all="ignore"):
                d = np.nan_to_num(np.sqrt(((x[rows] - vantages[at]) ** 2).sum(axis=1) + (extra[rows] - v_extra[at]) ** 2))
            walk(inside, rows[d <= edge])
            walk(outside, rows[d > edge])

    walk(0 if nodes else ~0, np.arange(len(x)))
    return out


def lists(x: pa.Array, width: int) -> np.ndarray:
    return np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(x), width)


class Index:
    """All rows of one length, dealt over shards."""

    def __init__(self, rows: DataFrame, width: int, count: int, most: float, shard_rows: int) -> None:
        self.width, self.most = width, most
        spark = rows.sparkSession
        sample = rows.orderBy(F.xxhash64("x", "label"), "label").limit(SAMPLE).select("x").toArrow()["x"].combine_chunks()
        x = lists(sample, width)
        wanted = min(LEAVES, -(-count // shard_rows))
        nodes, _, _ = grown(x, augmented(x, most), 1, (wanted - 1).bit_length())
        vantages = x[[n[0] for n in nodes]] if nodes else x[:0]
        self.nodes, self.vantages, self.paths = nodes, vantages, regions(nodes)
        v_extra = augmented(vantages, most)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = lists(b.column(1), width)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region_of(own, augmented(own, most), nodes, vantages, v_extra))], names=["label", "x", "ids", "region"])

        dealt = cut(rows.select("label", "x", "ids").mapInArrow(deal, "label long, x array<double>, ids array<bigint>, region int"), "regions")
        held = {r.region: r["count"] for r in dealt.groupBy("region").count().collect()}
        self.copies = [-(-held.get(i, 0) // shard_rows) for i in range(len(self.paths))]
        self.base = np.concatenate(([0], np.cumsum(self.copies))).tolist()
        first, copies = (F.array(*map(F.lit, a))[F.col("region")] for a in (self.base, self.copies))
        self.rows = dealt.select((first + F.pmod(F.xxhash64("x", "label"), copies)).cast("int").alias("shard"), "label", "x", "ids")
        self.spark = spark

    def routed(self, asks: DataFrame, first: bool) -> DataFrame:
        """asks with their shards: those of the nearest region (kept as `home`), or of all others that meet the annulus."""
        width, most, vantages, paths, base, copies = self.width, self.most, self.vantages, self.paths, self.base, self.copies

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = lists(b.column(3), width)
                n = len(x)
                home = b.column(5).to_numpy(zero_copy_only=False)
                total = span(x, most)
                slack = SLACK * (np.sqrt(total) + 1)
                w = b.column(4)
                per = np.diff(w.offsets.to_numpy())
                of = np.repeat(np.arange(n), per)
                flat = w.flatten()
                hi, lo = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2))
                least, top = np.full(n, np.inf), np.full(n, -np.inf)
                open_ = lo <= hi
                np.minimum.at(least, of[open_], lo[open_])
                np.maximum.at(top, of[open_], hi[open_])
                some = top > -np.inf
                near, edge = far(total, np.where(some, top, 0)) - slack, far(total, np.where(some, least, 0)) + slack
                d = to_vantages(x, total, vantages)
                low, high = np.zeros((n, len(paths))), np.full((n, len(paths)), np.inf)
                for r, path in enumerate(paths):
                    for at, inside, border in path:
                        with np.errstate(all="ignore"):
                            a, z = (d[:, at] - border, d[:, at] + border) if inside else (border - d[:, at], np.inf)
                        low[:, r] = np.fmax(low[:, r], a)
                        high[:, r] = np.fmin(high[:, r], z)
                filled = np.array(copies) > 0
                meets = (low <= edge[:, None]) & (high >= near[:, None]) & some[:, None] & filled[None, :]
                if first:
                    home = np.where(meets.any(axis=1), np.where(meets, low, np.inf).argmin(axis=1), -1).astype(np.int32)
                    pick, region = np.flatnonzero(home >= 0), home[home >= 0]
                else:
                    meets[np.flatnonzero(home >= 0), home[home >= 0]] = False
                    pick, region = np.nonzero(meets)
                times = np.array(copies)[region]
                row = np.repeat(pick, times)
                shard = np.repeat(np.array(base)[region], times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
                taken = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns[:5], pa.array(home[row].astype(np.int32)), pa.array(shard.astype(np.int32))], names=["q", "own", "label", "x", "w", "home", "shard"])

        home = F.col("home") if not first else F.lit(-1)
        return asks.select("q", "own", "label", "x", "w", home.cast("int").alias("home")).mapInArrow(run, f"q long, own long, label long, x array<double>, w {WINDOWS}, home int, shard int")

    def search(self, routed: DataFrame, k: int, same: bool) -> DataFrame:
        """(q, id, score, row): each shard's first k rows of each window."""
        width, most = self.width, self.most
        routed = cut(routed, "routes")
        served = cut(routed.groupBy("shard").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("times")), "served")
        rows = self.rows.join(served, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"), F.lit(0).alias("kind"), "label", "x", "ids", F.lit(None).cast("long").alias("q"), F.lit(None).cast("long").alias("own"), F.lit(None).cast(WINDOWS).alias("w"))
        asks = routed.join(served, "shard").select("shard", F.pmod(F.xxhash64("q"), F.col("times")).cast("int").alias("copy"), F.lit(1).alias("kind"), "label", "x", F.lit(None).cast("array<bigint>").alias("ids"), "q", "own", "w")
        # a shard's rows come first in their partition, then its anchors, which stream past them
        both = rows.unionByName(asks).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind", "q")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, shard = None, [], None
            for b in batches:
                of = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
                edges = [0, *(np.flatnonzero((of[1:] != of[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
                for a, z in zip(edges, edges[1:], strict=False):
                    if a == z:
                        continue
                    part, now = b.slice(a, z - a), tuple(of[a, :2].tolist())
                    if now != key:
                        key, held, shard = now, [], None
                    if of[a, 2] == 0:
                        held.append(part)
                        continue
                    if shard is None:
                        x = np.concatenate([lists(p.column(4), width) for p in held])
                        label = np.concatenate([p.column(3).to_numpy(zero_copy_only=False) for p in held])
                        shard, held = Shard(x, label, [i for p in held for i in p.column(5).to_pylist()], most), []
                    for i in range(0, part.num_rows, BLOCK):
                        block = part.slice(i, BLOCK)
                        windows = [[(w["id"], w["hi"], w["lo"]) for w in ws] for ws in block.column(8).to_pylist()]
                        found = list(shard.search(lists(block.column(4), width), block.column(7).to_pylist(), block.column(3).to_pylist(), windows, k, same))
                        number = block.column(6).to_pylist()
                        columns = list(zip(*found, strict=True)) or [[], [], [], []]
                        yield pa.RecordBatch.from_arrays([pa.array([number[q] for q in columns[0]], pa.int64()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["q", "id", "score", "row"])

        return both.mapInArrow(run, "q long, id long, score long, row long")

    def nearest(self, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """(q, id, rank, row, score): the first k rows of each window of asks (q, own, label, x, w)."""
        order = F.row_number().over(Window.partitionBy("q", "id").orderBy(F.desc("score"), "row"))
        first = cut(self.routed(asks, True), "homes")
        found = cut(self.search(first, k, same).withColumn("rank", order).where(F.col("rank") <= k), "found")
        kth = found.where(F.col("rank") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("id", "score"))).alias("kth"))
        homes = first.groupBy("q").agg(F.first("home").alias("home"))
        nearer = F.transform("w", lambda w: F.struct(w["id"].alias("id"), w["hi"].alias("hi"), F.greatest(w["lo"], F.col("kth")[w["id"]]).alias("lo")))
        again = asks.join(homes, "q", "left").join(kth, "q", "left").select("q", "own", "label", "x", F.when(F.col("kth").isNull(), F.col("w")).otherwise(nearer).alias("w"), F.coalesce("home", F.lit(-1)).alias("home"))
        rest = self.search(self.routed(again, False), k, same)
        both = found.select("q", "id", "score", "row").unionByName(rest)
        return cut(both.withColumn("rank", order).where(F.col("rank") <= k).select("q", "id", "rank", "row", "score"), "nearest")


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors(vec_id, label, embedding): anchors
    are the rows whose vec_id is divisible by `every`, and negatives score from `low` to `high` percent of their positive."""
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised(F.col("embedding"), scale).alias("x")).dropna()
    base = cut(base.distinct(), "rows")
    # of rows of equal vector and label only the smallest ids can matter, one of which may be the anchor's own
    nth = F.row_number().over(Window.partitionBy("x", "label").orderBy("vec_id"))
    few = base.withColumn("nth", nth).where(F.col("nth") <= max(positives, negatives) + 1)
    whole = cut(few.groupBy("x", "label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("d", F.size("x")), "vectors")
    anchors = cut(base.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("own"), "label", "x", F.size("x").alias("d")), "anchors")
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sizes = whole.join(F.broadcast(anchors.select("d").distinct()), "d", "left_semi").groupBy("d").agg(F.count("*").alias("n"), F.max(norm).alias("most")).collect()
    for r in sorted(sizes):  # a pass for each length of vectors
        index = Index(whole.where(F.col("d") == r.d), r.d, r.n, r.most, shard_rows)
        mine = anchors.where(F.col("d") == r.d).drop("d")
        every_score = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit(TOP).alias("hi"), F.lit(-TOP - 1).alias("lo"))).cast(WINDOWS)
        good = index.nearest(mine.withColumn("w", every_score), positives, True).select("q", F.col("rank").alias("nth"), F.col("row").alias("positive_id"), F.col("score").alias("positive_score"))
        wide = F.col("positive_score").cast("decimal(38,0)")
        window = F.struct(F.col("nth").cast("long").alias("id"), F.floor(wide * high / 100).cast("long").alias("hi"), F.ceil(wide * low / 100).cast("long").alias("lo"))
        asks = mine.join(good.groupBy("q").agg(F.collect_list(window).cast(WINDOWS).alias("w")), "q")
        bad = index.nearest(asks, negatives, False).select("q", F.col("id").cast("int").alias("nth"), "rank", F.col("row").alias("negative_id"), F.col("score").alias("negative_score"))
        met = bad.join(good, ["q", "nth"]).join(mine.select("q", F.col("own").alias("anchor_id")), "q")
        out = out.unionByName(met.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(v.select("vec_id", label.alias("label"), "embedding"))


ORACLE_SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % {EVERY} = 0 AND v.vec_id <> a.vec_id AND len(a.x) = len(v.x)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= {NEGATIVES}
"""
