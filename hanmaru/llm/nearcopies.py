"""Near copies by exact Jaccard similarity of word shingles: SimHash fingerprints by the generalised pigeonhole principle first,
MinHash bands for what lies beyond their radius.

Texts are sets of shingles of SHINGLE words (lower-cased A-Z). Two texts are linked when the Jaccard similarity of their
sets is SIMILARITY or more; every candidate link is verified on the whole sets. Candidates are, first, texts whose
fingerprints over the same shingles differ in at most RADIUS bits (`simhash.linked`). At similarity 0.8 fingerprints differ in
10 of 64 bits on average and 20 at times, a radius at which nearly all pairs would be candidates. So texts that agree in all
ROWS minima of one of BANDS bands are candidates too, where fingerprints have not joined them yet: of all pairs at similarity
0.8 bands miss (1 - 0.8^4)^24, about 3 in a million, and less above.

Groups of a band with at most SMALL texts are compared in all pairs, larger ones with one of the group first. Where texts of
a larger group are still in several components after that, all texts of those components that stand in such groups form a
cluster, and each of its texts outside of its largest component is compared with all the others: the texts are dealt to
pairs of blocks, so no task gets an unbounded group and no pair is ever a row. That gives the components that all pairs would.

Fixed cases: null and empty texts and texts of white space only have one empty shingle and are copies of each other; fewer
words than SHINGLE are one shingle; repeated rows and equal texts are one node; a null doc_id keeps its row and never names
a component unless nothing else can; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, cut, likely_in, slices, without_repeats

SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which fingerprints of candidates may differ: the most that four partitions cover with one flipped bit on either side.
RADIUS = 11
BANDS, ROWS = 24, 4
SMALL = 24
#: Texts of a cluster that meet in one task, about, on either side.
BLOCK = 256
_RNG = np.random.default_rng(42)
_MUL = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    if len(words) < shingle:
        return np.array([xxh64_intdigest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.unique(np.array([xxh64_intdigest(line[s:e]) for s, e in spans], np.uint64))


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key for each band of the set's minima."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 2048):
        x = h[i : i + 2048, None] * _MUL + _ADD
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ low[r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, node long, fp long, n int, keys): node is the hash of the text's words, fp the fingerprint of its n shingles;
    keys are its bands'; h is the text's xxhash64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                keys, fps, sizes = [], [], []
                for t in b.column(1):
                    own = shingles(t.as_py())
                    keys.append(band_keys(own))
                    fps.append(simhash.folded(own))
                    sizes.append(len(own))
                keys = np.array(keys, np.uint64).view(np.int64).reshape(-1, BANDS)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                fp = pa.array(np.array(fps, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(node_ids(b.column(1))), fp, pa.array(sizes, pa.int32()), flat], ["doc_id", "h", "node", "fp", "n", "keys"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    return slim.mapInArrow(run, "doc_id long, h long, node long, fp long, n int, keys array<long>")


def node_ids(texts: pa.Array) -> np.ndarray:
    from xxhash import xxh64_intdigest

    lines = (b" ".join((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()) for t in texts)
    return np.array([xxh64_intdigest(x, 7) for x in lines], np.uint64).view(np.int64)


def with_node(docs: DataFrame) -> DataFrame:
    """(doc_id, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node_ids(b.column(1))), b.column(1)], ["doc_id", "node", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, node long, text string")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=256)(lambda t: shingles(t))
        for batch in batches:
            ok = [jaccard(known(x.as_py()), known(y.as_py())) >= SIMILARITY for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    of = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def roots_linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between components, one for each two that have texts alike: rows hold root, text, and whether the text asks or answers."""
    sets = [shingles(t) for t in pdf["text"]]
    codes, _ = pd.factorize(np.concatenate(sets))
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(size)
    root, asks = pdf["root"].to_numpy(), pdf["asks"].to_numpy()
    mine = np.zeros(codes.max() + 1, np.int64)
    links = set()
    for i in np.flatnonzero(asks).tolist():
        own = codes[ends[i] - size[i] : ends[i]]
        mine[own] = 1
        both = np.add.reduceat(mine[codes], ends - size)
        mine[own] = 0
        near = (both >= SIMILARITY * (size + size[i] - both)) & ~asks & (root != root[i])
        links |= {(min(r, root[i]), max(r, root[i])) for r in np.unique(root[near]).tolist()}
    return pd.DataFrame(sorted(links), columns=["a", "b"], dtype="int64")


def links_apart(apart: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between components whose texts share a large group; apart has (key, node, root) of groups of several."""
    low = apart.groupBy("key").agg(F.min("root").alias("a"))
    clusters = connected_components(apart.join(low, "key").select("a", F.col("root").alias("b")))
    members = apart.select("node", "root").distinct().join(clusters.select(F.col("node").alias("root"), F.col("root").alias("cluster")), "root")
    size = members.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    largest = size.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all")).select("cluster", F.col("m.root").alias("most"), F.col("m.n").alias("n_most"), "all")
    dealt = members.join(largest, "cluster").select(
        "node", "root", "cluster", (F.col("root") != F.col("most")).alias("minor"), F.ceil((F.col("all") - F.col("n_most")) / block).cast("int").alias("n_asks"), F.ceil(F.col("all") / block).cast("int").alias("n_answers")
    )
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = dealt.where("minor").withColumn("x", own("n_asks")).withColumn("y", every("n_answers")).withColumn("asks", F.lit(True))
    answering = dealt.withColumn("y", own("n_answers")).withColumn("x", every("n_asks")).withColumn("asks", F.lit(False))
    rows = asking.select("cluster", "x", "y", "asks", "node", "root").unionByName(answering.select("cluster", "x", "y", "asks", "node", "root")).join(texts, "node")
    return rows.groupBy("cluster", "x", "y").applyInPandas(lambda pdf: roots_linked(pdf), "a long, b long")


def fingerprint_pairs(one: DataFrame) -> DataFrame:
    """(a, b): pairs of one(node, fp, n) within RADIUS bits whose sizes allow SIMILARITY.

    A fingerprint's texts are paired with one of them, which also stands for them in links to other fingerprints.
    """
    prints = cut(one.groupBy("fp").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", "fp")).alias("p")).select("fp", F.col("p.node").alias("pivot"), F.col("p.n").alias("n_pivot")), "fingerprints")
    links = simhash.linked(prints.select("fp"), RADIUS, halved=True).distinct()
    of = lambda k: prints.select(F.col("fp").alias(k), F.col("pivot").alias(f"node_{k}"), F.col("n_pivot").alias(f"n_{k}"))
    apart = links.join(of("a"), "a").join(of("b"), "b").select("node_a", "node_b", "n_a", "n_b")
    equal = one.join(prints, "fp").where("node <> pivot").select(F.col("node").alias("node_a"), F.col("pivot").alias("node_b"), F.col("n").alias("n_a"), F.col("n_pivot").alias("n_b"))
    fits = F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")
    return apart.unionByName(equal).where(fits).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def beyond(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that roots (node, root) don't join yet."""
    of = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after more links (a, b): components that are known start as stars."""
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, h, node, root, component_id): component_id is the smallest doc_id reachable over links; root names the component."""
    rows = cut(nodes(docs), "nodes")
    reps = rows.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    one = rows.dropDuplicates(["node"])
    near = cut(fingerprint_pairs(one.select("node", "fp", "n")), "near")
    bands = one.select("node", F.explode("keys").alias("key"))
    size = bands.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "key")).alias("pivot")).where("n > 1")
    met = cut(bands.join(size, "key"), "met")
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    x, y = met.where(f"n <= {SMALL}").select("key", F.col("node").alias("a")), met.where(f"n <= {SMALL}").select("key", F.col("node").alias("b"))
    star = met.where(f"n > {SMALL} and node <> pivot").select(*pair("node", "pivot"))
    pairs = cut(x.join(y, "key").where("a < b").select("a", "b").unionByName(star).distinct(), "pairs")
    ids = met.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = with_node(docs.select("doc_id", "text"))
    texts = cut(likely_in(wanted, ids, "node").join(ids, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    links = cut(verified(near, texts), "verified")
    roots = connected_components(links)
    rest = cut(beyond(pairs, roots), "beyond")
    roots = joined(roots, cut(verified(rest, texts), "verified"))
    large = met.where(f"n > {SMALL}").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    several = large.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    apart = cut(large.join(several, "key", "left_semi"), "apart")
    if apart.limit(1).count():
        roots = joined(roots, cut(links_apart(apart, texts), "links_apart"))
    known = reps.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    first = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = known.join(first, "root").select("node", "root", "component_id")
    return rows.select("doc_id", "h", "node").join(named, "node").select("doc_id", "h", "node", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without their near copies: of each component the document of the smallest doc_id stays, null ids last.

    Rows that repeat that document count as copies of it; of texts that share its id the one of the least hash stays.
    """
    return without_repeats(docs, near_copies(docs.select("doc_id", "text")).select("doc_id", "h", F.col("root").alias("grp")))
