"""SimHash near-duplicates by the generalised pigeonhole principle.

Each text gets a 64-bit fingerprint. Correlated bits are grouped into partitions, and each partition gets a threshold of
its own: thresholds t_1..t_m with sum(t_i + 1) = radius + 1 guarantee that two fingerprints within the radius agree up to
t_i in some partition i (t_i = -1 leaves the partition out). Dynamic programming picks the thresholds, and the number of
partitions, of least estimated cost. Rows that meet under one partition value are verified on all 64 bits.

Fixed cases: null and empty texts, and texts of white space only, have fingerprint 0 and link like any other; one or two
words are hashed as one shingle; equal texts and repeated rows share one fingerprint; a null doc_id keeps its row and never
names a component unless nothing else can; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, without_repeats

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints whose bit correlations and partition sizes steer the plan; the plan never changes the result.
PLAN_SAMPLE = 2000
#: A partition value with more fingerprints than this is compared in blocks of that size, pair of blocks by pair of blocks.
BLOCK = 512
#: Cost of one row that is probed, in comparisons.
PROBE_COST = 200


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < shingle:
        spans = [(0, len(line))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return folded(np.array([xxh64_intdigest(line[s:e], seed) for s, e in spans], dtype="<u8"))


def folded(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes: each bit that more than half of them have."""
    h = h.astype("<u8", copy=False)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, h, fp long): fp holds the fingerprint's 64 bits as a signed number, h is the text's xxhash64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array(fps, pa.int64())], ["doc_id", "h", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, fp long")


def bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """Deals 64 bits into m groups of nearly equal size; each group takes the bits that correlate most with its own."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    dev = bits - bits.mean(axis=0)
    norm = np.sqrt((dev**2).sum(axis=0)) + 1e-9
    cor = np.abs(dev.T @ dev) / norm[:, None] / norm[None, :]
    left, groups = set(range(64)), []
    for g in range(m):
        own = [max(left, key=lambda b: (cor[b, sorted(left)].sum(), -b))]
        left.discard(own[0])
        while len(own) < (64 * (g + 1)) // m - (64 * g) // m:
            best = max(left, key=lambda b: (cor[b, own].mean(), -b))
            own.append(best)
            left.discard(best)
        groups.append(sorted(own))
    return groups


def project(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of a partition: its bits, packed."""
    out = np.zeros(len(fps), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def plan(sample: np.ndarray, total: int, radius: int = RADIUS, halved: bool = False) -> list[tuple[list[int], int]]:
    """Partitions (bits, bits to flip) of least estimated cost, by dynamic programming over thresholds for each partition count.

    Both sides of a pair flip bits, so half a partition's threshold is enough (`halved`), which a wide radius can't do without.
    """
    flips = (lambda t: (t + 1) // 2) if halved else (lambda t: t)
    from math import comb

    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    scale = (total / max(1, len(sample))) ** 2 / 2
    for m in range(2, 7):
        groups = bit_groups(sample, m)
        cost = []
        for bits in groups:
            v = project(sample, bits)
            d = np.bitwise_count(v[:, None] ^ v[None, :])
            row = [0.0]  # threshold -1: left out
            for t in range(radius + 1):
                probes = sum(comb(len(bits), i) for i in range(flips(t) + 1)) if flips(t) <= 2 else np.inf
                # one pair in the sample stands for `scale` pairs, so a value seen nowhere still counts as a chance hit
                meets = max(float((d <= t).sum() - len(sample)), 0.0) * scale + total**2 / 2 * (probes**2 if halved else probes) / 2.0 ** len(bits)
                row.append(PROBE_COST * total * probes + meets)
            cost.append(row)
        table = {0: (0.0, [])}
        for row in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for spent, (c, ts) in table.items():
                for t in range(-1, radius + 1 - spent):
                    k, x = spent + t + 1, c + row[t + 1]
                    if k not in nxt or x < nxt[k][0]:
                        nxt[k] = (x, [*ts, t])
            table = nxt
        c, ts = table.get(radius + 1, (np.inf, []))
        if c < best[0]:
            best = (c, [(g, flips(t)) for g, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


def probe_rows(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(key, fp): a row for each partition value that differs from the fingerprint's own in as many bits as the plan flips, or fewer."""
    from itertools import combinations

    flips = [np.array([sum(1 << i for i in c) for r in range(t + 1) for c in combinations(range(len(bits)), r)], np.uint64) for bits, t in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for p, (bits, _) in enumerate(parts):
                own = project(fp, bits)
                for some in np.array_split(flips[p], max(1, len(flips[p]) // 64)):
                    key = (own[:, None] ^ some[None, :]).ravel() | np.uint64(p << 56)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(fp, len(some)).view(np.int64))], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all links within the radius do, at most one for each fingerprint."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    at = np.flatnonzero(label != np.arange(len(fps)))
    return fps[at], fps[label[at]]


def verified_links(rows: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between fingerprints that share a key and differ in at most radius bits.

    Values with many fingerprints are dealt to pairs of blocks, so no task gets an unbounded group, and each such pair
    returns a spanning forest of its links instead of all of them.
    """
    size = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    nb = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    dealt = (
        rows.join(size, "key")
        .select("key", "fp", nb.alias("nb"))
        .withColumn("own", own)
        .select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "key", "fp")
        .repartition("g")
        .sortWithinPartitions("g", "key")
    )

    def links(g: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (key[1:] != key[:-1]))))
        size = np.diff(np.concatenate((new, [len(g)])))
        a, b = [], []
        for s, n in zip(new[size > 24].tolist(), size[size > 24].tolist(), strict=True):
            x, y = forest(np.unique(fp[s : s + n]), radius)
            a.append(x)
            b.append(y)
        left = np.repeat(size - 1, size) - (np.arange(len(g)) - np.repeat(new, size))  # rows that follow in the group
        left[np.repeat(size > 24, size)] = 0
        for k in range(1, 24):
            i = np.flatnonzero(left >= k)
            if not len(i):
                break
            x, y = fp[i], fp[i + k]
            ok = (np.bitwise_count(x ^ y) <= radius) & (x != y)
            a.append(x[ok])
            b.append(y[ok])
        return np.concatenate(a) if a else fp[:0], np.concatenate(b) if b else fp[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = links(*cols)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1:].sum()) + 1 if (cols[0] != cols[0][-1]).any() or (cols[1] != cols[1][-1]).any() else 0
            if last:
                yield out([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held:
            yield out(held)

    return dealt.mapInArrow(run, "a long, b long")


def linked(reps: DataFrame, radius: int = RADIUS, halved: bool = False) -> DataFrame:
    """(a, b): links within the radius between the distinct fingerprints of reps(fp), enough to join all that are linked."""
    total = reps.count()
    if not total:
        return reps.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    sample = np.array([r.fp for r in reps.orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).select("fp").collect()], np.int64).view(np.uint64)
    return verified_links(cut(probe_rows(reps, plan(sample, total, radius, halved)), "probes"), radius)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, h, fp long, root, component_id): component_id is the smallest doc_id reachable over links of at most radius bits,
    root names the component where no document of it has an id."""
    rows = cut(fingerprints(docs, shingle, seed), "fingerprints")
    reps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct_fingerprints")
    roots = connected_components(linked(reps, radius))
    known = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    first = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = known.join(first, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "h", "fp", "root", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Documents without their near-duplicates: of each component the document of the smallest doc_id stays, null ids last.

    Rows that repeat that document count as copies of it; of texts that share its id the one of the least hash stays.
    """
    found = near_duplicates(docs.select("doc_id", "text"), radius)
    return without_repeats(docs, found.select("doc_id", "h", F.col("root").alias("grp")))
