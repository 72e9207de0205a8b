"""Removal of repeated substrings with suffix automata.

A window is WINDOW consecutive words; a word goes if some window that covers it also starts earlier (in a document of
smaller id, or earlier in the same one). Windows are judged on the input.

Reference text is sharded by content, so work grows with the corpus and not with shards times documents. A window's shard
is the least hash among its runs of GRAM words (its minimizer), which equal windows share. Consecutive windows of a
document with one minimizer form a segment of at most 2 * WINDOW - GRAM words. Shards that only one segment falls into
hold nothing repeated and drop out. For each other shard the distinct segments, in order of their first occurrence, build
a suffix automaton over words whose states remember where they first ended, and are streamed through it: where the match
is WINDOW words long or more, the state tells where that window first started. The result says for each distinct segment
which of its windows start earlier elsewhere; every document that holds the segment looks it up, and the windows marked
unite to maximal spans that are removed.

A shard goes to one task, where its automaton lives; it isn't sent to all executors. Its segments are dealt to one piece for
every PIECE of them or so; where that is more than one (a short phrase in very many contexts), each of their windows is a
sequence of its own, dealt by its hash, so that equal windows still meet in one automaton.

Fixed cases: null and empty texts have no words and nothing to remove; documents of fewer than WINDOW words stay whole;
null ids come last; rows that repeat an id count as documents one after another, in order of text; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PRIME, cut, likely_in, mixed, slices, span_hashes, split_words, word_hashes

WINDOW, GRAM = 20, 8
#: Distinct segments that one automaton is built over, about: a shard of more is cut into so many pieces.
PIECE = 400
#: Segments that one task's group of shards has on average.
SHARD_SEGMENTS = 10_000
#: Bits of a place within a slice; more words than that don't fit a text.
PLACES = (1 << 32) - 1
SCANNED = ["shard", "seg", "id", "at", "doc_id", "digest"]


def segments(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document's place, shard, segment hash, first window, number of windows) of each segment of documents that lie one
    after the other: h hashes all their words, starts and sizes tell where each document lies."""
    n = len(h)
    if n < window:
        e = np.zeros(0, np.int64)
        return e, e.astype(np.uint64), e.astype(np.uint64), e, e
    g = h[: n - gram + 1].copy()
    for j in range(1, gram):
        g = g * np.uint64(PRIME) + h[j : n - gram + 1 + j]
    g = mixed(g)
    # high bits of the gram's hash, then its place: the least one is the leftmost of the least hashes
    low = (g & ~np.uint64(PLACES)) | np.arange(len(g), dtype=np.uint64)
    done, span = 1, window - gram + 1
    while done < span:
        step = min(done, span - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    n_windows = np.maximum(sizes - window + 1, 0)
    inside = np.repeat(starts - np.concatenate(([0], np.cumsum(n_windows)[:-1])), n_windows) + np.arange(n_windows.sum())
    doc = np.repeat(np.arange(len(sizes)), n_windows)
    least = (low[inside] & np.uint64(PLACES)).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1]))) if len(least) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((at, [len(least)])))
    first, own, least = inside[at], doc[at], least[at]
    seg = span_hashes(h, first, first + count + window - 1)
    return own, g[least], seg, first - starts[own], count


class SuffixAutomaton:
    """Suffix automaton over several sequences; each state knows where the first of its occurrences ends."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]

    def add(self, sequence: list[bytes], at: int) -> int:
        """Adds a sequence whose elements stand at places at, at + 1, ...; returns the place after it."""
        nxt, link, size, first = self.next, self.link, self.size, self.first
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and size[q] == size[last] + 1:  # known already, and first seen earlier
                last = q
                at += 1
                continue
            if q is None:
                cur = len(size)
                nxt.append({})
                size.append(size[last] + 1)
                first.append(at)
                link.append(0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if size[q] == size[p] + 1 else self._split(p, q, c)
                last = cur
            else:
                last = self._split(last, q, c)
            at += 1
        return at

    def _split(self, p: int, q: int, c: bytes) -> int:
        nxt, link, size, first = self.next, self.link, self.size, self.first
        clone = len(size)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        first.append(first[q])
        link.append(link[q])
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def starts(self, sequence: list[bytes], window: int) -> list[int]:
        """For each window of the sequence the place where its first occurrence starts; -1 if there is none."""
        nxt, link, size, first = self.next, self.link, self.size, self.first
        v = length = 0
        out = []
        for j, c in enumerate(sequence):
            while v and c not in nxt[v]:
                v = link[v]
                length = size[v]
            if c in nxt[v]:
                v = nxt[v][c]
                length += 1
            while size[link[v]] >= window if v else False:
                v = link[v]
                length = size[v]
            if j >= window - 1:
                out.append(first[v] - window + 1 if length >= window else -1)
        return out


def shard_masks(rows: list[tuple[int, int, list[bytes]]], window: int = WINDOW) -> list[int]:
    """For the distinct segments (doc, start, words) of a shard: bit i set if window i also starts earlier."""
    order = sorted(range(len(rows)), key=lambda i: rows[i][:2])
    if len(rows) == 1 and len(set(rows[0][2])) == len(rows[0][2]):
        return [0]  # one segment without a repeated word repeats no window
    auto, at, places = SuffixAutomaton(), 0, []
    for i in order:
        places.append(at)
        at = auto.add(rows[i][2], at)
    masks = [0] * len(rows)
    for i, own in zip(order, places, strict=True):
        masks[i] = sum(1 << k for k, s in enumerate(auto.starts(rows[i][2], window)) if s != own + k)
    return masks


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, id): id is unique and in order of documents; it is doc_id itself where that is unique and never null."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    same = slim.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if same.limit(1).count() == 0:
        return slim.withColumn("id", F.col("doc_id"))
    return cut(slim.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("id", F.monotonically_increasing_id()), "numbered")


def digests(words: list[bytes]) -> str:
    return sha256(b" ".join(words)).hexdigest()


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, text, id): documents (doc_id, id, n_words, digest) and, for those that lose words, (id, spans).

    spans are array<struct<start, n, mask>>: bit i of mask says that the window at start + i goes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for whole in batches:
            for b in slices(whole, 2):
                words, sizes = split_words(b.column(2))
                h = word_hashes(words)
                starts = np.cumsum(sizes) - sizes
                ids = b.column(1).to_numpy(zero_copy_only=False)
                own, shard, seg, first, count = segments(h, starts, sizes, window, gram)
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(ids[own]), pa.array(first * 64 + count), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=SCANNED
                )
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate((starts, [len(h)])), pa.int32()), words.cast(pa.binary()))
                lines = pc.binary_join(lists, b" ")
                digest = pa.array([sha256(x.as_buffer()).hexdigest() for x in lines], pa.string())
                empty = pa.nulls(len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([empty, empty, b.column(1), pa.array(sizes), b.column(0), digest], names=SCANNED)

    found = cut(docs.select("doc_id", "id", "text").mapInArrow(scan, "shard long, seg long, id long, at long, doc_id long, digest string"), "segments")
    whole = found.where("digest is not null").select("doc_id", "id", F.col("at").alias("n_words"), "digest")
    every = found.where("digest is null").select("shard", "seg", "id", "at")
    # written apart, so that the join deals both sides itself and can split a shard that very many documents share
    shared = cut(every.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").select("shard"), "shared_shards")
    held = cut(every.join(shared, "shard"), "repeated_segments")

    # distinct segments with the place of their first occurrence; a shard of one alone needs no words: all but the first go
    distinct = cut(held.groupBy("shard", "seg").agg(F.min(F.struct("id", "at")).alias("own")).select("shard", "seg", "own.id", "own.at"), "distinct_segments")
    sizes = cut(distinct.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"), "shard_sizes")
    mixed_up = distinct.join(sizes, "shard").select("shard", "seg", "id", "at", F.ceil(F.col("n") / piece).cast("long").alias("pieces"))
    wanted = cut(mixed_up.groupBy("id").agg(F.collect_list(F.struct("shard", "seg", "at", "pieces")).alias("parts")), "segment_places")
    source = likely_in(docs.select("id", "text"), wanted.select("id"), "id").join(wanted, "id")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each segment; of a shard of several pieces, the words of each window, dealt by their hash."""
        from xxhash import xxh64_intdigest

        for whole in batches:
            for b in slices(whole, 1):
                rows: list[tuple] = []
                for i, t, parts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                    words = t.as_py().encode("utf-8", "surrogatepass").split()
                    for p in parts.as_py():
                        s, n = divmod(p["at"], 64)
                        if p["pieces"] == 1:
                            rows.append((p["shard"], 0, p["seg"], i, p["at"], 0, b" ".join(words[s : s + n + window - 1])))
                        else:
                            for k in range(n):
                                line = b" ".join(words[s + k : s + k + window])
                                rows.append((p["shard"], xxh64_intdigest(line, 3) % p["pieces"], p["seg"], i, (s + k) * 64 + 1, k, line))
                        if len(rows) >= 10_000:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c[:6]] + [pa.array(c[6], pa.binary())], names=["shard", "piece", "seg", "id", "at", "k", "words"])

    texts = cut(source.select("id", "text", "parts").mapInArrow(words_of, "shard long, piece long, seg long, id long, at long, k long, words binary"), "segment_words")
    n_groups = max(1, -(-texts.count() // SHARD_SEGMENTS))

    def by_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["shard", "piece"], ignore_index=True)
        out = np.zeros(len(pdf), np.int64)
        new = (np.diff(pdf["shard"].to_numpy()) != 0) | (np.diff(pdf["piece"].to_numpy()) != 0)
        cuts = np.flatnonzero(np.concatenate(([True], new, [True])))
        ids, at, words = pdf["id"].tolist(), pdf["at"].tolist(), pdf["words"].tolist()
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[a:z] = shard_masks([(ids[i], at[i], words[i].split()) for i in range(a, z)], window)
        return pd.DataFrame({"shard": pdf["shard"], "seg": pdf["seg"], "mask": np.left_shift(out, pdf["k"].to_numpy())})

    grouped = texts.withColumn("group", F.pmod(F.xxhash64("shard", "piece"), F.lit(n_groups))).groupBy("group")
    bits = grouped.applyInPandas(lambda pdf: by_shard(pdf), "shard long, seg long, mask long").groupBy("shard", "seg").agg(F.expr("bit_or(mask)").alias("mask"))
    masks = cut(
        distinct.join(bits, ["shard", "seg"], "left").select("shard", "seg", F.col("id").alias("own_id"), F.col("at").alias("own_at"), F.coalesce("mask", F.lit(0).cast("long")).alias("mask")), "segment_masks"
    )
    full = F.expr("shiftleft(1L, cast(at % 64 as int)) - 1")
    mask = F.when((F.col("id") == F.col("own_id")) & (F.col("at") == F.col("own_at")), F.col("mask")).otherwise(full)
    gone = held.join(masks, ["shard", "seg"]).select("id", F.floor(F.col("at") / 64).cast("int").alias("start"), (F.col("at") % 64).cast("int").alias("n"), mask.alias("mask"))
    return whole, cut(gone.where("mask <> 0").groupBy("id").agg(F.collect_list(F.struct("start", "n", "mask")).alias("spans")), "removed_windows")


def gone_words(n_words: int, start: np.ndarray, n: np.ndarray, mask: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words the windows of spans cover: bit i of mask says that the window at start + i goes."""
    edge = np.zeros(n_words + 1, np.int64)
    for k in range(int(n.max(initial=0))):
        at = start[(mask >> k) & 1 == 1] + k
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = False, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]): what is left of each document; kept is its text, words joined by a space.

    Without `texts`, documents that lose nothing aren't read again.
    """
    rows = numbered(docs)
    whole, gone = repeated_spans(rows, window, gram, piece)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for b in slices(held, 1):
                out: list[tuple] = []
                for i, t, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                    words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                    s = spans.values
                    cols = [s.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)] if s is not None else [np.zeros(0, np.int64)] * 3
                    drop = gone_words(len(words), *cols, window)
                    kept = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                    out.append((i, len(words), len(words) - len(kept), digests(kept), *([b" ".join(kept).decode("utf-8", "surrogatepass")] * texts)))
                cols = list(zip(*out, strict=True)) or [[]] * (4 + texts)
                arrays = [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(c, pa.string()) for c in cols[3:]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + texts])

    if texts:
        return rows.join(gone, "id", "left").select("doc_id", "text", "spans").mapInArrow(keep, schema)
    changed = likely_in(rows, gone.select("id"), "id").join(gone, "id").select("doc_id", "text", "spans").mapInArrow(keep, schema)
    same = whole.join(gone.select("id"), "id", "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"))
    return changed.unionByName(same)


def query(spark, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)),
q AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM p),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM q WHERE nth > 1)),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept, count(*) AS n FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY u.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""
