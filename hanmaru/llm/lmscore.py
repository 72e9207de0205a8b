"""Language-model scoring by online logistic context mixing.

A text's bytes are predicted bit by bit. Five predictors look up how often either bit followed a hashed context (the last
1, 2, 3, 4 and 6 bytes and the bits so far of this byte). Their stretched probabilities are combined by weights that a gate
selects: the bit's place and the longest context seen before. The weights learn online, and an adaptive table refines the
mixed probability by the bits so far.

A second mixer works above: text is cut into chunks by content (a chunk ends after a word whose hash says so, CHUNK_WORDS
on average, CHUNK_MOST at most, with the white space or end behind it), and a context of the whole chunk before predicts the
next. Where the chunk before occurred in training C times, c times with this one behind it, the chunk's probability is
(1 - g) * (its bytes' probability) + g * c / C, with the weight g gated by the size of C. These counts are exact, lie in
tables that grow with the corpus, and are joined, never sent out. A training text's own counts are left out of its c and C,
so training texts and held-out ones compare: a text that occurs elsewhere stands out in both. A text's score is the log10
probability of all its bits.

Everything else is gathered in one pass over all training texts that keeps the words' counts and the distinct
stretches with theirs. Bits are counted by context into tables of fixed size; then the online mixing runs over every
stretch, each occurrence left out of its own counts, and the tasks' weights are averaged.
Tables are summed up in trees of bounded fan-in. Equal stretches of seven bytes predict alike, so distinct
ones are counted, learned and scored once. Scoring itself doesn't learn, so scores depend neither on order nor on partitioning.

Beside it stands the base: add-one word probabilities from the word counts of all training texts. Only the most frequent
words (at most FREQUENT_WORDS) are sent out; the rest are joined. Words are counted by 64-bit hashes.

Texts are words of lower-cased A-Z joined by one space, with one end.

Fixed cases: null and empty texts consist of the end alone; a null doc_id counts as the empty string for the split;
repeated rows count and score each; a text's first chunk, and texts of one chunk, are predicted by bytes alone; without
training texts counts are 0 and every bit has probability one half; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PRIME, cut, mixed, slices, span_hashes, split_words

ORDERS = (1, 2, 3, 4, 6)
#: log2 of each predictor's table size.
TABLE_BITS = (16, 18, 20, 21, 22)
#: Slots in one row of a table that is being summed up.
ROW_SLOTS = 1 << 14
#: Rows that one step of the summing tree adds.
FAN_IN = 64
#: Bytes of text that are worked on at once.
CHUNK = 1_500_000
#: Words of a chunk on average, a power of 2, and at most.
CHUNK_WORDS, CHUNK_MOST = 32, 128
#: Sizes of C, by powers of 2, that have a weight of their own.
CHUNK_GATES = 8
#: Distinct stretches are dealt to 2**BUCKET_BITS buckets by hash.
BUCKET_BITS = 7
FREQUENT_WORDS = 500_000
GATES = 8 * (len(ORDERS) + 1)
INPUTS = len(ORDERS) + 1
BUCKETS = 33
#: A random 64-bit number for each byte, from a fixed seed; words are counted by a 64-bit hash over these.
BYTE_CODES = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
#: Stands for the end among the words' hashes.
END = 1


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


class Lines:
    """Texts of a slice as lines: words in lower case joined by one space, each line ended by a line feed."""

    def __init__(self, texts: pa.Array) -> None:
        self.words, self.sizes = split_words(pc.ascii_lower(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        ends = pa.array(np.concatenate((self.starts, [len(self.words)])), pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(ends, self.words), " ")
        lines = pc.binary_join_element_wise(joined, "", "\n")
        at = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
        self.bytes = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        self.line_starts, self.line_sizes = at[:-1] - at[0], np.diff(at)
        length = pc.binary_length(self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        # as if empty lines took nothing; their line feeds come on top
        empty = np.cumsum(self.sizes == 0) - (self.sizes == 0)
        self.word_starts = np.cumsum(length + 1) - length - 1 + np.repeat(empty, self.sizes)
        self.hashes = span_hashes(BYTE_CODES[self.bytes], self.word_starts, self.word_starts + length)

    def keys(self) -> np.ndarray:
        """Key of each byte with those before it that the longest context has; lines start from zero bytes."""
        width = max(ORDERS)
        x = self.bytes.astype(np.uint64)
        key = x.copy()
        for k in range(1, width + 1):
            key[k:] |= x[:-k] << np.uint64(8 * k)
        for j in range(width):  # what stands before a line's start doesn't count
            key[self.line_starts[self.line_sizes > j] + j] &= np.uint64((1 << 8 * (j + 1)) - 1)
        return key

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, hash, first byte, whether it is its line's first) of each chunk."""
        h, n = self.hashes, len(self.words)
        last = np.zeros(n, bool)
        last[(self.starts + self.sizes - 1)[self.sizes > 0]] = True
        ends = np.flatnonzero(last | (mixed(h ^ np.uint64(PRIME)) & np.uint64(CHUNK_WORDS - 1) == 0)) + 1
        size = np.diff(ends, prepend=0)
        parts = -(-size // CHUNK_MOST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(ends - size, parts) + nth * CHUNK_MOST
        end = np.minimum(first + CHUNK_MOST, np.repeat(ends, parts))
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)[first]
        kind = span_hashes(h, first, end)
        kind = np.where(last[end - 1], mixed(kind), kind) if len(end) else kind
        return row, kind, self.word_starts[first], first == self.starts[row]


def lines_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    for whole in batches:
        for b in slices(whole, column, CHUNK):
            yield b, Lines(b.column(column))


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def slots(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """For each bit of the keys' last byte, the highest first: (place, the bit, slot in each table)."""
    byte = keys & np.uint64(255)
    ctx = [(keys >> np.uint64(8)) & np.uint64((1 << 8 * o) - 1) for o in ORDERS]
    hashed = [scrambled(c * np.uint64(0xD6E8FEB86659FD93) + np.uint64(o)) for c, o in zip(ctx, ORDERS, strict=True)]
    for place in range(8):
        prefix = np.uint64(1 << place) | (byte >> np.uint64(8 - place))
        out = [(ctx[0] << np.uint64(8) | prefix).astype(np.int64)]
        for h, bits in zip(hashed[1:], TABLE_BITS[1:], strict=True):
            out.append(((h + prefix * np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB) >> np.uint64(64 - bits)).astype(np.int64))
        yield place, ((byte >> np.uint64(7 - place)) & np.uint64(1)).astype(np.int64), out


class Mixer:
    """Tables, weights and refinement of the model."""

    def __init__(self, tables: list[np.ndarray]) -> None:
        self.tables = tables  # (slots, 2): how often 0 and 1 followed
        self.weights = np.full((GATES, INPUTS), 0.2)
        self.weights[:, -1] = 0.0
        self.refine = np.zeros((256 * BUCKETS, 2))

    def inputs(self, place: int, bit: np.ndarray, at: list[np.ndarray], leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """(stretched predictions and a constant, gate) of the bits; leave_out takes each bit's own count away."""
        x = np.empty((len(bit), INPUTS))
        gate = np.zeros(len(bit), np.int64)
        for i, (t, s) in enumerate(zip(self.tables, at, strict=True)):
            n0, n1 = t[s, 0].astype(np.float32), t[s, 1].astype(np.float32)
            if leave_out:
                n0, n1 = np.maximum(n0 - (bit == 0), 0), np.maximum(n1 - (bit == 1), 0)
            x[:, i] = np.log((n1 + 0.05) / (n0 + 0.05))
            gate = np.where(n0 + n1 > 0, i + 1, gate)
        np.clip(x, -12, 12, out=x)
        x[:, -1] = 0.3
        return x, gate * 8 + place

    @staticmethod
    def bucket(z: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return prefix * BUCKETS + np.clip(np.rint(z * 2), -16, 16).astype(np.int64) + 16

    def learn(self, keys: np.ndarray, count: np.ndarray, step: float = 0.4, batch: int = 1 << 15) -> None:
        """Online learning of the weights over the keys, batch by batch, and of the refinement."""
        scale = np.full((GATES, INPUTS), 1.0)
        for a in range(0, len(keys), batch):
            k, n = keys[a : a + batch], count[a : a + batch].astype(float)
            for place, bit, at in slots(k):
                x, gate = self.inputs(place, bit, at, True)
                z = np.einsum("ij,ij->i", x, self.weights[gate])
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                err = (bit - p) * n
                grad = np.stack([np.bincount(gate, weights=err * x[:, j], minlength=GATES) for j in range(INPUTS)], axis=1)
                mass = np.bincount(gate, weights=n, minlength=GATES)[:, None] + 1e-9
                grad /= mass
                scale += grad**2
                self.weights += step * grad / np.sqrt(scale) * (mass > 1)
                prefix = (1 << place) | ((k & np.uint64(255)) >> np.uint64(8 - place)).astype(np.int64)
                b = self.bucket(z, prefix)
                self.refine[:, 0] += np.bincount(b, weights=n * bit, minlength=len(self.refine))
                self.refine[:, 1] += np.bincount(b, weights=n, minlength=len(self.refine))

    def frozen(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """What scoring needs: counts as stretched predictions, which take a quarter of the room (0 stands for unseen), weights, refinement."""
        out = []
        for t in self.tables:
            n0, n1 = t[:, 0].astype(np.float32), t[:, 1].astype(np.float32)
            x = np.clip(np.log((n1 + 0.05) / (n0 + 0.05)), -12, 12)
            x[(x == 0) & (n0 + n1 > 0)] = 1e-4
            out.append(x.astype(np.float16).tobytes())
        grid = 1 / (1 + np.exp(-(np.arange(256 * BUCKETS) % BUCKETS - 16) / 2.0))
        refined = ((self.refine[:, 0] + 40 * grid) / (self.refine[:, 1] + 40)).astype(np.float32)
        return zlib.compress(b"".join(out), 1), self.weights, refined

    @staticmethod
    def thawed(data: bytes, weights: np.ndarray, refined: np.ndarray) -> Mixer:
        model, flat = Mixer([]), np.frombuffer(zlib.decompress(data), np.float16)
        ends = np.cumsum([1 << b for b in TABLE_BITS])
        model.stretched = [flat[e - (1 << b) : e] for e, b in zip(ends, TABLE_BITS, strict=True)]
        model.weights, model.refined = weights, refined
        return model

    def log10(self, keys: np.ndarray, batch: int = 1 << 15) -> np.ndarray:
        """log10 probability of each key's last byte after those before it."""
        return np.concatenate([self._log10(keys[a : a + batch]) for a in range(0, len(keys), batch)] or [np.zeros(0)])

    def _log10(self, keys: np.ndarray) -> np.ndarray:
        weights = self.weights.astype(np.float32)
        total = np.ones(len(keys))
        for place, bit, at in slots(keys):
            x = [t[s].astype(np.float32) for t, s in zip(self.stretched, at, strict=True)]
            gate = np.zeros(len(keys), np.int64)
            for i, v in enumerate(x):
                gate[v != 0] = i + 1
            gate = gate * 8 + place
            z = weights[:, -1][gate] * np.float32(0.3)
            for i, v in enumerate(x):
                z += weights[:, i][gate] * v
            np.clip(z, -16, 16, out=z)
            prefix = (1 << place) | ((keys & np.uint64(255)) >> np.uint64(8 - place)).astype(np.int64)
            p = (1 / (1 + np.exp(-z)) + self.refined[self.bucket(z, prefix)]) / 2
            p = np.clip(p, 1e-6, 1 - 1e-6)
            total *= np.where(bit == 1, p, 1 - p)
        return np.log10(total)


class Known:
    """log10 probabilities of keys that a task has met lately, as many recur."""

    def __init__(self, model: Mixer, most: int = 2_000_000) -> None:
        self.model, self.most = model, most
        self.keys, self.logs = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)  # sorted keys find their places without jumps
        keys = keys[order]
        at = np.searchsorted(self.keys, keys)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == keys[hit]
        out = np.empty(len(keys), np.float32)
        out[hit] = self.logs[at[hit]]
        fresh = keys[~hit]
        out[~hit] = new = self.model.log10(fresh)
        if len(self.keys) + len(fresh) > self.most:
            self.keys, self.logs = keys, out
        else:
            self.keys, self.logs = np.insert(self.keys, at[~hit], fresh), np.insert(self.logs, at[~hit], new)
        back = np.empty(len(keys))
        back[order] = out
        return back


def counted(keys: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurred."""
    if count is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, count = keys[order], count[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.concatenate((at, [len(keys)]))) if count is None else np.add.reduceat(count, at) if len(at) else count


class Distinct:
    """Distinct keys and how often each occurred."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(counted(keys))
        self.held += len(self.parts[-1][0])
        if self.held > 2_000_000:
            self.parts = [self.take()]
            self.held = len(self.parts[0][0])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return counted(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))


ROWS = "part int, row int, source long, payload binary"


def packed(part: int, row: int, x: np.ndarray) -> tuple[int, int, bytes]:
    return part, row, zlib.compress(np.ascontiguousarray(x, np.float64 if part < 0 else np.uint64).tobytes(), 1)


def summed(rows: DataFrame) -> DataFrame:
    """Adds up payloads by (part, row) in a tree whose steps take FAN_IN rows or so each."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = np.float64 if pdf["part"].iloc[0] < 0 else np.uint64
        total = np.zeros(1, kind)
        for x in pdf["payload"]:
            total = total + np.frombuffer(zlib.decompress(x), kind)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "row": pdf["row"].iloc[:1], "source": pdf["source"].iloc[:1], "payload": [zlib.compress(total.tobytes(), 1)]})

    n = rows.select("source").distinct().count()
    while n > FAN_IN:
        n = -(-n // (FAN_IN // 2))
        rows = cut(rows.groupBy("part", "row", F.pmod(F.xxhash64("source", F.lit(n)), F.lit(n)).alias("g")).applyInPandas(lambda pdf: add(pdf), ROWS), "sums")
    return rows.groupBy("part", "row").applyInPandas(lambda pdf: add(pdf), ROWS)


def emit(rows: list[tuple[int, int, bytes]], source: int) -> pa.RecordBatch:
    part, row, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(row, pa.int32()), pa.array([source] * len(part), pa.int64()), pa.array(payload, pa.binary())], names=["part", "row", "source", "payload"])


def task_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def gathered(texts: DataFrame) -> DataFrame:
    """One pass over texts: rows (word, c) of words' hashes counted task by task, the end among them, and rows with a bucket
    and a payload of distinct keys and how often each occurred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, ends = Distinct(), Distinct(), 0

        def word_rows(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            n = len(h)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["word", "c", "bucket", "payload"])

        def key_rows() -> pa.RecordBatch:
            keys, count = seen.take()
            bucket = (scrambled(keys) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")  # keys stay in order within their bucket
            cuts = np.searchsorted(bucket[order], np.arange((1 << BUCKET_BITS) + 1))
            found = [(i, packed_keys(keys[order[a:z]], count[order[a:z]])) for i, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if z > a]
            n = len(found)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([i for i, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["word", "c", "bucket", "payload"]
            )

        for _, lines in lines_of(batches, 0):
            words.add(lines.hashes)
            ends += len(lines.sizes)
            seen.add(lines.keys())
            if words.held > 1_500_000 and len(words.parts) == 1:
                yield word_rows(*words.take())
                words = Distinct()
            if seen.held > 1_500_000 and len(seen.parts) == 1:
                yield key_rows()
                seen = Distinct()
        yield word_rows(*words.take())
        if ends:
            yield word_rows(np.array([END], np.uint64), np.array([ends]))
        if seen.parts:
            yield key_rows()

    return cut(texts.select("text").mapInArrow(run, "word long, c long, bucket int, payload binary"), "gathered")


def merged(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Payloads of fewer keys that say the same as those of rows: about fan_in payloads of one bucket become one."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked_keys(x) for x in pdf["payload"]]
        keys, count = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return pd.DataFrame({"payload": [packed_keys(keys, count)]})

    most = rows.groupBy("bucket").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    group = F.pmod(F.xxhash64("payload"), F.lit(-(-most // fan_in)))
    return cut(rows.groupBy("bucket", group.alias("g")).applyInPandas(lambda pdf: add(pdf), "payload binary"), "stretches")


def packed_keys(keys: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts."""
    return zlib.compress(np.diff(keys, prepend=np.uint64(0)).tobytes() + count.astype(np.uint64).tobytes(), 1)


def unpacked_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 16
    return np.cumsum(np.frombuffer(raw[: 8 * n], np.uint64)), np.frombuffer(raw[8 * n :], np.uint64).astype(np.int64)


def bit_counts(rows: DataFrame) -> list[np.ndarray]:
    """The tables, counted over all keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((1 << b) * 2, np.uint64) for b in TABLE_BITS]
        for b in batches:
            for data in b.column(0):
                keys, count = unpacked_keys(data.as_py())
                for _, bit, at in slots(keys):
                    for t, s in zip(tables, at, strict=True):
                        np.add.at(t, s * 2 + bit, count.astype(np.uint64))
        found = [packed(p, r, x) for p, t in enumerate(tables) for r, x in enumerate(t.reshape(-1, ROW_SLOTS * 2)) if x.any()]
        if found:
            yield emit(found, task_id())

    tables = [np.zeros((1 << b, 2), np.float32) for b in TABLE_BITS]
    for r in summed(cut(rows.mapInArrow(run, ROWS), "bit_counts")).toLocalIterator():
        tables[r.part][r.row * ROW_SLOTS : (r.row + 1) * ROW_SLOTS] = np.frombuffer(zlib.decompress(r.payload), np.uint64).reshape(-1, 2)
    return tables


def ship(tables: list[np.ndarray]) -> bytes:
    """Tables as half-precision numbers: counts need no more digits, and larger ones keep their ratio."""
    out = []
    for t in tables:
        top = np.maximum(t.max(axis=1, keepdims=True) / 60_000, 1)
        out.append((t / top).astype(np.float16))
    return zlib.compress(b"".join(t.tobytes() for t in out), 1)


def unship(data: bytes) -> list[np.ndarray]:
    flat = np.frombuffer(zlib.decompress(data), np.float16)
    ends = np.cumsum([2 << b for b in TABLE_BITS])
    return [flat[e - (2 << b) : e].reshape(-1, 2) for e, b in zip(ends, TABLE_BITS, strict=True)]


def train(rows: DataFrame) -> Mixer:
    """The model from rows of keys."""
    mixer = Mixer(bit_counts(rows))
    sent = rows.sparkSession.sparkContext.broadcast(ship(mixer.tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        mass = 0
        for b in batches:
            for payload in b.column(0):
                model = model or Mixer(unship(sent.value))
                keys, count = unpacked_keys(payload.as_py())
                mass += int(count.sum())
                order = np.argsort(scrambled(keys), kind="stable")
                model.learn(keys[order], count[order])
        if model is None:
            return
        weights = np.concatenate((model.weights * mass, np.full((GATES, 1), mass)), axis=1)
        found = [packed(-1, g, w) for g, w in enumerate(weights)]
        found += [packed(-2, g, w) for g, w in enumerate(model.refine.reshape(256, -1))]
        yield emit(found, task_id())

    for r in summed(cut(rows.mapInArrow(run, ROWS), "weights")).toLocalIterator():
        x = np.frombuffer(zlib.decompress(r.payload), np.float64)
        if r.part == -1:
            mixer.weights[r.row] = x[:-1] / x[-1]
        else:
            mixer.refine[r.row * BUCKETS : (r.row + 1) * BUCKETS] = x.reshape(-1, 2)
    return mixer


def frequent(counts: DataFrame, most: int = FREQUENT_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of the most frequent words, at most `most`: all at least as frequent as some power of 2^(1/8)."""
    size = F.floor(F.log2(F.col("c").cast("double")) * 8)
    held, low = 0, None
    for r in counts.groupBy(size.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect():
        held += r.n
        if held > most:
            break
        low = r.s
    if low is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    got = counts.where(size >= low).select("word", "c").toArrow()
    h, c = got["word"].to_numpy().view(np.uint64), got["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order].astype(float)


def score(docs: DataFrame, training: Callable[[Column], Column] = lambda d: ~held_out(d)) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = slim.where(training(F.col("doc_id"))).select("text")
    gathered_rows = gathered(texts)
    counts = cut(gathered_rows.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")), "word_counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    z = total + 1 * (distinct + 1)
    known = spark.sparkContext.broadcast(frequent(counts))
    end = counts.where(F.col("word") == END).first()
    end_log, end_known = float(np.log10((end.c if end else 0) + 1) - np.log10(z)), int(end is not None)
    model_data = spark.sparkContext.broadcast(train(merged(gathered_rows.where("payload is not null").select("bucket", "payload"))).frozen())
    logs = {"z": float(np.log10(z))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_logs = Known(Mixer.thawed(*model_data.value))
        next_row = task_id() << 40
        words, word_logs = known.value[0], np.append(np.log10(known.value[1] + 1) - logs["z"], np.nan)
        kinds = dict(zip(SCORED, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True))

        def batch(size_: int, **cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(size_, k) for c, k in kinds.items()], names=SCORED)

        for b, lines in lines_of(batches, 2):
            n = len(lines.sizes)
            codes, found = pd.factorize(lines.keys())
            values = known_logs(found)[codes]
            row = np.arange(n) + next_row
            next_row += n
            doc = np.repeat(np.arange(n), lines.sizes)
            ids, names = pd.factorize(lines.hashes)
            at = np.searchsorted(words, names)
            at[at == len(words)] = 0
            own = word_logs[np.where(words[at] == names, at, -1) if len(words) else np.full(len(names), -1)][ids]
            hit = ~np.isnan(own)
            hits = np.bincount(doc, weights=hit, minlength=n).astype(np.int64) + end_known
            base = np.bincount(doc, weights=np.where(hit, own, 0), minlength=n) + end_log
            yield batch(n, row=row, doc_id=b.column(0), n=lines.sizes + 1, hits=hits, base=base, score=np.add.reduceat(values, lines.line_starts), n_bytes=lines.line_sizes)
            rare, k = np.unique(doc[~hit] * max(1, len(names)) + ids[~hit], return_counts=True)
            yield batch(len(rare), row=row[rare // max(1, len(names))], word=names[rare % max(1, len(names))].view(np.int64), n=k)
            at, chunk, place, first = lines.chunks()
            if not len(at):
                continue
            values[lines.line_starts[lines.line_sizes == 1]] = 0.0  # empty lines belong to no chunk
            log = np.add.reduceat(values, place)
            take = np.flatnonzero(~first)
            at, prior, chunk, log = at[take], chunk[take - 1], chunk[take], log[take]
            seed = at.astype(np.uint64) * np.uint64(PRIME)
            _, inv, same = np.unique(mixed(seed ^ prior), return_inverse=True, return_counts=True)
            _, inv2, pair = np.unique(mixed(mixed(seed ^ prior) + chunk), return_inverse=True, return_counts=True)
            train = b.column(1).to_numpy(zero_copy_only=False)[at]
            yield batch(len(at), row=row[at], train=train, score=log, p=prior.view(np.int64), s=chunk.view(np.int64), k=pair[inv2].astype(np.int32), kp=same[inv].astype(np.int32))

    schema = "row long, doc_id long, train boolean, word long, n long, hits long, base double, score double, n_bytes long, p long, s long, k int, kp int"
    found = cut(slim.select("doc_id", training(F.col("doc_id")).alias("train"), "text").mapInArrow(run, schema), "scores")
    rare = found.where("word is not null").select("row", "word", "n").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0).cast("long"))
    rest = rare.groupBy("row").agg(F.sum(F.col("n") * (F.log10(c + F.lit(1.0)) - F.lit(logs["z"]))).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(F.lit(0))).alias("more_hits"))
    gains = chunk_gains(found.where("p is not null").select("row", "train", "p", "s", "k", "kp", F.col("score").alias("log")))
    zero = F.lit(0)
    whole = found.where("word is null and p is null").drop("train", "word", "p", "s", "k", "kp")
    mixed_score = F.col("score") + F.coalesce("gain", F.lit(0.0))
    return whole.join(rest, "row", "left").join(gains, "row", "left").select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("hits") + F.coalesce("more_hits", zero)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        mixed_score.alias("score"),
        "n_bytes",
        (-mixed_score / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


SCORED = ["row", "doc_id", "train", "word", "n", "hits", "base", "score", "n_bytes", "p", "s", "k", "kp"]


def chunk_gains(rows: DataFrame) -> DataFrame:
    """(row, gain): what mixing in the chunk counts adds to each text's log10 probability; texts without gain may be missing.

    rows holds a row for each chunk: its text's row and whether that trains, hashes p of the chunk before and s of its own, how
    often the text has that pair (k) and that chunk before (kp), and log, the log10 probability of its bytes.
    """
    one = F.when(F.col("train"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    # contexts that stand in one place only, or in no training text, predict nothing
    contexts = rows.groupBy("p").agg(F.sum(one).alias("all"), F.count("*").alias("places")).where("places > 1 and all > 0").select("p", "all")
    held = cut(rows.join(contexts, "p"), "chunks")
    pairs = held.groupBy("p", "s").agg(F.sum(one).alias("c"))
    own = lambda x, k: F.when(F.col("train"), F.col(x) - F.col(k)).otherwise(F.col(x))
    met = held.join(pairs, ["p", "s"]).select("row", "train", "log", own("c", "k").alias("c"), own("all", "kp").alias("of")).where("of > 0")
    met = cut(met.withColumn("gate", F.least(F.floor(F.log2(F.col("of").cast("double"))), F.lit(CHUNK_GATES - 1)).cast("int")), "chunk_counts")
    # a chunk's bytes have next to no probability beside its count's, so the best weight of a gate is the share of its hits
    share = (F.sum(F.when(F.col("c") > 0, F.lit(1.0)).otherwise(F.lit(0.0))) + 0.5) / (F.count("*") + 1.0)
    weight = {r.gate: float(r.w) for r in met.where("train").groupBy("gate").agg(share.alias("w")).collect()}
    if not weight:
        return met.select("row", F.lit(0.0).alias("gain")).limit(0)
    g = F.element_at(F.array(*[F.lit(min(0.999, weight.get(i, 0.5))) for i in range(CHUNK_GATES)]), F.col("gate") + 1)
    low = F.log10(1 - g) + F.col("log")
    high = F.log10(g * F.col("c") / F.col("of"))
    mix = F.when(F.col("c") == 0, low).otherwise(F.greatest(low, high) + F.log10(1 + F.pow(F.lit(10.0), F.least(low, high) - F.greatest(low, high))))
    return met.groupBy("row").agg(F.sum(mix - F.col("log")).alias("gain"))


def query(spark, sf_dir: str) -> DataFrame:
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
