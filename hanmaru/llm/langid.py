"""Language identification with interpolated Kneser-Ney character models.

Each language has a character model of order ORDER. Highest-order counts are raw; lower orders count distinct left
contexts; every order is discounted and interpolated with the next. All counts of a model lie in sorted arrays of 64-bit
n-gram hashes that binary search reads. A text gets the language of lowest cross-entropy per character. Scores are
calibrated on training texts: the margin to the runner-up, scaled so that the score is the share of right answers; a text
whose best entropy lies far above that of training texts is rejected (`accepted` is false) and its score lowered.

Characters are letters in lower case; a run of anything else is one space. Models are fitted on a bounded sample of
training texts: at most DOCS_PER_LANG whole texts a language in order of a hash of doc_id, or MAX_CHARS of their characters
(a text that goes beyond is still used whole). Every language among the training texts gets a model.

Fixed cases: null texts and texts without a letter are `und` with score 0; a null lang teaches nothing; a null doc_id
counts as the empty string for the split; repeated rows are predicted alike; without training texts all is `und`; of equal
entropies the language first in code-point order wins; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = 5
#: Bounds of the labelled sample that the models are fitted on, a language.
DOCS_PER_LANG, MAX_CHARS = 400, 1_500_000
#: Characters that are worked on at once.
CHUNK = 2_000_000
DISCOUNT = 0.75
_P = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


class Letters:
    """Maps code points to lower-case letters, and all else to a space."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, text: str) -> np.ndarray:
        """The text's characters: letters in lower case, runs of others as one space, one space at either end."""
        if cls.table is None:
            t = np.full(0x110000, 32, np.uint32)
            for c in range(0x110000):
                if (x := chr(c)).isalpha():
                    low = x.lower()
                    t[c] = ord(low) if len(low) == 1 else c
            cls.table = t
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.concatenate((np.array([32], np.uint32), cls.table[raw], np.array([32], np.uint32)))
        return x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]


def hashes(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place from n - 1 on."""
    h = np.zeros(len(x) - n + 1, np.uint64) + np.uint64(n)
    for k in range(n):
        h = h * _P + x[k : len(x) - n + 1 + k].astype(np.uint64)
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Level:
    """One order of a model: sorted hashes of n-grams with their counts, and of contexts with total and distinct followers."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray


def find(table: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    """values at the places of h in the sorted table, 0 where h is missing."""
    if not len(table):
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, values[at], 0.0)


class KneserNey:
    """An interpolated Kneser-Ney model over characters."""

    def __init__(self, texts: list[np.ndarray], order: int = ORDER) -> None:
        pad = np.full(order - 1, 32, np.uint32)
        x = np.concatenate([np.concatenate((pad, t)) for t in texts]) if texts else pad
        windows = np.lib.stride_tricks.sliding_window_view(x, order) if len(x) >= order else np.zeros((0, order), np.uint32)
        _, first, count = np.unique(hashes(x, order), return_index=True, return_counts=True) if len(windows) else (None, np.zeros(0, int), np.zeros(0, int))
        grams = windows[first]
        self.size = len(np.unique(x)) + 1
        self.levels: list[Level] = []
        for n in range(order, 0, -1):
            h = self.rows(grams)
            ctx, inv = np.unique(self.rows(grams[:, :-1]), return_inverse=True)
            totals = np.bincount(inv, weights=count, minlength=len(ctx))
            kinds = np.bincount(inv, minlength=len(ctx))
            o = np.argsort(h)
            self.levels.append(Level(h[o], count[o].astype(float), ctx, totals, kinds.astype(float)))
            if n > 1:  # a lower order counts the distinct characters that stand before
                _, first, count = np.unique(self.rows(grams[:, 1:]), return_index=True, return_counts=True)
                grams = grams[first, 1:]

    @staticmethod
    def rows(grams: np.ndarray) -> np.ndarray:
        n = grams.shape[1]
        h = np.zeros(len(grams), np.uint64) + np.uint64(n)
        for k in range(n):
            h = h * _P + grams[:, k].astype(np.uint64)
            h ^= h >> np.uint64(29)
        return h

    def log2(self, grams: np.ndarray) -> np.ndarray:
        """log2 probability of each gram's last character after the others."""
        order = grams.shape[1]
        p = np.full(len(grams), 1.0 / self.size)
        for level, n in zip(reversed(self.levels), range(1, order + 1), strict=True):
            g = grams[:, order - n :]
            c = find(level.grams, level.counts, self.rows(g))
            ctx = self.rows(g[:, :-1])
            total, kinds = find(level.contexts, level.totals, ctx), find(level.contexts, level.kinds, ctx)
            some = np.maximum(total, 1)
            p = np.where(total > 0, np.maximum(c - DISCOUNT, 0) / some + DISCOUNT * kinds / some * p, p)
        return np.log2(p)


class Identifier:
    """Models of several languages with calibrated scores."""

    def __init__(self, langs: list[str], models: list[KneserNey]) -> None:
        self.langs, self.models = langs, models
        self.slope, self.shift, self.worst = 10.0, 0.0, np.inf

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits per character of each text under each model: equal n-grams are looked up once."""
        pad = np.full(ORDER - 1, 32, np.uint32)
        x = np.concatenate([np.concatenate((pad, t)) for t in texts])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        # the window that ends with character j of a text starts ORDER - 1 places before, within its padding
        at = np.arange(sizes.sum()) + np.repeat(np.arange(len(texts)) * (ORDER - 1), sizes)
        codes, found = pd.factorize(hashes(x, ORDER)[at])
        first = np.zeros(len(found), np.int64)
        first[codes[::-1]] = at[::-1]
        grams = np.lib.stride_tricks.sliding_window_view(x, ORDER)[first]
        return np.stack([-np.add.reduceat(m.log2(grams)[codes], starts) / sizes for m in self.models], axis=1)

    def calibrate(self, texts: list[np.ndarray], truth: np.ndarray) -> None:
        """Fits the score's logistic curve to right answers by margin, and the entropy beyond which a text is rejected."""
        e = self.entropies(texts)
        best, margin = e.argmin(axis=1), self.margin(e)
        right = (best == truth).astype(float)
        low = e.min(axis=1)
        self.worst = float(np.quantile(low, 0.995) * 1.25)
        a, b = 10.0, 0.0
        for _ in range(200):  # Newton's method, held near the start where nearly all answers are right
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            g = np.array([((right - p) * margin).sum() - 0.01 * (a - 10), (right - p).sum() - 0.01 * b])
            h = np.array([[(w * margin**2).sum() + 0.01, (w * margin).sum()], [(w * margin).sum(), w.sum() + 0.01]])
            step = np.linalg.solve(h, g)
            a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        self.slope, self.shift = a, b

    @staticmethod
    def margin(e: np.ndarray) -> np.ndarray:
        return np.ones(len(e)) if e.shape[1] == 1 else np.diff(np.partition(e, 1, axis=1)[:, :2], axis=1)[:, 0]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, float | None]]:
        """(lang, score, accepted, bits per character) of each text."""
        out: list[tuple[str, float, bool, float | None]] = [("und", 0.0, False, None)] * len(texts)
        if not self.models:
            return out
        held, at, size = [], [], 0

        def flush() -> None:
            e = self.entropies(held)
            p = 1 / (1 + np.exp(-np.clip(self.slope * self.margin(e) + self.shift, -30, 30)))
            for i, k, s, low in zip(at, e.argmin(axis=1).tolist(), p.tolist(), e.min(axis=1).tolist(), strict=True):
                ok = low <= self.worst
                out[i] = (self.langs[k], s if ok else s / 2, ok, low)

        for i, t in enumerate(texts):
            if t is None or not any(map(str.isalpha, t)):
                continue
            held.append(Letters.of(t))
            at.append(i)
            size += len(held[-1])
            if size >= CHUNK:
                flush()
                held, at, size = [], [], 0
        if held:
            flush()
        return out


def train(docs: DataFrame) -> Identifier:
    """Models of the languages of the documents that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    n = rows.groupBy("lang").count()
    langs = sorted(r.lang for r in n.select("lang").collect())
    texts: dict[str, list[np.ndarray]] = {k: [] for k in langs}
    size = dict.fromkeys(langs, 0)
    # of equal texts one is enough to rank; hashes of id and text tell rows of one id apart
    key = rows.select("lang", F.xxhash64("doc_id", "text", F.lit("langid")).alias("h"), "text")
    order = Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 30)), "h", "text")

    def take(some: DataFrame) -> dict[str, int]:
        """Adds each language's first texts in hash order; returns how many were there."""
        found = dict.fromkeys(langs, 0)
        for r in some.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= DOCS_PER_LANG).orderBy("lang", "nth").toLocalIterator():
            found[r.lang] += 1
            if size[r.lang] < MAX_CHARS and any(map(str.isalpha, r.text)):
                texts[r.lang].append(Letters.of(r.text))
                size[r.lang] += len(texts[r.lang][-1])
        return found

    # a bound on the hash, from the share wanted, comes before any sort; where rows repeat it may leave too few: then without
    wanted = {r.lang: r["count"] for r in n.collect()}
    share = n.select("lang", F.least(F.lit(1.0), F.lit(DOCS_PER_LANG + 4 * DOCS_PER_LANG**0.5 + 50) / F.col("count")).alias("share"))
    got = take(key.join(F.broadcast(share), "lang").where(F.pmod(F.col("h"), F.lit(1 << 30)) <= F.col("share") * (1 << 30)).drop("share"))
    few = [k for k in langs if got[k] < min(DOCS_PER_LANG, wanted[k])]
    if few:
        for k in few:
            texts[k], size[k] = [], 0
        take(key.where(F.col("lang").isin(few)))
    langs = [k for k in langs if texts[k]]
    # a fifth of the texts is kept from the models for calibration, where there are enough
    spare = {k: texts[k][::5] if len(texts[k]) >= 10 else [] for k in langs}
    models = [KneserNey([t for i, t in enumerate(texts[k]) if not spare[k] or i % 5]) for k in langs]
    found = Identifier(langs, models)
    held = [(t, i) for i, k in enumerate(langs) for t in spare[k]]
    if held:
        found.calibrate([h[0] for h in held], np.array([h[1] for h in held]))
    return found


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """(doc_id, lang_pred, score, accepted, bits_per_char), a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                cols = list(zip(*model.predict(part.column(1).to_pylist()), strict=True)) or [[]] * 4
                kinds = (pa.string(), pa.float64(), pa.bool_(), pa.float64())
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", "lang_pred", "score", "accepted", "bits_per_char"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean, bits_per_char double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
