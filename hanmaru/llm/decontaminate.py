"""Benchmark decontamination by pigeonhole edit matching.

A test item within k edits of some stretch of a document, cut into k + 1 pieces, has a piece that occurs there exactly.
All pieces of a block of items go into one Aho-Corasick automaton; every hit names a stretch of the document, which is
verified with Myers' bit-parallel edit distance over the whole item, unless too few of the item's grams occur in it for any
distance within k. Items and texts are compared in lower case with runs
of white space as one space.

Items are a query set in blocks: a block has at most BLOCK_CHARS characters, which bounds what executors receive; a larger
set takes more blocks, each over all documents.

Fixed cases: null and empty items and texts match nothing; items of fewer than MIN_CHARS characters must occur exactly;
repeated items match under their own ids, repeated documents each on their own; of equal distances the earliest stretch is
returned; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of an item's characters that may differ.
ERROR_RATE = 0.08
#: Shorter items are matched exactly.
MIN_CHARS = 40
#: Length of the grams by which a stretch is ruled out before its distance is taken.
GRAM = 5
#: Most characters of items in one block.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = ERROR_RATE) -> int:
    """Edits that an item may take."""
    return int(len(item) * rate) if len(item) >= MIN_CHARS else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item in k + 1 pieces of nearly equal length: (offset, piece)."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Pattern:
    """An item's bit masks for Myers' algorithm: bit i of a character's mask says that it stands at place i."""

    def __init__(self, item: str) -> None:
        self.size = len(item)
        self.all = (1 << self.size) - 1
        self.top = 1 << (self.size - 1)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.grams = [item[i : i + GRAM] for i in range(self.size - GRAM + 1)]

    def possible(self, text: str, k: int) -> bool:
        """Whether k edits can turn a stretch of text into the item: an edit spoils at most GRAM of the item's grams, so all
        others must occur in text."""
        need = len(self.grams) - GRAM * k
        return need <= 0 or sum(map({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}.__contains__, self.grams)) >= need

    def best(self, text: str, k: int) -> tuple[int, int] | None:
        """(distance, end) of the stretch of text nearest to the item, the earliest among equals; None beyond k edits."""
        pv, mv, score, found, mask, all_, top = self.all, 0, self.size, None, self.masks.get, self.all, self.top
        for j, c in enumerate(text):
            eq = mask(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (all_ & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph <<= 1  # a stretch may start anywhere, so the first row costs nothing
            mh <<= 1
            pv = (mh | ~(xv | ph)) & all_
            mv = ph & xv & all_
            if score <= k and (found is None or score < found[0]):
                found = (score, j + 1)
        return found


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE) -> None:
        import ahocorasick

        self.items = [(i, n) for i, t in items if (n := normal(t))]
        self.limits = [budget(n, rate) for _, n in self.items]
        self.patterns: dict[int, Pattern] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for at, ((_, n), k) in enumerate(zip(self.items, self.limits, strict=True)):
            for off, piece in pieces(n, k):
                places.setdefault(piece, []).append((at, off))
        self.trie = ahocorasick.Automaton()
        for piece, own in places.items():
            self.trie.add_word(piece, (len(piece), own))
        if places:
            self.trie.make_automaton()
        self.empty = not places

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item within its budget; positions are in the normal text."""
        line = normal(text)
        if self.empty or not line:
            return []
        found: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, list[int]] = {}
        for last, (size, own) in self.trie.iter(line):
            for at, off in own:
                k, begin = self.limits[at], last + 1 - size - off
                if (got := found.get(at)) is not None and got[0] == 0:
                    continue
                done = tried.setdefault(at, [])
                if any(abs(begin - x) <= k for x in done[-4:]):  # the stretch tried there takes in this one
                    continue
                done.append(begin)
                pattern = self.patterns.get(at)
                if pattern is None:
                    pattern = self.patterns[at] = Pattern(self.items[at][1])
                lo = max(0, begin - 2 * k)
                stretch = line[lo : begin + pattern.size + 2 * k]
                hit = pattern.best(stretch, k) if pattern.possible(stretch, k) else None
                if hit and (got is None or hit[0] < got[0]):
                    end = lo + hit[1]
                    found[at] = (hit[0], max(0, end - pattern.size), end)
        return [(self.items[at][0], *hit) for at, hit in sorted(found.items())]


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items, block by block: at most block_chars characters each, unless one item alone has more."""
    rows = items.where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_chars)) if total > block_chars else 1
    for b in range(n):
        block: list[tuple[int, str]] = []
        size = 0
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).select(F.col("item_id").cast("long").alias("i"), "text")
        for r in part.orderBy("i", "text").toLocalIterator():
            if size + len(r.text) > block_chars and block:
                yield block
                block, size = [], 0
            block.append((r.i, r.text))
            size += len(r.text)
        if block:
            yield block


def matches(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end): one row for each document and item that match, at the nearest stretch."""
    schema = "doc_id long, item_id long, distance long, start long, end long"
    names = ["doc_id", "item_id", "distance", "start", "end"]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = slim.limit(0).select("doc_id", *[F.lit(0).cast("long").alias(n) for n in names[1:]])
    for block in item_blocks(items, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for b in batches:
                rows = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for m in matcher.find(t.as_py())]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        out = out.unionByName(slim.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the documents in which an item occurs. Judged row by row: neither ids nor text are shuffled."""
    out = docs
    for block in item_blocks(items, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for b in batches:
                at = b.schema.get_field_index("text")
                yield b.filter(pa.array([not matcher.find(t.as_py()) for t in b.column(at)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
