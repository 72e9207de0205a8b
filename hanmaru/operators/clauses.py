"""What a clause shows and how its segments are picked: preview, display offsets, boundaries, locks, selection.

Segments of a clause come as array<struct<idx, loc, len, surface, is_convertible, preview>>. Offsets are UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import utf16_length, utf16_slice


def spliced(text: Column, segs: Column) -> Column:
    """struct<text, places>: the text with previews in place of their stretches, and where each segment stands in it.

    Segments go in order of place, the shorter first; one that starts before the last one's end is skipped.
    """
    order = F.array_sort(F.transform(segs, lambda s: F.struct(s["loc"].alias("loc"), s["len"].alias("len"), s["idx"].alias("idx"), s["preview"].alias("preview"))))
    empty = F.array().cast("array<struct<idx:int,loc:bigint,len:bigint>>")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("cur"), F.lit(0).cast("long").alias("shown"), empty.alias("places"))

    def step(acc: Column, s: Column) -> Column:
        own = utf16_slice(text, s["loc"], s["len"])
        gap = utf16_slice(text, acc["cur"], s["loc"] - acc["cur"])
        show = F.coalesce(s["preview"], own)
        at, size = acc["shown"] + s["loc"] - acc["cur"], utf16_length(show)
        place = F.struct(s["idx"].cast("int").alias("idx"), at.alias("loc"), size.alias("len"))
        nxt = F.struct(F.concat(acc["out"], gap, show).alias("out"), (s["loc"] + s["len"]).alias("cur"), (at + size).alias("shown"), F.concat(acc["places"], F.array(place)).alias("places"))
        return F.when(own.isNotNull() & (acc["cur"] <= s["loc"]), nxt).otherwise(acc)

    def finish(acc: Column) -> Column:
        rest = utf16_slice(text, acc["cur"], utf16_length(text) - acc["cur"])
        return F.struct(F.concat(acc["out"], rest).alias("text"), acc["places"].alias("places"))

    return F.aggregate(order, start, step, finish)


def preview_text(text: Column, segs: Column) -> Column:
    return F.when(F.size(segs) > 0, spliced(text, segs)["text"]).otherwise(text)


def display_places(text: Column, segs: Column) -> Column:
    """array<struct<idx, loc, len>> of the segments within the preview."""
    return spliced(text, segs)["places"]


def seeded_boundaries(text: Column, segs: Column) -> Column:
    """Inner boundaries of the segments, each once and in order."""
    n = utf16_length(text)
    ends = F.flatten(F.transform(segs, lambda s: F.array(s["loc"].cast("long"), (s["loc"] + s["len"]).cast("long"))))
    return F.array_sort(F.array_distinct(F.filter(ends, lambda p: (p > 0) & (p < n))))


def moved_boundary(text: Column, boundaries: Column, focus: Column, delta: int) -> Column:
    """Boundaries after the right edge of the span that starts at focus moves by delta (+1 or -1) characters.

    Growing stops at the next boundary, which then goes; the last span can't grow. A span keeps one character; the last one
    shrinks by a new boundary. Whatever can't move stays.
    """
    n = utf16_length(text)
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform(boundaries, lambda b: b.cast("long")), F.array(n))
    i = F.array_position(edges, focus.cast("long")).cast("int")  # from 1; 0 if focus is no edge
    right, beyond = F.get(edges, i), F.get(edges, i + 1)
    left = F.get(edges, i - 1)
    inner = lambda e: F.filter(e, lambda p: (p > 0) & (p < n))
    without = F.filter(edges, lambda p: p != right)
    if delta > 0:
        to = right + utf16_length(F.nullif(F.regexp_extract(utf16_slice(text, right, n - right), r"^\X", 0), F.lit("")))
        grown = F.when(F.least(to, beyond) == beyond, without).otherwise(F.array_sort(F.concat(without, F.array(to))))
        fine = (i >= 1) & right.isNotNull() & beyond.isNotNull() & to.isNotNull()
        return F.when(fine, inner(grown)).otherwise(inner(edges))
    to = right - utf16_length(F.regexp_extract(utf16_slice(text, left, right - left), r"\X\z", 0))
    fine = (i >= 1) & right.isNotNull() & (to > left)
    base = F.when(right == n, edges).otherwise(without)
    return F.when(fine, inner(F.array_sort(F.concat(base, F.array(to))))).otherwise(inner(edges))


def default_selection(segs: Column) -> Column:
    """idx of the first convertible segment."""
    return F.array_min(F.transform(F.filter(segs, lambda s: s["is_convertible"]), lambda s: s["idx"]))


def moved_selection(segs: Column, current: Column, delta: int, wraps: bool) -> Column:
    """idx of the next or previous convertible segment; at the ends it wraps or stays."""
    ids = F.transform(F.filter(segs, lambda s: s["is_convertible"]), lambda s: s["idx"])
    if delta > 0:
        ahead, turn = F.array_min(F.filter(ids, lambda k: k > current)), F.array_min(ids)
    else:
        ahead, turn = F.array_max(F.filter(ids, lambda k: k < current)), F.array_max(ids)
    return F.coalesce(ahead, turn if wraps else current)


def kept_selection(segs: Column, focus: Column, manual: Column, lock: Column) -> Column:
    """idx after analysis: the focused start in manual mode, else the segment with the same key if still convertible, else the default.

    lock is struct<loc, surface, lookup_key> of the segment selected before.
    """
    focused = F.get(F.filter(segs, lambda s: s["loc"] == focus), F.lit(0))["idx"]
    same = F.get(F.filter(segs, lambda s: (s["loc"] == lock["loc"]) & (s["surface"] == lock["surface"]) & (s["lookup_key"] == lock["lookup_key"])), F.lit(0))
    return F.coalesce(F.when(manual, focused), F.when(~manual & same["is_convertible"], same["idx"]), default_selection(segs))


def reconciled(segments: DataFrame, locks: DataFrame) -> DataFrame:
    """Segments with locks applied: a Hangul lock takes the preview away, else a candidate lock sets it."""
    key = ["clause_id", "loc", "surface", "lookup_key"]
    own = locks.groupBy(*key).agg(F.max(F.col("kind") == "hangul").alias("hangul"), F.max(F.when(F.col("kind") == "hanja", F.col("value"))).alias("locked"))
    shown = F.when(F.coalesce("hangul", F.lit(False)), F.lit(None)).otherwise(F.coalesce("locked", "preview"))
    return segments.join(own, key, "left").withColumn("preview", shown).drop("hangul", "locked")


def surviving(locks: DataFrame, segments: DataFrame) -> DataFrame:
    """Locks or pending choices whose segment is still there."""
    return locks.join(segments, ["clause_id", "loc", "surface", "lookup_key"], "left_semi")
