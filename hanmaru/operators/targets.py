"""Which text a manual conversion is about: the Hangul left of the caret, the selection, or the text being composed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import hangul_tail, utf16_length

#: White space that a selection must not consist of.
BLANK = r"^[\s\x85\p{Z}]*$"


def _target(text: Column, loc: Column, caret: Column) -> Column:
    return F.struct(text.alias("text"), loc.cast("long").alias("loc"), utf16_length(text).alias("len"), caret.cast("long").alias("anchor"))


def from_left_context(context: Column, loc: Column, size: Column, caret: Column) -> Column:
    """struct<text, loc, len, anchor>: the run of Hangul that ends at the caret; null if ranges disagree or there is none."""
    tail = hangul_tail(context)
    fine = (utf16_length(context) == size) & (loc + size == caret) & (tail != "")
    return F.when(fine, _target(tail, caret - utf16_length(tail), caret))


def from_selection(text: Column, loc: Column, size: Column) -> Column:
    """The whole selection, unless it is empty or blank or its length disagrees."""
    fine = loc.isNotNull() & (utf16_length(text) == size) & (size > 0) & ~text.rlike(BLANK)
    return F.when(fine, _target(text, loc, loc + size))


def from_composition(committed: Column, c_loc: Column, c_size: Column, marked: Column, m_loc: Column, m_size: Column) -> Column:
    """The run of Hangul that ends with the marked text and may start in the committed text before it."""
    tail = hangul_tail(F.concat(committed, marked))
    fine = (marked != "") & (utf16_length(committed) == c_size) & (utf16_length(marked) == m_size) & (c_loc + c_size == m_loc) & (tail != "")
    end = m_loc + m_size
    return F.when(fine, _target(tail, end - utf16_length(tail), end))


def chosen(composition: Column, selection: Column, left: Column) -> Column:
    """The source that comes first: composition, selection, text left of the caret."""
    return F.coalesce(composition, selection, left)


def trigger_outcome(realtime: Column, status: Column, target: Column) -> Column:
    """What a trigger leads to: 'blocked', 'no_target', 'loading', 'unavailable' or 'panel', in this order of precedence."""
    return (
        F.when(realtime, "blocked").when(target.isNull(), "no_target").when(status.isin("uninitialized", "loading"), "loading").when(status == "unavailable", "unavailable").otherwise("panel")
    )
