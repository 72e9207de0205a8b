"""Pages and navigation over ranked candidates, as Column arithmetic. Highlight and page count from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 9


def page_of(rn: Column, size: int = PAGE_SIZE) -> Column:
    """Page of the row of rank rn (from 1)."""
    return F.floor((rn - 1) / size).cast("long")


def label_of(rn: Column, size: int = PAGE_SIZE) -> Column:
    """Number shown beside the row, from 1."""
    return (F.pmod(rn - 1, F.lit(size)) + 1).cast("long")


def page_count(n: Column, size: int = PAGE_SIZE) -> Column:
    return F.ceil(n / size).cast("long")


def row_at(page: Column, index: Column, n: Column, size: int = PAGE_SIZE) -> Column:
    """Row that number key `index` (from 0) picks on a page; null if the page has no such row."""
    at = page * size + index
    return F.when((index >= 0) & (index < size) & (at < n), at).cast("long")


def initial(highlight: Column, page: Column, n: Column, size: Column) -> Column:
    """struct<size, highlight, page>: a panel's start brought into range; the page wins over the highlight."""
    s = F.greatest(size, F.lit(1))
    last = F.greatest(F.ceil(n / s) - 1, F.lit(0))
    p = F.least(F.greatest(page, F.lit(0)), last)
    h = F.least(F.greatest(highlight, F.lit(0)), F.greatest(n - 1, F.lit(0)))
    on_page = (F.floor(h / s) == p) | (n == 0)
    return F.struct(s.cast("long").alias("size"), F.when(on_page, h).otherwise(p * s).cast("long").alias("highlight"), p.cast("long").alias("page"))


def ring_move(highlight: Column, hangul: Column, delta: Column, n: Column, page: Column, size: int = PAGE_SIZE, key_row: Column | None = None) -> Column:
    """struct<highlight, hangul, page> after moving in the ring of n candidates and, where key_row holds, the row of the key itself.

    The page follows only a candidate. On the key's row the page stays, and the highlight is the candidate passed last. Without
    candidates the key's row loses the highlight; a move by 0 changes nothing.
    """
    ring = n + (F.lit(1) if key_row is None else key_row.cast("int"))
    # from the key's row, which stands behind the last candidate, a step up leads to the first and a step down to the last
    before = F.when(hangul & (delta > 0), -1).when(hangul, n).otherwise(highlight)
    at = F.pmod(before + delta, F.greatest(ring, F.lit(1)))
    lands = (at == n) & (n < ring)
    passed = F.when(delta > 0, n - 1).otherwise(F.lit(0))
    still = (delta == 0) | (n == 0)
    return F.struct(
        F.when(still, highlight).when(lands, passed).otherwise(at).cast("long").alias("highlight"),
        F.when(n == 0, F.lit(False)).when(still, hangul).otherwise(lands).alias("hangul"),
        F.when(still | lands, page).otherwise(F.floor(at / size)).cast("long").alias("page"),
    )


def page_move(page: Column, delta: Column, n: Column, size: int = PAGE_SIZE) -> Column:
    """struct<page, highlight> after turning pages round; the highlight is the page's first row."""
    count = F.greatest(page_count(n, size), F.lit(1))
    p = F.pmod(page + delta, count)
    return F.struct(p.cast("long").alias("page"), F.least(p * size, F.greatest(n - 1, F.lit(0))).cast("long").alias("highlight"))


def start_on_hangul(numeric: Column, prefer: Column) -> Column:
    """Numbers start on the key itself, words where it is preferred."""
    return numeric | prefer


def with_preview_index(panels: DataFrame, ranked: DataFrame, key: str) -> DataFrame:
    """panels (key, preview) with preview_index, the place of the candidate whose value is the preview: an equi-join; null if there is none."""
    at = ranked.groupBy(F.col(key).alias("key__"), F.col("value").alias("value__")).agg((F.min("rn") - 1).cast("long").alias("preview_index"))
    return panels.join(at, (panels[key] == at["key__"]) & (panels["preview"] == at["value__"]), "left").drop("key__", "value__")


def start_row(kept: Column, preview: Column, default: Column) -> Column:
    """Highlighted row: the one kept from before, else the preview's, else the default."""
    return F.coalesce(kept, preview, default)
