"""Placement of a candidate panel beside its anchor, as Column arithmetic. Y grows upward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP, INSET = 4.0, 6.0


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def panel_origin(anchor: Column, panel: Column, screen: Column, gap: float = GAP, inset: float = INSET) -> Column:
    """struct<x, y>: below the anchor's right end, above it where there is no room, on the roomier side where neither has enough.

    anchor and screen are struct<x, y, w, h>, panel struct<w, h>.
    """
    left, right = screen["x"] + inset, screen["x"] + screen["w"] - inset
    bottom, top = screen["y"] + inset, screen["y"] + screen["h"] - inset
    below, above = anchor["y"] - gap - panel["h"], anchor["y"] + anchor["h"] + gap
    room_below, room_above = F.greatest(anchor["y"] - gap - bottom, F.lit(0.0)), F.greatest(top - above, F.lit(0.0))
    y = F.when(below >= bottom, below).when(above + panel["h"] <= top, above).when(room_below >= room_above, below).otherwise(above)
    x = F.least(F.greatest(anchor["x"] + anchor["w"], left), F.greatest(left, right - panel["w"]))
    return F.struct(x.alias("x"), F.least(F.greatest(y, bottom), F.greatest(bottom, top - panel["h"])).alias("y"))


def valid_anchor(rect: Column, screens: Column) -> Column:
    """Finite, at least one unit high, its middle on some screen."""
    finite = F.lit(True)
    for k in "xywh":
        finite = finite & ~F.isnan(rect[k]) & (F.abs(rect[k]) < float("inf"))
    mx, my = rect["x"] + rect["w"] / 2, rect["y"] + rect["h"] / 2
    on = F.exists(screens, lambda s: (mx >= s["x"]) & (mx < s["x"] + s["w"]) & (my >= s["y"]) & (my < s["y"] + s["h"]))
    return finite & (rect["h"] >= 1) & on


def first_valid(probes: Column, screens: Column, most: int = 9) -> Column:
    """The first valid of at most `most` probed rectangles, null if none is."""
    return F.get(F.filter(F.slice(probes, 1, most), lambda r: valid_anchor(r, screens)), F.lit(0))


def row_width(width: Column, low: float = 176.0, high: float = 560.0) -> Column:
    return clamp(width, F.lit(low), F.lit(high))
