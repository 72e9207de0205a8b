"""Where text goes in the host: the replacement range as a fold over a client's range events.

A range is struct<loc, len> with a null loc for "not found". The state is none, initial-selection (where composition began
or text was last inserted), client-marked (the host shows the marked text there), or implicit (the host decides).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "struct<mode:string,loc:bigint,len:bigint>"


def state(mode: str, loc: Column | None = None, size: Column | None = None) -> Column:
    none = F.lit(None).cast("bigint")
    return F.struct(F.lit(mode).alias("mode"), (none if loc is None else loc.cast("bigint")).alias("loc"), (none if size is None else size.cast("bigint")).alias("len"))


def after(s: Column, e: Column) -> Column:
    """State after event e, struct<kind, loc, len, text_len>."""
    begun = F.when(s["mode"] == "none", state("initial-selection", e["loc"], e["len"])).otherwise(s)
    synced = F.when(e["loc"].isNotNull(), state("client-marked", e["loc"], e["len"])).otherwise(state("implicit"))
    inserted = F.when(e["loc"].isNotNull(), state("initial-selection", e["loc"] + e["text_len"], F.lit(0))).otherwise(state("implicit"))
    cleared = F.when(s["mode"] == "client-marked", state("initial-selection", s["loc"], F.lit(0))).otherwise(s)
    kind = e["kind"]
    return F.when(kind == "begin", begun).when(kind == "sync", synced).when(kind == "insert", inserted).when(kind == "clear", cleared).when(kind == "finish", state("none")).otherwise(s)


# What a stretch of events makes of a state depends on the state's mode alone: it gives a fixed state, or keeps the state, or,
# where a range is marked, keeps its place only. Such maps compose, so stretches are summed up apart and met in a tree.
MAP = f"struct<none:{STATE},initial:{STATE},marked:{STATE},cleared:boolean,implicit:{STATE}>"
#: Numbers of seq that a block spans, and blocks that one above spans.
SPAN = 512


def identity() -> Column:
    """The map of no events; a null state means that the state is kept."""
    keep = F.lit(None).cast(STATE)
    return F.struct(state("none").alias("none"), keep.alias("initial"), keep.alias("marked"), F.lit(False).alias("cleared"), keep.alias("implicit")).cast(MAP)


def map_of(e: Column) -> Column:
    """The map of one event."""
    some = lambda mode: after(state(mode).cast(STATE), e).cast(STATE)
    kept = ~e["kind"].isin("sync", "insert", "finish")
    keep = F.lit(None).cast(STATE)
    fixed = F.when(kept, keep).otherwise(some("implicit"))
    return F.struct(some("none").alias("none"), fixed.alias("initial"), fixed.alias("marked"), (e["kind"] == "clear").alias("cleared"), fixed.alias("implicit")).cast(MAP)


def mapped(f: Column, s: Column) -> Column:
    """What a map makes of a state."""
    cleared = F.struct(F.lit("initial-selection").alias("mode"), s["loc"].alias("loc"), F.lit(0).cast("bigint").alias("len")).cast(STATE)
    marked = F.when(f["marked"].isNotNull(), f["marked"]).when(f["cleared"], cleared).otherwise(s)
    return F.when(s["mode"] == "none", f["none"]).when(s["mode"] == "initial-selection", F.coalesce(f["initial"], s)).when(s["mode"] == "client-marked", marked).otherwise(F.coalesce(f["implicit"], s)).cast(STATE)


def composed(f: Column, g: Column) -> Column:
    """The map of f's events and then g's."""
    then = lambda mine, other: F.when(mine.isNotNull(), mapped(g, mine)).otherwise(other)
    # a range that f cleared starts over at its place: g sees an initial selection there
    of_marked = F.when(f["cleared"], g["initial"]).otherwise(g["marked"])
    still = F.when(f["marked"].isNotNull(), F.lit(False)).when(f["cleared"], g["initial"].isNull()).otherwise(g["cleared"])
    return F.struct(mapped(g, f["none"]).alias("none"), then(f["initial"], g["initial"]).alias("initial"), then(f["marked"], of_marked).alias("marked"), still.alias("cleared"), then(f["implicit"], g["implicit"]).alias("implicit")).cast(MAP)


def _levels(events: DataFrame, span: int) -> tuple[int, int]:
    """(least seq, how many times blocks meet until a client has one): all that is asked of the data beforehand."""
    r = events.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    if r.lo is None:
        return 0, 0
    n, last = 0, (r.hi - r.lo) // span
    while last:
        n, last = n + 1, last // span
    return r.lo, n


def _blocks(events: DataFrame, span: int, base: int) -> DataFrame:
    """Events by client and block, a bounded number in each as long as a client's seq are different."""
    return events.groupBy("client_id", F.floor((F.col("seq") - base) / span).alias("block")).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "loc", "len", "text_len"))).alias("e"))


def _parents(maps: DataFrame, span: int) -> DataFrame:
    return maps.groupBy("client_id", F.floor(F.col("block") / span).alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "f"))).alias("children"))


def _fold(items: str, each) -> Column:
    return F.aggregate(items, identity(), lambda f, x: composed(f, each(x)))


def range_states(events: DataFrame, span: int = SPAN) -> DataFrame:
    """Each client's state after its events (client_id, seq, kind, loc, len, text_len), whose seq are different.

    Blocks of events become maps, blocks of maps one map, until each client has one: no task holds more than a block.
    """
    base, levels = _levels(events, span)
    maps = _blocks(events, span, base).select("client_id", "block", _fold("e", map_of).alias("f"))
    for _ in range(levels):
        maps = _parents(maps, span).select("client_id", "block", _fold("children", lambda x: x["f"]).alias("f"))
    return maps.select("client_id", mapped(F.col("f"), state("none").cast(STATE)).alias("s")).select("client_id", "s.mode", "s.loc", "s.len")


def range_states_at(events: DataFrame, span: int = SPAN) -> DataFrame:
    """(client_id, seq, mode, loc, len): the state after each event. Maps go up the tree, states before each block down."""
    base, n = _levels(events, span)
    blocks = _blocks(events, span, base)
    levels = [blocks.select("client_id", "block", _fold("e", map_of).alias("f"))]
    families = []
    for _ in range(n):
        families.append(_parents(levels[-1], span))
        levels.append(families[-1].select("client_id", "block", _fold("children", lambda x: x["f"]).alias("f")))
    before = levels[-1].select("client_id", "block", state("none").cast(STATE).alias("s"))

    def scanned(items: str, step) -> Column:
        """[(item, state before it)] from state `s` on; items are a block's, so the list is bounded."""
        start = F.struct(F.col("s").alias("s"), F.array().cast(f"array<struct<key:bigint,before:{STATE},after:{STATE}>>").alias("out"))
        return F.aggregate(items, start, lambda acc, x: F.struct(step(acc["s"], x)[1].alias("s"), F.array_append(acc["out"], F.struct(step(acc["s"], x)[0].alias("key"), acc["s"].alias("before"), step(acc["s"], x)[1].alias("after"))).alias("out")), lambda acc: acc["out"])

    for family in reversed(families):
        met = family.join(before, ["client_id", "block"]).select("client_id", F.explode(scanned("children", lambda s, x: (x["block"], mapped(x["f"], s)))).alias("p"))
        before = met.select("client_id", F.col("p.key").alias("block"), F.col("p.before").alias("s"))
    done = blocks.join(before, ["client_id", "block"]).select("client_id", F.explode(scanned("e", lambda s, e: (e["seq"], after(s, e).cast(STATE)))).alias("p"))
    return done.select("client_id", F.col("p.key").alias("seq"), "p.after.mode", "p.after.loc", "p.after.len")


def host_moved(realtime: Column, clause: Column, session_loc: Column, session_len: Column, host_loc: Column, host_len: Column) -> Column:
    """The host moved the marked text of a running clause away: it must be committed."""
    differs = (session_loc != host_loc) | (session_len != host_len)
    return realtime & (clause != "") & session_loc.isNotNull() & host_loc.isNotNull() & F.coalesce(differs, F.lit(False))


def anchor_ranges(anchor: Column, marked: Column, replacement: Column, selected: Column) -> Column:
    """Ranges to try as a panel's anchor, in order and each once; empty marked text and ranges not found are left out."""
    shown = F.when(marked["len"] > 0, marked)
    return F.array_distinct(F.filter(F.array(anchor, shown, replacement, selected), lambda r: r["loc"].isNotNull()))
