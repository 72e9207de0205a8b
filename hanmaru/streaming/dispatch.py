"""What a key means: ordered rules as data, of which the first that fits decides, unless it lets the key go on.

RULES serve a session, which asks for one key at a time (`actions`), and tables of keys with the state they met
(`actions_of`). A rule that goes on changes what later rules see: a panel that was closed is gone, and so is a composition
that was committed. Rows are `key` events or `command` events, the names that hosts send in place of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import policy as P

# fixed values: key codes of the platform
BACKSPACE, ESCAPE, SPACE, TAB, UP, DOWN = 51, 53, 49, 48, 126, 125
RETURNS, SIDES, LISTS = (P.RETURN, P.ENTER), (P.LEFT, P.RIGHT), ("manual", "realtime")


@dataclass(frozen=True)
class Rule:
    """Conditions (None: any) and the action. `held` are modifiers of which one is down, `only` exactly those down, `free` those
    of which none is. `value` is the action's argument."""

    action: str
    value: str = ""
    source: str = "key"
    keys: tuple[int, ...] | None = None
    only: int | None = None
    held: int | None = None
    free: int | None = None
    char: str | None = None
    command: str | None = None  # 'newline' or 'navigation'
    panel: tuple[str, ...] | None = None
    clause: bool | None = None
    pending: bool | None = None
    suppressed: bool | None = None
    armed: bool | None = None
    moved: bool | None = None
    goes_on: bool = False


def _keys(panel: str | tuple[str, ...], *rules: Rule) -> list[Rule]:
    return [Rule(**{**r.__dict__, "panel": (panel,) if isinstance(panel, str) else panel}) for r in rules]


RULES: list[Rule] = [
    Rule("swallow", keys=RETURNS, suppressed=True),
    *_keys(("manual", "notice"), Rule("dismiss", keys=(ESCAPE,))),
    *_keys("notice", Rule("dismiss", goes_on=True)),
    *_keys("realtime", Rule("dismiss", keys=(ESCAPE,))),
    *_keys(LISTS, Rule("return", keys=RETURNS), Rule("backtab", keys=(TAB,), held=P.SHIFT), Rule("tab", keys=(TAB,)), Rule("up", keys=(UP,)), Rule("down", keys=(DOWN,))),
    *_keys("manual", *[Rule("number", str(i), keys=(k,), free=P.SHIFT) for k, i in P.CANDIDATE_KEYS.items()]),
    *_keys("manual", Rule("backtab", keys=(P.LEFT,)), Rule("tab", keys=(P.RIGHT,)), Rule("dismiss", keys=(SPACE,)), Rule("dismiss", goes_on=True)),
    *_keys("realtime", Rule("boundary", "-1", keys=(P.LEFT,), only=P.SHIFT), Rule("boundary", "1", keys=(P.RIGHT,), only=P.SHIFT), Rule("left", keys=(P.LEFT,)), Rule("right", keys=(P.RIGHT,)), Rule("dismiss", goes_on=True)),
    Rule("commit", clause=True, moved=True, goes_on=True),
    Rule("toggle", only=P.CONTROL, char=P.TOGGLE),
    Rule("swallow", keys=RETURNS, only=P.OPTION, clause=True),
    Rule("trigger", keys=RETURNS, only=P.OPTION),
    Rule("disarm", goes_on=True),
    Rule("leave", held=P.COMMAND | P.CONTROL),
    Rule("backspace", keys=(BACKSPACE,)),
    Rule("return", keys=RETURNS),
    Rule("escape", keys=(ESCAPE,)),
    Rule("space", keys=(SPACE,)),
    Rule("swallow", keys=(TAB, UP), clause=True),
    Rule("panel", keys=(DOWN,), clause=True),
    Rule("boundary", "-1", keys=(P.LEFT,), only=P.SHIFT, clause=True),
    Rule("boundary", "1", keys=(P.RIGHT,), only=P.SHIFT, clause=True),
    Rule("left", keys=(P.LEFT,), clause=True),
    Rule("right", keys=(P.RIGHT,), clause=True),
    Rule("leave", keys=(TAB, UP, DOWN, *SIDES)),
    Rule("text"),
    Rule("swallow", source="command", command="newline", suppressed=True),
    Rule("trigger", source="command", command="newline", armed=True),
    Rule("trigger", source="command", command="newline", only=P.OPTION),
    Rule("commit", source="command", command="newline", clause=True),
    Rule("dismiss", source="command", command="navigation", panel=("manual",)),
    Rule("disarm", source="command", goes_on=True),
    Rule("swallow", source="command", command="navigation", clause=True),
    Rule("leave", source="command", command="navigation", pending=True),
    Rule("pass", source="command"),
]


@dataclass
class Met:
    """A key or command, and the state it meets."""

    source: str = "key"
    key: int = -1
    modifiers: int = 0
    char: str = ""
    command: str = ""
    panel: str = "none"
    clause: bool = False
    pending: bool = False
    suppressed: bool = False
    armed: bool = False
    moved: bool = False


def fits(r: Rule, m: Met) -> bool:
    mods = m.modifiers & P.DEVICE_INDEPENDENT
    flags = all(want is None or want == has for want, has in ((r.clause, m.clause), (r.pending, m.pending), (r.suppressed, m.suppressed), (r.armed, m.armed), (r.moved, m.moved)))
    return (
        flags and r.source == m.source and (r.keys is None or m.key in r.keys) and (r.only is None or mods == r.only) and (r.held is None or mods & r.held != 0)
        and (r.free is None or mods & r.free == 0) and (r.char is None or m.char.lower() == r.char) and (r.command is None or m.command == r.command) and (r.panel is None or m.panel in r.panel)
    )


def actions(state: Callable[[], Met]) -> Iterator[Rule]:
    """The rules that apply to a key, each after the former's action was taken: `state` tells what the key meets by then."""
    met = state()
    for r in RULES:
        if r.source == met.source and fits(r, met):
            yield r
            if not r.goes_on:
                return
            met = state()  # only an action changes it


FLAGS = ("clause", "pending", "suppressed", "armed", "moved")
_TEXTS, _NUMBERS = ("action", "value", "source", "char", "command"), ("only", "held", "free")


def _as_struct(r: Rule) -> Column:
    cells = [F.lit(getattr(r, f)).cast("string").alias(f) for f in _TEXTS] + [F.lit(getattr(r, f)).cast("long").alias(f) for f in _NUMBERS]
    cells += [F.lit(getattr(r, f)).cast("boolean").alias(f) for f in (*FLAGS, "goes_on")]
    cells += [(F.lit(None) if getattr(r, f) is None else F.array(*map(F.lit, getattr(r, f)))).cast(f"array<{t}>").alias(f) for f, t in (("keys", "int"), ("panel", "string"))]
    return F.struct(*cells)


def actions_of(**met: Column) -> Column:
    """array<struct<action, value>> of the rules that apply to a row; columns are named as the fields of `Met`.

    The rules are an array that each row folds over, so that the expression stays small however many there are.
    """
    mods = P.modifiers(met["modifiers"])
    start = F.struct(met["panel"].alias("panel"), met["clause"].alias("clause"), met["pending"].alias("pending"), F.lit(False).alias("done"), F.array().cast("array<struct<action:string,value:string>>").alias("out"))

    def fits_row(r: Column, state: Column) -> Column:
        anything = lambda want, test: want.isNull() | F.coalesce(test, F.lit(False))
        now = {**met, "panel": state["panel"], "clause": state["clause"], "pending": state["pending"]}
        out = (r["source"] == met["source"]) & anything(r["keys"], F.array_contains(r["keys"], met["key"]))
        out = out & anything(r["only"], mods == r["only"]) & anything(r["held"], mods.bitwiseAND(r["held"]) != 0) & anything(r["free"], mods.bitwiseAND(r["free"]) == 0)
        out = out & anything(r["char"], F.lower(met["char"]) == r["char"]) & anything(r["command"], met["command"] == r["command"]) & anything(r["panel"], F.array_contains(r["panel"], now["panel"]))
        for f in FLAGS:
            out = out & anything(r[f], now[f] == r[f])
        return ~state["done"] & out

    def step(state: Column, r: Column) -> Column:
        committed = r["action"] == "commit"
        after = F.struct(
            F.when(r["action"] == "dismiss", F.lit("none")).otherwise(state["panel"]).alias("panel"), (state["clause"] & ~committed).alias("clause"), (state["pending"] & ~committed).alias("pending"),
            (~r["goes_on"]).alias("done"), F.array_append(state["out"], F.struct(r["action"].alias("action"), r["value"].alias("value"))).alias("out"),
        )
        return F.when(fits_row(r, state), after).otherwise(state)

    return F.aggregate(F.array(*map(_as_struct, RULES)), start, step, lambda state: state["out"])
