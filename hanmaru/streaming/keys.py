"""Sessions over raw keys: dispatch by rules, the session's actions, and where its text goes, in one pass over a client's rows.

A row is a key or a command with what the host shows at that moment (KEYS). `dispatch` picks the actions, `Session` takes
them, and a range state (as in `ranges`) says what each inserted or marked text replaces. `turn` numbers what the host sees as
one gesture, which may arrive as several rows; a suppression of duplicate newlines ends with its turn, unless renewed.

`replay` serves bounded tables: rows are sorted by client and order within a partition and pass by one at a time, so a client
of any size needs the memory of its state alone. `run_stream` keeps the same state field by field in the state store:
values, the locks as a map and the pending choices as a list, written only where they changed; a timer of event time drops
clients that were silent for long, and with them choices that no commit wrote out. Both give the same rows.

A tokenizer may read the clauses: `tokens.answered` joins its answers to the keys, in batches and streams alike, and rows that
bring one (clause, tokens) cut the clause by it. `run_read_stream` holds a client's rows back until the watermark has passed
them, as rows without an answer leave the join later than others, and takes them in order of seq.

Fixed cases: a null source is a key, null modifiers are none, a key code or text that means nothing passes on, rows without
a turn each are a turn of their own for commands and keys alike, and ranges without a place are null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import policy as P
from . import dispatch, tokens
from .hangul import Composer
from .panel import Panel
from .session import SUPPRESS_TTL, TRIGGER_TTL, Host, Session, units

KEYS = "client_id string, seq long, ts double, turn long, source string, key_code int, modifiers long, chars string, command string, sel_loc long, sel_len long, marked_loc long, marked_len long, left_text string, selected_text string, status string"
ROWS = "client_id string, seq long, nth int, kind string, text string, value string, loc long, len long"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
FIELDS = [c.split()[0] for c in KEYS.split(", ")]
Range = tuple[int, int] | None
CORE = (
    "mode string, lead string, vowel string, tail string, clause string, selected int, armed_at double, suppressed_at double, turn long, boundaries array<int>, "
    "clause_read string, words array<struct<at:int,surface:string,tag:string>>, "
    "range_mode string, range_loc long, range_len long, "
    "panel struct<kind:string,values:array<string>,key:string,at:int,on_key:boolean,page:int,loc:bigint,size:bigint,segment:int,message:string,detail:string>"
)
SPOT = "at int, surface string"


@dataclass
class Ranges:
    """Where text goes in the host: 'none', 'initial-selection', 'client-marked' or 'implicit', where the host decides."""

    mode: str = "none"
    loc: int | None = None
    len: int | None = None

    def place(self) -> Range:
        return None if self.loc is None else (self.loc, self.len)

    def begin(self, selected: Range) -> None:
        if self.mode == "none":
            self.mode, (self.loc, self.len) = "initial-selection", selected or (None, None)

    def sync(self, marked: Range) -> None:
        self.mode, (self.loc, self.len) = ("client-marked", marked) if marked else ("implicit", (None, None))

    def inserted(self, replaced: Range, size: int) -> None:
        self.mode, (self.loc, self.len) = ("initial-selection", (replaced[0] + size, 0)) if replaced else ("implicit", (None, None))

    def finish(self) -> None:
        self.mode, self.loc, self.len = "none", None, None


def known(x: Any) -> Any:
    """A value of a pandas row, with None for every kind of nothing."""
    return None if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x else x


def pair(loc: Any, size: Any) -> Range:
    loc, size = known(loc), known(size)
    return None if loc is None else (int(loc), int(size or 0))


def command_kind(name: str | None) -> str:
    if name in P.NEWLINE_COMMANDS:
        return "newline"
    return "navigation" if name and (name in P.NAVIGATION_EXACT or name.startswith(P.NAVIGATION_PREFIXES)) else "other"


@dataclass
class KeySession:
    """A session, its ranges, and the turn its suppression belongs to."""

    session: Session = field(default_factory=Session)
    ranges: Ranges = field(default_factory=Ranges)
    turn: int | None = None

    def step(self, e: Any, lookup: dict[str, list[str]]) -> list[tuple]:
        """Rows (kind, text, value, loc, len) that a row of KEYS gives."""
        s, ts, turn = self.session, float(e.ts), known(e.turn)
        if s.suppressed_at is not None and (turn is not None and turn != self.turn or ts - s.suppressed_at > SUPPRESS_TTL):
            s.suppressed_at = None
        source, mods, code = known(e.source) or "key", int(known(e.modifiers) or 0), known(e.key_code)
        code, chars, command = -1 if code is None else int(code), known(e.chars), known(e.command)
        host = Host(pair(e.sel_loc, e.sel_len), pair(e.marked_loc, e.marked_len), known(e.left_text), known(e.selected_text), known(e.status) or "ready")

        def met() -> dispatch.Met:
            clause = s.mode == "realtime" and bool(s.source())
            return dispatch.Met(
                source, code, mods, chars or "", command_kind(command) if source == "command" else "", s.panel.kind if s.panel else "none", clause, bool(s.composer.shown()),
                s.suppressed_at is not None, s.armed_at is not None and ts - s.armed_at <= TRIGGER_TTL,
                self.ranges.mode == "client-marked" and host.marked is not None and host.marked != self.ranges.place(),
            )

        if (clause := known(getattr(e, "clause", None))) is not None and (answer := known(getattr(e, "tokens", None))) is not None:
            s.read(clause, json.loads(answer), lookup)
        out: list[tuple] = []
        for rule in dispatch.actions(met):
            composing = bool(s.source())
            rows = list(self.act(rule, ts, code, mods, chars, command, host, lookup))
            if s.suppressed_at == ts:
                self.turn = turn
            out += self.placed(rows, composing, host)
        s.forget()
        return out

    def act(self, rule: dispatch.Rule, ts: float, code: int, mods: int, chars: str | None, command: str | None, host: Host, lookup: dict[str, list[str]]) -> Iterator[tuple]:
        s, what = self.session, rule.action
        do = lambda action, text=None: s.handle(action, text, ts, lookup, host, self.marked(host))
        if what == "swallow":
            if s.suppressed_at is not None:
                yield "suppressed", "", None
        elif what in ("leave", "pass"):
            if what == "leave":
                yield from do("commit")
            yield "pass", command or str(code), None
        elif what == "text":
            char = P.typed(chars, code, mods)
            if char is None or char == "`":
                yield from do("commit")
                yield ("pass", str(code), None) if char is None else ("insert", P.WON, None)
            else:
                yield from do("key", char)
                yield from self.refreshed(do)
        elif what == "backspace":
            if not s.source():
                yield "pass", str(code), None
            else:
                yield from do("backspace")
                yield from self.refreshed(do)
        else:
            yield from do(what, rule.value)

    def refreshed(self, do: Any) -> Iterator[tuple]:
        """In real-time mode the panel follows the clause unasked."""
        if self.session.mode == "realtime" and self.session.source():
            yield from do("refresh")

    def marked(self, host: Host) -> Range:
        """Where the composed text stands: where the host marks it, else where it did, else where it would go."""
        place = self.ranges.place()
        if host.marked is not None or place is None or self.ranges.mode == "client-marked":
            return host.marked or place
        return place[0], units(self.session.source())

    def placed(self, rows: list[tuple], composing: bool, host: Host) -> list[tuple]:
        """Rows with the ranges that they replace, which move on as they do. Text after a commit goes where the host wants."""
        out, first, goes_on = [], True, bool(self.session.source())
        for kind, text, value, *own in rows:
            loc, size = None, None
            if own:
                loc, size = own
            elif kind == "insert":
                at = (self.ranges.place() if self.ranges.mode == "client-marked" else host.marked or self.ranges.place()) if composing and first else None if composing else host.selected
                loc, size = at or (None, None)
                if goes_on:
                    self.ranges.inserted(at, units(text))
                first = False
            elif kind == "mark" and text:
                self.ranges.begin(host.selected)
                loc, size = self.ranges.place() or (None, None)
                self.ranges.sync(host.marked)
            out.append((kind, text, value, loc, size))
        if not goes_on:
            self.ranges.finish()
        return out


def stepped(state: KeySession, rows: pd.DataFrame, lookup: dict[str, list[str]]) -> pd.DataFrame:
    """Output of a client's rows in order of seq."""
    return output([(e.client_id, e.seq, i, *r) for e in rows.sort_values("seq", kind="stable").itertuples(index=False) for i, r in enumerate(state.step(e, lookup))])


def output(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype({"loc": "Int64", "len": "Int64"})


def replay(keys: DataFrame, lookup: dict[str, list[str]]) -> DataFrame:
    """All rows of a bounded table of KEYS, with or without a tokenizer's answers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, state = None, KeySession()
        for frame in frames:
            out = []
            for e in frame.itertuples(index=False):
                if e.client_id != client:  # clients come one after the other
                    client, state = e.client_id, KeySession()
                out += [(client, e.seq, i, *r) for i, r in enumerate(state.step(e, lookup))]
            yield output(out)

    fields = [*FIELDS, *(c for c in ("clause", "tokens") if c in keys.columns)]
    # a stated number of tasks over a hash of its own, as few bytes are much work for Python: a partitioning by client that is there
    # already would be taken as it is, and joined into one task
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.select(*fields).where("client_id is not null").repartition(tasks, F.xxhash64("client_id")).sortWithinPartitions("client_id", "seq").mapInPandas(run, ROWS)


class Sessions(StatefulProcessor):
    """The state of one client, field by field."""

    def __init__(self, lookup: dict[str, list[str]], idle_ms: int) -> None:
        self.lookup, self.idle_ms = lookup, idle_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.core = handle.getValueState("core", CORE)
        self.locks = handle.getMapState("locks", SPOT, "value string")
        self.pending = handle.getListState("pending", f"{SPOT}, value string")

    def load(self) -> KeySession:
        if not self.core.exists():
            return KeySession()
        mode, lead, vowel, tail, clause, selected, armed, suppressed, turn, boundaries, clause_read, words, range_mode, loc, size, panel = self.core.get()
        locks = {(k[0], k[1]): v[0] for k, v in self.locks.iterator()} if self.locks.exists() else {}
        pending = {(at, surface): value for at, surface, value in self.pending.get()} if self.pending.exists() else {}
        session = Session(mode, Composer(lead, vowel, tail), clause, locks, pending, selected, armed, suppressed, None if boundaries is None else list(boundaries), None if panel is None else Panel(*[list(x) if isinstance(x, (list, tuple)) else x for x in panel]))
        session.words = None if clause_read is None else (clause_read, [tuple(w) for w in words])
        return KeySession(session, Ranges(range_mode, loc, size), turn)

    def save(self, state: KeySession, before: tuple[dict, dict]) -> None:
        s, r = state.session, state.ranges
        c, p = s.composer, s.panel
        self.core.update((s.mode, c.lead, c.vowel, c.tail, s.clause, s.selected, s.armed_at, s.suppressed_at, state.turn, s.boundaries, *(s.words or (None, None)), r.mode, r.loc, r.len, None if p is None else tuple(p.dump())))
        locks, pending = before
        for key in locks.keys() - s.locks.keys():
            self.locks.removeKey(key)
        for key, value in s.locks.items():
            if key not in locks or locks[key] != value:
                self.locks.updateValue(key, (value,))
        if list(pending.items()) != list(s.pending.items()):
            if s.pending:
                self.pending.put([(*key, value) for key, value in s.pending.items()])
            else:
                self.pending.clear()

    def take(self, events: pd.DataFrame) -> pd.DataFrame:
        """Output of rows, by which the stored state moves on."""
        state = self.load()
        before = dict(state.session.locks), dict(state.session.pending)
        out = stepped(state, events, self.lookup)
        self.save(state, before)
        return out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        out = self.take(events)
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(int(events["at"].max().timestamp() * 1000) + self.idle_ms)
        yield out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self.expired(key)

    def expired(self, key: Any) -> pd.DataFrame:
        for field_ in (self.core, self.locks, self.pending):
            field_.clear()
        return pd.DataFrame([(key[0], None, 0, "expired", "", None, None, None)], columns=COLUMNS).astype({"seq": "Int64", "loc": "Int64", "len": "Int64"})

    def close(self) -> None:
        pass


def plain(x: Any) -> Any:
    """A value of a pandas row as the state store takes it."""
    x = known(x)
    return x.item() if isinstance(x, np.generic) else x


class OrderedSessions(Sessions):
    """Sessions whose rows wait until the watermark has passed them, so that none of their client can still come before them."""

    WAITING = f"{KEYS}, clause string, tokens string, due long"
    NAMES = [c.split()[0] for c in WAITING.split(", ")]
    WHOLE = [c.split()[0] for c in WAITING.split(", ") if c.endswith((" long", " int"))]

    def init(self, handle: Any) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.idle = handle.getValueState("idle", "due long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        events["due"] = [int(t.timestamp() * 1000) for t in events["at"]]
        held = [tuple(v if v is None or n not in self.WHOLE else int(v) for n, v in zip(self.NAMES, map(plain, r), strict=True)) for r in events[self.NAMES].itertuples(index=False)]
        self.waiting.appendList(held)
        self.handle.registerTimer(int(events["due"].max()))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = [r for r in held if r[-1] <= now]
        if due:
            later = [r for r in held if r[-1] > now]
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            silent = max(r[-1] for r in due) + self.idle_ms
            self.idle.update((silent,))
            self.handle.registerTimer(silent)
            yield self.take(pd.DataFrame(due, columns=self.NAMES))
        elif not held and self.idle.exists() and self.idle.get()[0] <= now:
            self.idle.clear()
            yield self.expired(key)


def run_read_stream(keys: DataFrame, answers: DataFrame, lookup: dict[str, list[str]], late: str = "10 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """Rows of a stream of KEYS joined with a stream of a tokenizer's answers, those of `replay(tokens.answered(keys, answers))`.
    An answer counts if it comes within `late` after its key. A client's ts must not fall as its seq grows."""
    read = tokens.answered(keys, answers, late).where("client_id is not null")
    return read.groupBy("client_id").transformWithStateInPandas(OrderedSessions(lookup, idle_ms), ROWS, "Append", "EventTime")


def run_stream(keys: DataFrame, lookup: dict[str, list[str]], late: str = "10 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """Rows of a stream of KEYS. A client is dropped, with a row that says so, once the watermark, `late` behind the latest
    event, has passed its own last event by idle_ms. The state store must be RocksDB's."""
    timed = keys.select(*FIELDS, tokens.moment("ts").alias("at")).withWatermark("at", late)
    return timed.groupBy("client_id").transformWithStateInPandas(Sessions(lookup, idle_ms), ROWS, "Append", "EventTime")
