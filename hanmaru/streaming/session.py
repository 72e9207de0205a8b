"""Per-client sessions over a stream of key events: composition, clauses with locks and pending choices, commit and cancel.

`Session` is the state of one client. `run_batch` replays a bounded table of events, `run_stream` keeps sessions in the
state store of a streaming query; both feed events in order of seq through the same handler, so they give the same rows.
Commit flushes pending choices, cancel drops them. Events of a client are in one group; clients are many and small.

A clause is cut by the tokenizer's answer for it where there is one (see `tokens`), else into the longest known readings and
numbers, or, once a boundary was moved by hand, at boundaries that stay until the source changes. A panel (see `panel`) shows the selected segment's candidates and, behind them, the segment itself, or
those of a manual conversion, or a notice. Readings are looked up in NFC, whole graphemes at a time, and numbers by their
digits; numbers always convert when asked, and never unasked, and so do readings whose Hangul is chosen at least as often.

An action's text that it can't use (a step that is no number, a number key beyond the page) changes nothing.

Candidates and usage come as a lookup, a plain dict that travels to the tasks; `lookup_table` builds it from ranked
candidates and refuses tables beyond its bound, for which the joins of the batch operators are the way.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HANGUL, nfc_key
from ..operators.segments import ELIGIBLE, NOT_UNASKED, NUMERIC, TOP_TOKENIZATIONS
from ..operators.targets import BLANK
from .hangul import Composer
from .numbers import readings
from .panel import OWN, PAGE_SIZE, Panel

EVENTS = "client_id string, seq long, ts double, action string, text string"
OUTPUT = "client_id string, seq long, kind string, text string, value string"
#: Times to live, in seconds, inclusive.
TRIGGER_TTL, SUPPRESS_TTL = 1.0, 0.5
MAX_LOOKUP_ROWS = 300_000
ENDS_CLAUSE = re.compile(r"[.?!;\n\rA-Za-z]")
NUMBER = re.compile(NUMERIC)
TAIL, EMPTY, GRAPHEME = re.compile(f"[{HANGUL}]*\\Z"), regex.compile(BLANK), regex.compile(r"\X")
# fixed values: what notices say
NO_CANDIDATES, NO_TARGET, LOADING, UNAVAILABLE = "후보 없음", "변환할 텍스트가 없습니다.", "한자 사전을 불러오는 중입니다.", "한자 사전을 사용할 수 없습니다."
REALTIME_IS_ON = "실시간 변환이 활성화되어 있습니다."


class Lookup(dict[str, list[str]]):
    """reading -> values in rank order; `hangul` holds the readings whose Hangul is chosen at least as often as the first value."""

    hangul: frozenset[str] = frozenset()


def prefers_hangul(lookup: dict[str, list[str]], key: str) -> bool:
    return key in getattr(lookup, "hangul", ())


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


@dataclass
class Host:
    """What the host shows at an event: selection and marked text (loc, len in UTF-16 units, or None), the text left of the
    caret, the selected text, and whether the dictionary is ready, loading or unavailable, and why."""

    selected: tuple[int, int] | None = None
    marked: tuple[int, int] | None = None
    left: str | None = None
    text: str | None = None
    status: str = "ready"
    reason: str | None = None


def lookup_table(candidates: DataFrame, limit: int = MAX_LOOKUP_ROWS, usage: DataFrame | None = None) -> Lookup:
    """reading -> values in rank order, of at most `limit` candidates; with usage(lookup_key, value, count), also the readings
    whose Hangul is preferred."""
    rows = candidates.select("reading_k", "rn", "value").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} candidates: join them instead of sending them out")
    out = Lookup()
    for r in sorted(rows, key=lambda r: (r.reading_k, r.rn)):
        out.setdefault(r.reading_k, []).append(r.value)
    if usage is not None:
        own = usage.where("lookup_key = value and count > 0").groupBy(nfc_key(F.col("lookup_key")).alias("reading_k")).agg(F.sum("count").alias("own"))
        top = candidates.where("rn = 1").select("reading_k", "usage_count")
        out.hangul = frozenset(r.reading_k for r in own.join(top, "reading_k").where("own >= usage_count").select("reading_k").collect())
    return out


def key_of(surface: str) -> str:
    """What a surface is looked up by: its digits if it is a number, else its NFC form."""
    return surface.replace(",", "") if NUMBER.fullmatch(surface) else unicodedata.normalize("NFC", surface)


_LAST: list[tuple[dict[str, list[str]], int, int]] = []


def longest(lookup: dict[str, list[str]]) -> int:
    """Length of the longest reading; kept for the lookup that was asked last."""
    if not _LAST or _LAST[0][0] is not lookup or _LAST[0][1] != len(lookup):
        _LAST[:] = [(lookup, len(lookup), max(map(len, lookup), default=0))]
    return _LAST[0][2]


def values_of(surface: str, lookup: dict[str, list[str]]) -> list[str]:
    """Candidates of a surface: a number's readings where the lookup has none."""
    key = key_of(surface)
    return lookup.get(key) or (readings(key) if NUMBER.fullmatch(surface) else [])


def words_of(clause: str, tokens: list[dict]) -> list[tuple[int, str, str]]:
    """(start, surface, tag) of a tokenization's words that are looked up, and of the clause's numbers, to which tokens that
    touch them give way. Positions of tokens are UTF-16 units; those that cut a character in two count for nothing."""
    at, place = {0: 0}, 0
    for i, c in enumerate(clause, 1):
        place += units(c)
        at[place] = i
    spots = ((at.get(t["position"]), at.get(t["position"] + t["length"]), t["tag"]) for t in tokens if t["length"] > 0 and t["tag"] in ELIGIBLE)
    found = [(a, clause[a:z], tag) for a, z, tag in spots if a is not None and z is not None]
    numbers = [(m.start(), m[0], "sn") for m in NUMBER.finditer(clause)]
    if not numbers:
        return found
    free = [w for w in found if not any(w[0] < n[0] + len(n[1]) and n[0] < w[0] + len(w[1]) for n in numbers)]
    return sorted(free + numbers, key=lambda w: (w[0], -units(w[1])))


def best_words(clause: str, tokenizations: list[list[dict]], lookup: dict[str, list[str]]) -> list[tuple[int, str, str]]:
    """Words of the tokenization whose convertible ones are longest in sum; of equals, the earlier one."""
    every = [words_of(clause, tokens) for tokens in tokenizations[:TOP_TOKENIZATIONS]]
    return max(every, key=lambda words: sum(units(s) for _, s, _ in words if NUMBER.fullmatch(s) or key_of(s) in lookup), default=[])


def hangul_tail(text: str) -> str:
    return TAIL.search(text)[0]


def target(composed: str, marked: tuple[int, int] | None, host: Host) -> tuple[str, int, int] | None:
    """(text, loc, len) that a manual conversion is about: the Hangul that ends with the composition, else the selection, else
    the Hangul left of the caret. None where ranges and texts disagree."""
    if composed:
        left = host.left if marked and marked[0] else ""
        if marked is None or left is None or units(left) != marked[0] or units(composed) != marked[1]:
            return None
        end, tail = sum(marked), hangul_tail(left + composed)
    elif host.selected is None:
        return None
    elif host.selected[1] > 0:
        fine = host.text is not None and units(host.text) == host.selected[1] and not EMPTY.match(host.text)
        return (host.text, *host.selected) if fine else None
    else:
        end = host.selected[0]
        if not end or host.left is None or units(host.left) != end:
            return None
        tail = hangul_tail(host.left)
    return (tail, end - units(tail), units(tail)) if tail else None


def whole(text: str) -> int | None:
    """The whole number that a text is, if it is one."""
    return int(text) if re.fullmatch(r"-?[0-9]{1,9}", text) else None


@dataclass
class Session:
    """State of one client: mode, syllable, clause, segments, locks, pending choices, and time limits."""

    mode: str = "hangul"
    composer: Composer = field(default_factory=Composer)
    clause: str = ""
    locks: dict[tuple[int, str], str | None] = field(default_factory=dict)  # None locks the Hangul itself
    pending: dict[tuple[int, str], str] = field(default_factory=dict)
    selected: int = -1
    armed_at: float | None = None
    suppressed_at: float | None = None
    boundaries: list[int] | None = None
    panel: Panel | None = None
    words: tuple[str, list[tuple[int, str, str]]] | None = None  # a clause and how a tokenizer reads it

    def dump(self) -> str:
        """The state as JSON, which the state store keeps."""
        keyed = lambda d: [[*k, v] for k, v in d.items()]
        c = self.composer
        return json.dumps([self.mode, [c.lead, c.vowel, c.tail], self.clause, keyed(self.locks), keyed(self.pending), self.selected, self.armed_at, self.suppressed_at, self.boundaries, self.panel and self.panel.dump(), self.words])

    @classmethod
    def load(cls, text: str) -> "Session":
        mode, jamo, clause, locks, pending, selected, armed, suppressed, boundaries, panel, words = json.loads(text)
        keyed = lambda rows: {(at, surface): v for at, surface, v in rows}
        return cls(mode, Composer(*jamo), clause, keyed(locks), keyed(pending), selected, armed, suppressed, boundaries, panel and Panel(*panel), words and (words[0], [tuple(w) for w in words[1]]))

    def source(self) -> str:
        return self.clause + self.composer.shown()

    def read(self, clause: str, tokenizations: list[list[dict]], lookup: dict[str, list[str]]) -> None:
        """Takes a tokenizer's answer, tokens (tag, position, length) by rank. It serves while the source is that clause."""
        self.words = clause, best_words(clause, tokenizations, lookup)

    def forget(self) -> None:
        """Drops an answer about another clause."""
        if self.words is not None and self.words[0] != self.source():
            self.words = None

    def tagged(self) -> list[tuple[int, str, str]] | None:
        """The source's words with their tags, unless they were cut by hand or no tokenizer read them."""
        return self.words[1] if self.boundaries is None and self.words is not None and self.words[0] == self.source() else None

    def segments(self, lookup: dict[str, list[str]]) -> list[tuple[int, str]]:
        """(start, surface) of the tokenizer's words, or else of the longest known readings from the left, and of runs of
        digits; of all stretches between boundaries where those were drawn by hand."""
        if self.boundaries is not None:
            text = self.source()
            edges = [0, *(b for b in self.boundaries if 0 < b < len(text)), len(text)]
            return [(a, text[a:z]) for a, z in zip(edges, edges[1:], strict=False) if z > a]
        if (words := self.tagged()) is not None:
            return [w[:2] for w in words]
        text, at, out, most = self.source(), 0, [], longest(lookup)
        marks = [0]
        for g in GRAPHEME.findall(text):
            marks.append(marks[-1] + len(g))
        k = 0
        while k < len(marks) - 1:
            at = marks[k]
            digits = NUMBER.match(text, at)
            ends = [digits.end()] if digits else [z for z in reversed(marks[k + 1 : k + 1 + most]) if key_of(text[at:z]) in lookup]
            end = ends[0] if ends else marks[k + 1]
            if ends:
                out.append((at, text[at:end]))
            while k < len(marks) - 1 and marks[k] < end:
                k += 1
        return out

    def preview(self, lookup: dict[str, list[str]]) -> str:
        """The clause with each segment's locked or first candidate in its place; of segments that overlap, the first one's,
        of those that begin together the shortest one's."""
        text, out, at = self.source(), "", 0
        for start, surface in sorted(self.segments(lookup), key=lambda s: (s[0], len(s[1]))):
            if start < at:
                continue
            show = self.locks.get((start, surface), self.unasked((start, surface), lookup))
            out += text[at:start] + (show or surface)
            at = start + len(surface)
        return out + text[at:]

    def unasked(self, segment: tuple[int, str], lookup: dict[str, list[str]]) -> str | None:
        """What a segment converts to as long as nobody chose: numbers stay, and so do readings whose Hangul is preferred and
        words of kinds that never convert unasked. Cuts by hand ask for neither use nor kind."""
        key = key_of(segment[1])
        known = lookup.get(key)
        if not known or NUMBER.fullmatch(segment[1]):
            return None
        tag = next((w[2] for w in self.tagged() or () if w[:2] == segment), None)
        return None if self.boundaries is None and (prefers_hangul(lookup, key) or tag in NOT_UNASKED) else known[0]

    def analyse(self, lookup: dict[str, list[str]], kept: tuple[int, str] | None = None) -> None:
        """After a change: locks and choices whose segment is gone go too; the selection stays with its segment while that
        is still there and converts, else it goes to the first that does. `kept` is the segment selected before."""
        keys = set(self.segments(lookup))
        self.locks = {k: v for k, v in self.locks.items() if k in keys}
        self.pending = {k: v for k, v in self.pending.items() if k in keys}
        segs, convertible = self.segments(lookup), self.convertible(lookup)
        same = next((i for i in convertible if segs[i] == kept), None)
        if same is not None:
            self.selected = same
        elif self.selected not in convertible or kept is not None:
            self.selected = convertible[0] if convertible else -1

    def convertible(self, lookup: dict[str, list[str]]) -> list[int]:
        """Places of the segments that convert."""
        return [i for i, (_, s) in enumerate(self.segments(lookup)) if NUMBER.fullmatch(s) or key_of(s) in lookup]

    def current(self, lookup: dict[str, list[str]]) -> tuple[int, str] | None:
        """The selected segment."""
        segs = self.segments(lookup)
        return segs[self.selected] if 0 <= self.selected < len(segs) else None

    def candidates(self, lookup: dict[str, list[str]]) -> list[str]:
        own = self.current(lookup)
        return values_of(own[1], lookup) if own else []

    def open_panel(self, lookup: dict[str, list[str]], keep: bool = False) -> None:
        """Shows the selected segment's candidates, or nothing where there are none. Highlighted is what was before if that is
        to be kept, else the candidate that the clause shows, else the segment itself if it is a number, else the first."""
        own, values, before = self.current(lookup), self.candidates(lookup), self.panel
        if self.mode != "realtime" or own is None or not values:
            self.panel = None
        elif not (keep and before and before.kind == "realtime" and before.segment == self.selected):
            shown = self.locks.get(own, self.unasked(own, lookup))
            at = values.index(shown) if shown in values else 0
            self.panel = Panel("realtime", values, own[1], at, shown is None, at // PAGE_SIZE, segment=self.selected)
        elif before.values != values:
            self.panel = Panel("realtime", values, own[1], before.at, before.on_key, before.page, segment=self.selected)

    def trigger(self, ts: float, host: Host, lookup: dict[str, list[str]], marked: tuple[int, int] | None = None) -> Iterator[tuple]:
        """Opens the panel of a manual conversion, or a notice that says why there is none; either way newlines that follow
        at once are duplicates."""
        self.armed_at, self.suppressed_at = None, ts
        found = target("" if self.mode == "realtime" else self.source(), marked, host)
        if self.mode == "realtime":
            self.panel = Panel("notice", message=UNAVAILABLE, detail=REALTIME_IS_ON)
        elif found is None:
            self.panel = Panel("notice", message=NO_TARGET)
        elif host.status in ("uninitialized", "loading"):
            self.panel = Panel("notice", message=LOADING)
        elif host.status != "ready":
            self.panel = Panel("notice", message=UNAVAILABLE, detail=host.reason)
        else:
            text, loc, size = found
            key = unicodedata.normalize("NFC", text)
            self.panel = Panel("manual", lookup.get(key, []), text, on_key=prefers_hangul(lookup, key), loc=loc, size=size)
        yield self.panel_row(lookup)

    def apply(self, value: str | None, lookup: dict[str, list[str]]) -> Iterator[tuple]:
        """A manual choice: the candidate, or the text itself (None), takes the target's place, and counts as used."""
        panel, key = self.panel, unicodedata.normalize("NFC", self.panel.key)
        if self.source():  # composed text becomes the host's first, so that the range counts from its start
            yield from self.commit(lookup)
        yield "insert", panel.key if value is None else value, None, panel.loc, panel.size
        yield "usage", key, key if value is None else value
        self.reset()
        self.armed_at = self.suppressed_at = None

    def move_boundary(self, delta: int, lookup: dict[str, list[str]]) -> None:
        """Moves the right edge of the selected segment by one character; the first move fixes the boundaries as they are."""
        self.clause += self.composer.flush()
        own, text = self.current(lookup), self.clause
        if own is None:
            return
        if self.boundaries is None:
            self.boundaries = sorted({e for a, surface in self.segments(lookup) for e in (a, a + len(surface)) if 0 < e < len(text)})
        edges = [0, *self.boundaries, len(text)]
        marks = [0]
        for g in GRAPHEME.findall(text):
            marks.append(marks[-1] + len(g))
        right = own[0] + len(own[1])
        to = next((m for m in marks if m > right), None) if delta > 0 else next((m for m in reversed(marks) if own[0] < m < right), None)
        if to is not None and right in edges:
            beyond = next((e for e in edges if e > right), None)
            kept = {e for e in edges if e != right or right == len(text)}
            if not (delta > 0 and to == beyond):
                kept.add(to)
            self.boundaries = sorted(e for e in kept if 0 < e < len(text))
        segs = self.segments(lookup)
        self.analyse(lookup)
        self.selected = next((i for i, (a, _) in enumerate(segs) if a == own[0]), self.selected)

    def step(self, delta: int, lookup: dict[str, list[str]], wraps: bool = False) -> bool:
        """Selects the next or previous segment that converts; whether there was one."""
        ids = self.convertible(lookup)
        ahead = [i for i in ids if (i > self.selected if delta > 0 else i < self.selected)] or (ids if wraps else [])
        if ahead:
            self.selected = ahead[0] if delta > 0 else ahead[-1]
        return bool(ahead)

    def advance(self, lookup: dict[str, list[str]]) -> Iterator[tuple[str, str, str | None]]:
        """After a choice: on to the next segment with its panel, or commit after the last."""
        if self.step(1, lookup):
            self.open_panel(lookup)
            yield "mark", self.preview(lookup), None
        else:
            yield from self.commit(lookup)

    def panel_row(self, lookup: dict[str, list[str]]) -> tuple[str, str, str | None]:
        """What the panel highlights, and its page; empty and null without a panel."""
        p = self.panel
        if p is None:
            return "panel", "", None
        if p.kind == "notice":
            return "notice", p.message, p.detail
        return "panel", p.key if p.on_key else p.chosen() or "", str(p.page)

    def reset(self) -> None:
        self.clause, self.selected, self.boundaries, self.panel = "", -1, None, None
        self.composer = Composer()
        self.locks, self.pending = {}, {}

    def choose(self, value: str | None, lookup: dict[str, list[str]]) -> None:
        """Locks the selected segment to a value, or to the Hangul itself, and notes the choice in place of a former one."""
        segs = self.segments(lookup)
        if 0 <= self.selected < len(segs):
            key = segs[self.selected]
            self.locks[key] = value
            self.pending.pop(key, None)
            self.pending[key] = value if value is not None else key[1]

    def commit(self, lookup: dict[str, list[str]]) -> Iterator[tuple[str, str, str | None]]:
        text = self.preview(lookup) if self.mode == "realtime" else self.source()
        if text:
            yield "insert", text, None
        if self.mode == "realtime":
            for (_, surface), value in self.pending.items():
                yield "usage", key_of(surface), value
        self.reset()

    def handle(self, action: str, text: str | None, ts: float, lookup: dict[str, list[str]], host: Host | None = None, marked: tuple[int, int] | None = None) -> Iterator[tuple]:
        """Rows that an event gives: (kind, text, value), and the range it replaces where the action itself says so."""
        text = text or ""
        if action == "newline":
            if self.suppressed_at is not None and ts - self.suppressed_at <= SUPPRESS_TTL:
                yield "suppressed", "", None
                return
            armed, self.armed_at = self.armed_at, None  # one newline uses the arming up, in time or not
            if armed is not None and ts - armed <= TRIGGER_TTL:
                yield "trigger", self.source(), None
                return
            yield from self.commit(lookup)
            yield "insert", "\n", None
        elif action == "arm":
            self.armed_at = ts
        elif action == "suppress":
            self.suppressed_at = ts
        elif action == "toggle":
            if text == "not ready":
                return
            if text != "menu":  # the menu doesn't touch the composition
                yield from self.commit(lookup)
            self.panel = None
            self.mode = "hangul" if self.mode == "realtime" else "realtime"
            yield "mode", self.mode, None
        elif action in ("commit", "deactivate"):
            yield from self.commit(lookup)
        elif action in ("cancel", "activate"):
            self.reset()
            yield "mark", "", None
        elif action == "select":
            if text in self.candidates(lookup):
                self.choose(text, lookup)
            yield "mark", self.preview(lookup), None
        elif action == "hangul":
            self.choose(None, lookup)
            yield "mark", self.preview(lookup), None
        elif action == "move":
            if (step := whole(text or "1")) is not None:
                self.step(step, lookup)
            yield "selected", str(self.selected), None
        elif action == "backspace":
            kept, self.panel, self.boundaries = self.current(lookup), None, None
            if not self.composer.backspace():
                self.clause = regex.sub(r"\X\Z", "", self.clause)
            if self.source():
                self.analyse(lookup, kept)
            else:
                self.reset()  # nothing is left to compose
            yield "mark", self.shown(lookup), None
        elif action == "key":
            yield from self.typed(text, lookup)
        elif action == "manual":  # a value chosen for the whole source outside of real-time mode
            source = self.source()
            yield "insert", text, None
            if source:
                yield "usage", key_of(source), text
            self.reset()
        elif action in ("space", "return", "escape"):
            yield from self.plain_key(action, lookup)
        elif action in ("panel", "refresh"):  # asked for, a segment without candidates is told so
            own = self.current(lookup)
            self.open_panel(lookup, keep=action == "refresh")
            yield self.panel_row(lookup) if self.panel or action == "refresh" or own is None else ("notice", NO_CANDIDATES, own[1])
        elif action == "trigger":
            yield from self.trigger(ts, host or Host(), lookup, marked)
        elif action == "dismiss":
            if self.panel is not None:
                if self.panel.kind != "realtime":
                    self.armed_at = None
                self.panel = None
                yield self.panel_row(lookup)
        elif action == "disarm":
            self.armed_at = None
        elif action in ("left", "right") and self.panel is None and self.mode == "realtime" and self.source():
            self.step(1 if action == "right" else -1, lookup, wraps=True)
            yield "mark", self.preview(lookup), None
            yield from self.handle("panel", None, ts, lookup)
        elif action == "boundary" and self.mode == "realtime" and self.source():
            if step := whole(text):
                self.move_boundary(step, lookup)
            self.open_panel(lookup)
            yield "mark", self.preview(lookup), None
            yield self.panel_row(lookup)
        elif self.panel and action in ("up", "down", "tab", "backtab", "left", "right", "number"):
            yield from self.panel_key(action, text, lookup)

    def plain_key(self, action: str, lookup: dict[str, list[str]]) -> Iterator[tuple[str, str, str | None]]:
        """Space, return and escape: to the panel if there is one, else to the clause, else on to the host."""
        if action != "space" and self.panel:
            p = self.panel
            _, choice = p.take(action)
            value = None if choice in (None, OWN) else p.values[choice]
            if choice is not None and p.kind == "manual":
                yield from self.apply(value, lookup)
                return
            if choice is not None:
                self.choose(value, lookup)
                if choice == OWN:
                    yield from self.advance(lookup)
                    return
                yield "mark", self.preview(lookup), None
            self.panel = None
            yield self.panel_row(lookup)
        elif not self.source():
            yield "pass", action, None
        elif action == "space" and self.mode == "realtime":
            kept, self.panel, self.boundaries = self.current(lookup), None, None
            self.clause += self.composer.flush() + " "
            self.analyse(lookup, kept)
            self.open_panel(lookup)
            yield "mark", self.preview(lookup), None
        elif action == "escape" and self.mode == "realtime":
            self.reset()
            yield "mark", "", None
        else:
            yield from self.commit(lookup)
            if action == "space":
                yield "insert", " ", None

    def panel_key(self, action: str, text: str, lookup: dict[str, list[str]]) -> Iterator[tuple[str, str, str | None]]:
        p = self.panel
        if action in ("left", "right"):
            if p.kind == "realtime":
                self.step(1 if action == "right" else -1, lookup, wraps=True)
                self.open_panel(lookup)
        else:  # number keys from 0; the tenth stands for the text itself
            _, choice = p.take(action, whole(text))
            if choice is not None:
                value = None if choice == OWN else p.values[choice]
                if p.kind == "manual":
                    yield from self.apply(value, lookup)
                else:
                    self.choose(value, lookup)
                    yield from self.advance(lookup)
                return
        yield self.panel_row(lookup)

    def shown(self, lookup: dict[str, list[str]]) -> str:
        return self.preview(lookup) if self.mode == "realtime" else self.source()

    def typed(self, char: str, lookup: dict[str, list[str]]) -> Iterator[tuple[str, str, str | None]]:
        kept, self.panel, self.boundaries = self.current(lookup), None, None  # boundaries last until the source changes
        done = self.composer.type(char)
        if done is None:  # no jamo: it ends the syllable, and a clause where marks or letters do
            ended = self.composer.flush()
            if self.mode == "realtime" and not ENDS_CLAUSE.match(char) and (self.clause or ended or char.isdigit()):  # of other keys, only digits begin a clause
                self.clause += ended + char
            else:
                self.clause += ended
                yield from self.commit(lookup)
                yield "insert", char, None
                return
        elif self.mode == "realtime":
            self.clause += done
        elif done:
            yield "insert", done, None
        self.analyse(lookup, kept)
        yield "mark", self.shown(lookup), None


def replay(session: Session, events: pd.DataFrame, lookup: dict[str, list[str]]) -> pd.DataFrame:
    """Rows of a client's events in order of seq."""
    rows: list[tuple[Any, ...]] = []
    for e in events.sort_values("seq").itertuples(index=False):
        rows += [(e.client_id, e.seq, *r[:3]) for r in session.handle(e.action, None if pd.isna(e.text) else e.text, float(e.ts), lookup)]
    return pd.DataFrame(rows, columns=["client_id", "seq", "kind", "text", "value"])


def run_batch(events: DataFrame, lookup: dict[str, list[str]]) -> DataFrame:
    """All rows of a bounded table of events."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return replay(Session(), pdf, lookup)

    return events.groupBy("client_id").applyInPandas(one, OUTPUT)


def run_stream(events: DataFrame, lookup: dict[str, list[str]], forget_after: int | None = None) -> DataFrame:
    """Rows of a stream of events, sessions kept between micro-batches. Arrival order is the only order.

    Sessions of clients that sent nothing for forget_after milliseconds are dropped, if that is given.
    """

    def one(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        session = Session.load(state.get[0]) if state.exists else Session()
        frames = list(batches)
        events = pd.concat(frames) if frames else pd.DataFrame(columns=["client_id", "seq", "ts", "action", "text"])
        out = replay(session, events, lookup)
        state.update((session.dump(),))
        if forget_after is not None:
            state.setTimeoutDuration(forget_after)
        yield out

    idle = "NoTimeout" if forget_after is None else "ProcessingTimeTimeout"
    return events.groupBy("client_id").applyInPandasWithState(one, OUTPUT, "session string", "append", idle)


def usage_events(rows: DataFrame) -> DataFrame:
    """Choices that commits wrote out: (client_id, seq, lookup_key, value)."""
    return rows.where("kind = 'usage'").select("client_id", "seq", F.col("text").alias("lookup_key"), "value")
