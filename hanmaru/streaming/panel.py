"""The panel beside a composition as a tagged state: candidates of a manual or a real-time conversion, or a notice.

What is shown decides what a key means. Manual candidates: numbers choose, arrows to the side turn pages, space closes, any
other key closes and goes on. Real-time candidates: arrows to the side move between segments, numbers and other keys close
and go on. A notice closes at any key, which goes on unless it was escape. Both lists share return, tab, and up and down.
"""

from __future__ import annotations

from dataclasses import dataclass, field

PAGE_SIZE = 9
#: Number key that stands for the text itself.
OWN_ROW = 9
#: Choice of the text itself.
OWN = -1
KINDS = ("manual", "realtime", "notice")


@dataclass
class Panel:
    kind: str
    values: list[str] = field(default_factory=list)
    key: str = ""  # the text that is converted; it has a row of its own behind the candidates
    at: int = 0
    on_key: bool = False
    page: int = 0
    loc: int | None = None  # what a manual choice replaces, in UTF-16 units
    size: int | None = None
    segment: int | None = None
    message: str = ""
    detail: str | None = None

    def __post_init__(self) -> None:
        """The start brought into range; the page wins over the highlight."""
        n = len(self.values)
        self.at = min(max(self.at, 0), max(n - 1, 0))
        self.page = min(max(self.page, 0), max(n - 1, 0) // PAGE_SIZE)
        if n and self.at // PAGE_SIZE != self.page:
            self.at = self.page * PAGE_SIZE

    @property
    def numbered(self) -> bool:
        """Number keys choose."""
        return self.kind == "manual"

    @property
    def manual_source(self) -> str | None:
        return self.key if self.kind == "manual" else None

    @property
    def manual_range(self) -> tuple[int | None, int | None] | None:
        return (self.loc, self.size) if self.kind == "manual" else None

    @property
    def segment_surface(self) -> str | None:
        return self.key if self.kind == "realtime" else None

    def chosen(self) -> str | None:
        """The highlighted candidate."""
        return self.values[self.at] if self.at < len(self.values) else None

    def row(self, index: int) -> str | None:
        """The candidate of a number on this page, from 0."""
        at = self.page * PAGE_SIZE + index
        return self.values[at] if 0 <= index < PAGE_SIZE and at < len(self.values) else None

    def move(self, step: int) -> None:
        """One row up or down in the ring of candidates and the text's own row; the page follows candidates only."""
        n = len(self.values)
        if not n:
            self.on_key = False
            return
        to = (n if self.on_key and step < 0 else -1 if self.on_key else self.at) + step
        if 0 <= to < n:
            self.at, self.on_key, self.page = to, False, to // PAGE_SIZE
        elif self.key:
            self.on_key = True
        else:
            self.at = to % n
            self.page = self.at // PAGE_SIZE

    def turn(self, step: int) -> None:
        """To the first row of the next or former page, round at the ends."""
        self.on_key = False
        if self.values:
            self.page = (self.page + step) % -(-len(self.values) // PAGE_SIZE)
            self.at = self.page * PAGE_SIZE

    def take(self, action: str, number: int | None = None) -> tuple[bool, int | None]:
        """Takes an action of the panel: (whether the panel stays, what is chosen: a candidate's place, OWN, or None)."""
        if action in ("up", "down"):
            self.move(1 if action == "down" else -1)
        elif action in ("tab", "backtab"):
            self.turn(1 if action == "tab" else -1)
        elif action in ("escape", "dismiss"):
            return False, None
        elif action == "return":
            if self.kind == "notice" or not self.on_key and self.chosen() is None:
                return False, None
            return False, OWN if self.on_key else self.at
        elif action == "number" and number is not None:
            if number == OWN_ROW:
                return False, OWN
            if self.row(number) is not None:
                return False, self.page * PAGE_SIZE + number
        return True, None

    def dump(self) -> list:
        return [self.kind, self.values, self.key, self.at, self.on_key, self.page, self.loc, self.size, self.segment, self.message, self.detail]
