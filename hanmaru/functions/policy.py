"""Rules that classify keys, commands and characters, as Column expressions."""

from __future__ import annotations

from string import ascii_letters

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: modifier bits, key codes and command names of the platform
SHIFT, CONTROL, OPTION, COMMAND = 1 << 17, 1 << 18, 1 << 19, 1 << 20
DEVICE_INDEPENDENT = SHIFT | CONTROL | OPTION | COMMAND
RETURN, ENTER, LEFT, RIGHT = 36, 76, 123, 124
#: Key code -> character of a US keyboard, unshifted.
ANSI_KEYS = {
    0: "a", 1: "s", 2: "d", 3: "f", 4: "h", 5: "g", 6: "z", 7: "x", 8: "c", 9: "v", 11: "b", 12: "q", 13: "w", 14: "e", 15: "r", 16: "y",
    17: "t", 18: "1", 19: "2", 20: "3", 21: "4", 22: "6", 23: "5", 24: "=", 25: "9", 26: "7", 27: "-", 28: "8", 29: "0", 30: "]", 31: "o",
    32: "u", 33: "[", 34: "i", 35: "p", 37: "l", 38: "j", 39: "'", 40: "k", 41: ";", 42: "\\", 43: ",", 44: "/", 45: "n", 46: "m", 47: ".",
    50: "`",
}
SHIFTED = dict(zip("1234567890-=[]\\;',./`", '!@#$%^&*()_+{}|:"<>?~', strict=True))
#: Letters whose shifted key has a jamo of its own.
SHIFT_LETTERS = "qwertop"
#: Digit keys of the main row and the keypad that pick a candidate.
CANDIDATE_KEYS = {18: 0, 19: 1, 20: 2, 21: 3, 23: 4, 22: 5, 26: 6, 28: 7, 25: 8, 29: 9}
NEWLINE_COMMANDS = ("insertNewline:", "insertParagraphSeparator:", "insertNewlineIgnoringFieldEditor:", "insertLineBreak:")
NAVIGATION_EXACT = ("pageUp:", "pageDown:", "scrollPageUp:", "scrollPageDown:")
NAVIGATION_PREFIXES = (
    "moveLeft", "moveRight", "moveUp", "moveDown", "moveWordLeft", "moveWordRight", "moveBackward", "moveForward",
    "moveToBeginningOf", "moveToEndOf",
)
#: Characters by class, all of them: printable ASCII, those that end a clause, and line ends.
PRINTABLE, CLAUSE_ENDS, NEWLINES = "".join(map(chr, range(0x20, 0x7F))), ".?!;\n\r" + ascii_letters, "\r\n\u2028\u2029"
WON = "₩"
#: Key that turns real-time conversion on and off, with Control.
TOGGLE = "a"


def modifiers(c: Column) -> Column:
    return c.bitwiseAND(DEVICE_INDEPENDENT)


def is_printable_ascii(c: Column) -> Column:
    return c.rlike(r"^[ -~]\z")


def commits_clause(c: Column) -> Column:
    """Sentence marks, line ends and ASCII letters end a clause."""
    return c.rlike(r"^(?:[.?!;\n\rA-Za-z])\z")


def is_newline_text(c: Column) -> Column:
    return c.isin(*NEWLINES)


def is_navigation(command: Column) -> Column:
    any_ = command.isin(*NAVIGATION_EXACT)
    for p in NAVIGATION_PREFIXES:
        any_ = any_ | F.startswith(command, F.lit(p))
    return any_


def is_newline_command(command: Column) -> Column:
    return command.isin(*NEWLINE_COMMANDS)


def is_manual_trigger(key_code: Column, mods: Column) -> Column:
    """Return or Enter with Option and nothing else."""
    return key_code.isin(RETURN, ENTER) & (modifiers(mods) == OPTION)


def is_realtime_toggle(chars: Column, mods: Column) -> Column:
    """A with Control and nothing else."""
    return (F.lower(chars) == TOGGLE) & (modifiers(mods) == CONTROL)


def passes_through(mods: Column) -> Column:
    return mods.bitwiseAND(COMMAND | CONTROL) != 0


def typed_character(chars: Column, key_code: Column, mods: Column) -> Column:
    """The character that a key stands for: its own single printable character, else that of its code.

    Few letters change with Shift, symbols as on a US keyboard. Without modifiers a capital counts as shifted.
    """
    table = F.create_map(*[F.lit(x) for kv in ANSI_KEYS.items() for x in kv])
    marks = F.create_map(*[F.lit(x) for kv in SHIFTED.items() for x in kv])
    own = F.coalesce(is_printable_ascii(chars), F.lit(False))
    base = F.when(own, F.lower(chars)).otherwise(table[key_code.cast("int")])
    shift = F.coalesce(mods.bitwiseAND(SHIFT) != 0, own & chars.rlike(r"^[A-Z]\z"))
    moved = F.when(base.isin(*SHIFT_LETTERS), F.upper(base)).when(base.rlike(r"^[a-z]\z"), base).otherwise(F.coalesce(marks[base], base))
    return F.when(shift, moved).otherwise(base)


def candidate_index(key_code: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CANDIDATE_KEYS.items() for x in kv])[key_code.cast("int")]


def boundary_step(key_code: Column, mods: Column) -> Column:
    """+1 and -1 for Shift with the right and left arrow, null for anything else."""
    only = modifiers(mods) == SHIFT
    return F.when(only & (key_code == RIGHT), 1).when(only & (key_code == LEFT), -1)


def typed(chars: str | None, key_code: int, mods: int) -> str | None:
    """`typed_character` for one key, null if it stands for no character."""
    own = chars is not None and len(chars) == 1 and " " <= chars <= "~"
    base = chars.lower() if own else ANSI_KEYS.get(key_code)
    if base is None or not mods & SHIFT:
        return base
    return base.upper() if base in SHIFT_LETTERS else SHIFTED.get(base, base)


def shown_character(c: Column) -> Column:
    """The back quote types a won sign."""
    return F.when(c == "`", F.lit(WON)).otherwise(c)
