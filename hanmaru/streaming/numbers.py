"""Readings of a digit string for sessions, which look numbers up one at a time; `functions.numerals` has them for tables."""

from __future__ import annotations

from collections.abc import Sequence

# fixed values: digits and units of the notations
HANJA, ROUND_HANJA, HANGUL = "零一二三四五六七八九", "〇一二三四五六七八九", "영일이삼사오육칠팔구"
HANJA_UNITS, HANGUL_UNITS = ("千百十", ["", "萬", "億", "兆", "京"]), ("천백십", ["", "만", "억", "조", "경"])


def quantity(groups: list[str], digits: str, units: tuple[str, Sequence[str]]) -> str:
    small, large = units
    out = ""
    for i, g in enumerate(groups):
        part = ""
        for d, unit in zip(g, [*small, ""], strict=True):
            if d != "0":
                part += ("" if d == "1" and unit else digits[int(d)]) + unit
        out += part + large[len(groups) - 1 - i] if part else ""
    return out or digits[0]


def readings(digits: str) -> list[str]:
    """Readings in the order in which they are offered, each once."""
    spelt = "".join(HANJA[int(d)] for d in digits)
    round_ = "".join(ROUND_HANJA[int(d)] for d in digits) if "0" in digits else ""
    korean = "".join(HANGUL[int(d)] for d in digits)
    n = -(-len(digits) // 4)
    if n > 5 or len(digits) > 1 and digits[0] == "0":  # without units
        found = [spelt, round_, korean]
    else:
        padded = digits.rjust(4 * n, "0")
        groups = [padded[i : i + 4] for i in range(0, 4 * n, 4)]
        hanja, hangul = quantity(groups, HANJA, HANJA_UNITS), quantity(groups, HANGUL, HANGUL_UNITS)
        grouped = "".join(f"{int(g)}{HANGUL_UNITS[1][n - 1 - i]}" for i, g in enumerate(groups) if int(g)) if n > 1 else ""
        found = [spelt, hanja, round_, grouped, hangul] if len(digits) >= 9 else [hanja, spelt, round_, hangul, grouped]
    return list(dict.fromkeys(filter(None, found)))
