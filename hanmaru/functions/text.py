"""Text identity and measures.

Strings are compared in NFC; offsets count UTF-16 units. Nearly all strings are in NFC already, which a pattern can tell; only
others are normalised.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings of ASCII, precomposed Hangul, compatibility jamo and unified ideographs are in NFC as they stand.
SURELY_NFC = r"^[\x00-\x7F가-힣ㄱ-ㆎ一-鿿]*\z"
#: Hangul: syllables, compatibility jamo, jamo, and both extended jamo blocks.
HANGUL = "가-힣ㄱ-ㆎᄀ-ᇿꥠ-ꥼힰ-ퟻ"

#: One or two characters, each a user-perceived one before any other of these: ASCII, Latin letters, precomposed Hangul, ideographs.
APART = r"^[\n\x20-\x7EÀ-ɏ가-힣一-鿿]{1,2}\z"


def nfc_key(c: Column) -> Column:
    """The NFC form of a string: the form in which keys are joined, grouped and ordered.

    The normaliser is the one of the Unicode library that Spark's collations come with, so no row leaves the JVM.
    """
    return F.when(c.rlike(SURELY_NFC), c).when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False)))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.floor(F.length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def utf16_slice(text: Column, loc: Column, size: Column) -> Column:
    """The stretch of `size` UTF-16 units from `loc` on; null if it leaves the text or cuts a character in two."""
    return units_slice(F.encode(text, "UTF-16BE"), loc, size)


def units_slice(raw: Column, loc: Column, size: Column) -> Column:
    """utf16_slice of a text in UTF-16BE: many stretches of one text need it encoded only once."""
    part = F.substring(raw, (loc * 2 + 1).cast("int"), (size * 2).cast("int"))
    head = F.hex(F.substring(raw, (loc * 2 + 1).cast("int"), F.lit(1)))
    after = F.hex(F.substring(raw, ((loc + size) * 2 + 1).cast("int"), F.lit(1)))
    low = lambda h: h.between("DC", "DF")  # noqa: E731  the second half of a surrogate pair
    inside = (loc >= 0) & (size >= 0) & (loc + size <= F.floor(F.length(raw) / 2).cast("long"))
    return F.when(inside & ~(low(head) & (size > 0)) & ~F.coalesce(low(after), F.lit(False)), F.decode(part, "UTF-16BE"))


def hangul_tail(c: Column) -> Column:
    """The run of Hangul at the end of a string, empty if there is none."""
    return F.reverse(F.regexp_extract(F.reverse(c), f"^[{HANGUL}]+", 0))


def count_of(c: Column, chars: str) -> Column:
    """How many characters of a string are among these."""
    return (F.length(c) - F.length(F.translate(c, chars, ""))).cast("long")


def hangul_count(c: Column) -> Column:
    """How many characters of a string are Hangul."""
    return (F.length(c) - F.length(F.regexp_replace(c, f"[{HANGUL}]+", ""))).cast("long")


def graphemes(c: Column) -> Column:
    """The user-perceived characters of a string."""
    return F.regexp_extract_all(c, F.lit(r"\X"), F.lit(0))


def drop_last_grapheme(c: Column) -> Column:
    """The string without its last user-perceived character.

    Nearly all strings end in two characters that never join, which a pattern can tell; only others are cut up whole.
    """
    g = graphemes(c)
    cut_up = F.when(F.size(g) > 0, F.array_join(F.slice(g, F.lit(1), F.size(g) - 1), "")).otherwise(F.lit(""))
    return F.when(F.substring(c, -2, 2).rlike(APART), F.left(c, F.length(c) - 1)).otherwise(cut_up)


#: Conjoining jamo that have a compatibility form: leading consonants, vowels, trailing consonants (Unicode names agree).
def _compatibility() -> dict[str, str]:
    names = {}
    for c in range(0x3131, 0x3164):
        names[unicodedata.name(chr(c)).removeprefix("HANGUL LETTER ")] = chr(c)
    out = {}
    for c in [*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]:
        word = unicodedata.name(chr(c)).split(maxsplit=2)[2]
        if word in names:
            out[chr(c)] = names[word]
    return out


def compose_jamo(c: Column) -> Column:
    """NFC, with conjoining jamo that stay single shown as compatibility jamo."""
    table = _compatibility()
    return F.translate(nfc_key(c), "".join(table), "".join(table.values()))
