"""Readings of digit strings in Hanja and Hangul, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the notation
DIGITS = "0123456789"
HANJA_DIGITS, CIRCLE_ZERO, HANGUL_DIGITS = "零一二三四五六七八九", "〇", "영일이삼사오육칠팔구"
HANJA_UNITS, HANGUL_UNITS = ("千", "百", "十", ""), ("천", "백", "십", "")
HANJA_GROUPS, HANGUL_GROUPS = ("", "萬", "億", "兆", "京"), ("", "만", "억", "조", "경")
COMMENT = "數字"
MAX_GROUPS = 5
#: From nine digits on the plain digits lead.
LARGE_DIGITS = 9


def normal_digits(c: Column) -> Column:
    """The digits of a string of ASCII digits and commas; null for any other string."""
    return F.when(c.rlike(r"^[0-9,]*[0-9][0-9,]*\z"), F.replace(c, F.lit(",")))


def spelled(d: Column, zero: str = "零") -> Column:
    """Digit by digit in Hanja."""
    return F.translate(d, DIGITS, zero + HANJA_DIGITS[1:])


#: Column that holds the digits of a number that readings are put together from.
DIGITS_OF = "digits__"


def _named(parts: list[str]) -> str:
    """A replacement that sets each of the matched groups before its name."""
    return "".join(f"${i}{name}" for i, name in enumerate(parts, start=1))


def quantity(padded: Column, digits: str, units: tuple[str, ...], names: tuple[str, ...]) -> Column:
    """The number of 4 * MAX_GROUPS padded digits as a quantity: every digit is set before its unit and every group before its
    name; then zeros go with their units, ones that stand before a unit, and names that nothing stands before. Zero is empty."""
    after = [units[k] or name for name in reversed(names) for k in range(4)]
    spelt = F.regexp_replace(F.translate(padded, DIGITS, digits), "(.)" * (4 * MAX_GROUPS), _named(after))
    small, large, spoken = "".join(units), "".join(names), digits[1:]
    some = F.regexp_replace(spelt, f"{digits[0]}[{small}]?", "")
    return F.regexp_replace(some, f"{digits[1]}(?=[{small}])|(?<![{spoken}{small}])[{large}]", "")


def grouped(padded: Column) -> Column:
    """Digits with the names of their groups; groups of zero and zeros that lead a group go."""
    split = F.regexp_replace(padded, "([0-9]{4})" * MAX_GROUPS, _named(list(reversed(HANGUL_GROUPS))))
    return F.regexp_replace(split, f"0000[{''.join(HANGUL_GROUPS)}]?|(?<![0-9])0+(?=[0-9])", "")


def with_readings(df, key: str, out: str):
    """df with the readings of its numeric keys in order, without repeats; null where the key isn't a number. Step by step, each
    in a column of its own that the next ones use many times."""
    d, padded = F.col(DIGITS_OF), F.col("padded__")
    few, size = F.length(d) <= 4 * MAX_GROUPS, F.length(d)
    df = df.select("*", normal_digits(F.col(key)).alias(DIGITS_OF))
    df = df.select("*", F.lpad(F.when(few, d).otherwise("0"), 4 * MAX_GROUPS, "0").alias("padded__"))  # longer strings have no quantity
    df = df.select("*", quantity(padded, HANJA_DIGITS, HANJA_UNITS, HANJA_GROUPS).alias("h__"), quantity(padded, HANGUL_DIGITS, HANGUL_UNITS, HANGUL_GROUPS).alias("k__"))
    zero = F.col("h__") == ""
    hanja, hangul = F.when(zero, HANJA_DIGITS[0]).otherwise(F.col("h__")), F.when(zero, HANGUL_DIGITS[0]).otherwise(F.col("k__"))
    named = F.when((size > 4) & few & ~zero, grouped(padded)).otherwise("")
    plain, spoken = spelled(d), F.translate(d, DIGITS, HANGUL_DIGITS)
    circle = F.when(F.contains(d, F.lit("0")), spelled(d, CIRCLE_ZERO)).otherwise("")
    unitless = ~few | ((size > 1) & F.startswith(d, F.lit("0")))
    large = F.length(F.ltrim(d, F.lit("0"))) >= LARGE_DIGITS
    found = F.when(unitless, F.array(plain, circle, spoken)).when(large, F.array(plain, hanja, circle, named, hangul)).otherwise(F.array(hanja, plain, circle, hangul, named))
    return df.select("*", F.when(d.isNotNull(), F.array_remove(F.array_distinct(found), "")).alias(out)).drop("padded__", "h__", "k__")


def numeral_candidates(df, key: str = "key"):
    """A row for each reading of df's numeric keys: df's columns, reading, value, comment, source, usage_count, frequency, base_rank."""
    zero = F.lit(0).cast("long")
    # the plain generator would put a filter on the readings below the columns they are made from, and compute all of them again
    return with_readings(df, key, "readings__").select("*", F.posexplode_outer("readings__").alias("base_rank", "value")).where("base_rank is not null").select(
        *df.columns, F.col(DIGITS_OF).alias("reading"), "value", F.lit(COMMENT).alias("comment"), F.lit("system").alias("source"), zero.alias("usage_count"), zero.alias("frequency"), F.col("base_rank").cast("long").alias("base_rank")
    )
