"""Dictionary lookup, overlay of user entries, and ranking.

Tables: dictionary(pos, reading, value, comment), user(pos, reading, value, comment), usage(lookup_key, value, count),
frequency(value, freq), requests(request_id, key). Keys are joined in NFC. Candidates are merged and ranked once for every
reading, then requests pick them up: one shuffle by reading, whatever the number of requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerals import normal_digits, numeral_candidates
from ..functions.text import nfc_key


def _seeds(rows: DataFrame, user: bool) -> DataFrame:
    """Entries with NFC keys and base_rank, the place in the reading's list; entries without a value still hold a place."""
    keyed = rows.select("pos", "reading", "value", F.coalesce("comment", F.lit("")).alias("comment")).withColumn("reading_k", nfc_key(F.col("reading")))
    place = F.row_number().over(Window.partitionBy("reading_k").orderBy("pos")) - 1
    ranked = keyed.withColumn("base_rank", place.cast("long")).where("value is not null")
    return ranked.withColumn("value_k", nfc_key(F.col("value"))).withColumn("is_user", F.lit(user))


def _latest(column: str, only: Column, order: tuple[str, ...] = ("is_user", "pos")) -> Column:
    """The column's value in the last of the rows that `only` marks."""
    return F.max_by(F.when(only, F.col(column)), F.when(only, F.struct(*order)))


def merged(dictionary: DataFrame, user: DataFrame) -> DataFrame:
    """System and user entries, one row a (reading, value): the user's wins and keeps a comment of the system if it has none.

    Within a side the last entry wins; a user's comment is the last that isn't empty.
    """
    both = _seeds(dictionary, False).unionByName(_seeds(user, True))
    every, mine, system = F.lit(True), F.col("is_user") & (F.col("comment") != ""), ~F.col("is_user")
    return both.groupBy("reading_k", "value_k").agg(
        _latest("reading", every).alias("reading"),
        _latest("value", every).alias("value"),
        F.coalesce(_latest("comment", mine), _latest("comment", system), F.lit("")).alias("comment"),
        F.max("is_user").alias("is_user"),
        _latest("base_rank", every).alias("base_rank"),
    )


def max_frequency(rows: DataFrame) -> DataFrame:
    """frequency(value_k, freq): the greatest of each value's."""
    return rows.select(nfc_key(F.col("value")).alias("value_k"), "freq").groupBy("value_k").agg(F.max("freq").alias("freq"))


def usage_counts(usage: DataFrame) -> DataFrame:
    return usage.select(nfc_key(F.col("lookup_key")).alias("reading_k"), nfc_key(F.col("value")).alias("value_k"), "count").groupBy("reading_k", "value_k").agg(F.sum("count").alias("usage_count"))


def ranked(dictionary: DataFrame, user: DataFrame, usage: DataFrame, frequency: DataFrame) -> DataFrame:
    """All candidates with their rank rn within a reading, from 1.

    Order: the user's own first, then usage and frequency down, base_rank up, value, reading. A value equal to its reading
    is no candidate.
    """
    zero = F.lit(0).cast("long")
    rows = merged(dictionary, user).where(F.col("reading_k") != F.col("value_k"))
    rows = rows.join(usage_counts(usage), ["reading_k", "value_k"], "left").join(max_frequency(frequency), "value_k", "left")
    rows = rows.withColumns({"usage_count": F.coalesce("usage_count", zero), "frequency": F.coalesce("freq", zero)})
    order = Window.partitionBy("reading_k").orderBy(F.desc("is_user"), F.desc("usage_count"), F.desc("frequency"), "base_rank", "value_k", "reading")
    return rows.select(
        "reading_k", F.row_number().over(order).cast("long").alias("rn"), "reading", "value", "value_k", "comment",
        F.when(F.col("is_user"), "userDefined").otherwise("system").alias("source"), "usage_count", "frequency", "base_rank",
    )


def exact_candidates(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of each request's key; an empty key has none."""
    keyed = requests.where("key <> ''").withColumn("reading_k", nfc_key(F.col("key")))
    return keyed.join(candidates, "reading_k").drop("reading_k", "value_k")


def prefix_candidates(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of readings that the key starts with, the longest reading first. Prefixes are joined, never compared."""
    keyed = requests.where("key <> ''").withColumn("k", nfc_key(F.col("key")))
    prefixes = keyed.select(*requests.columns, F.explode(F.sequence(F.lit(1), F.length("k"))).alias("n"), "k").withColumn("reading_k", F.substring("k", 1, F.col("n")))
    order = Window.partitionBy("request_id").orderBy(F.desc("n"), "rn")
    found = prefixes.join(candidates, "reading_k").withColumn("prn", F.row_number().over(order).cast("long"))
    return found.select(*requests.columns, "prn", "reading", "value", "comment", "source", "usage_count", "frequency", "base_rank")


def hangul_usage(requests: DataFrame, usage: DataFrame) -> DataFrame:
    """requests with how often the key itself was chosen instead of a candidate."""
    own = usage_counts(usage).where(F.col("reading_k") == F.col("value_k")).select("reading_k", F.col("usage_count").alias("hangul_usage"))
    keyed = requests.withColumn("reading_k", nfc_key(F.col("key"))).join(own, "reading_k", "left")
    return keyed.withColumn("hangul_usage", F.coalesce("hangul_usage", F.lit(0).cast("long"))).drop("reading_k")


def prefers_hangul(own: Column, top: Column) -> Column:
    """The key as it stands beats the first candidate. The first in rank counts, not the most used."""
    return (own > 0) & (own >= F.coalesce(top, F.lit(0)))


def preference(requests: DataFrame, candidates: DataFrame, usage: DataFrame) -> DataFrame:
    """Each request with its first candidate and whether the key itself is preferred."""
    first = candidates.where("rn = 1").select("reading_k", F.col("value").alias("top_value"), F.col("usage_count").alias("top_usage"))
    size = candidates.groupBy("reading_k").agg(F.count("*").alias("n_candidates"))
    keyed = hangul_usage(requests, usage).withColumn("reading_k", nfc_key(F.col("key")))
    joined = keyed.join(first, "reading_k", "left").join(size, "reading_k", "left").drop("reading_k")
    prefer = prefers_hangul(F.col("hangul_usage"), F.col("top_usage"))
    return joined.withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0).cast("long"))).withColumn("prefer_hangul", prefer)


def lookup(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Numeric readings for numeric keys, dictionary candidates for all others: two disjoint branches."""
    numeric = F.col("key").isNotNull() & normal_digits(F.col("key")).isNotNull()
    numbers = numeral_candidates(requests.where(numeric)).withColumn("rn", F.col("base_rank") + 1)
    return numbers.unionByName(exact_candidates(requests.where(~numeric), candidates))
