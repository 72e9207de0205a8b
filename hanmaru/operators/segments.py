"""Segmentation of clauses: tokens and numeric spans, the best of several tokenizations, and partitions drawn by hand.

Tables: clauses(clause_id, text), tokenizations(clause_id, result_rank, tokens), lookup(key_k, n_candidates, top_value,
top_usage, hangul_usage) with one row for each key. Offsets are UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerals import normal_digits
from ..functions.text import nfc_key, units_slice, utf16_length
from .candidates import prefers_hangul

# fixed values: part-of-speech tags whose words are looked up, and those of them that never convert unasked
ELIGIBLE = ("nng", "nnp", "nnb", "nr", "np", "sn", "vv", "vvi", "va", "vai", "vx", "vxi", "mm", "mag", "maj", "ic", "xpn", "xsn", "xsv", "xsa", "xsai", "xr")
NOT_UNASKED = ("np", "ic", "vx", "vxi", "xsv", "xsa", "xsai", "xsn")
TOP_TOKENIZATIONS = 3
NUMERIC = "[0-9,]*[0-9][0-9,]*"
#: Spans of a text that are gathered at a time.
PART = 32


def numeric_spans(text: Column, pattern: str = NUMERIC) -> Column:
    """array<struct<loc, len, surface>> of the longest runs of digits and commas that hold a digit."""
    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), utf16_length)
    none = F.array().cast("array<struct<loc:bigint,len:bigint,surface:string>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("got"))

    def step(acc: Column, x: Column) -> Column:
        loc = acc["at"] + x["g"]
        size = utf16_length(x["r"])
        span = F.struct(loc.alias("loc"), size.alias("len"), x["r"].alias("surface"))
        return F.struct((loc + size).alias("at"), F.concat(acc["got"], F.array(span)).alias("got"))

    def some(acc: Column, pairs: Column) -> Column:
        """The next pairs, gathered apart: to append each to all before it would take time by the square of their number."""
        return F.aggregate(pairs, F.struct(acc["at"].alias("at"), none.alias("got")), step, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["got"], x["got"]).alias("got")))

    def parts(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(pairs) - 1, F.lit(0)), F.lit(PART)), lambda i: F.slice(pairs, i + 1, PART))

    pairs = F.filter(F.arrays_zip(runs.alias("r"), gaps.alias("g")), lambda x: x["r"].isNotNull())
    # as a variable of the lambda the pairs are made once
    found = F.transform(F.array(pairs), lambda p: F.aggregate(parts(p), start, some, lambda acc: acc["got"]))[0]
    return F.coalesce(found, none)


def lookup_key(surface: Column) -> Column:
    return F.coalesce(normal_digits(surface), surface)


def overlap(a: str, b: str) -> Column:
    return (F.col(f"{a}.loc") < F.col(f"{b}.loc") + F.col(f"{b}.len")) & (F.col(f"{b}.loc") < F.col(f"{a}.loc") + F.col(f"{a}.len"))


def without_overlaps(rows: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """rows whose stretch (loc, len) meets none of spans under the same key: an interval anti-join that hashes the key."""
    return rows.alias("r").join(spans.select(key, "loc", "len").alias("s"), (F.col(f"r.{key}") == F.col(f"s.{key}")) & overlap("r", "s"), "left_anti")


def realtime_segments(clauses: DataFrame, tokenizations: DataFrame, lookup: DataFrame) -> DataFrame:
    """Segments of every tokenization: (clause_id, result_rank, idx, loc, len, surface, lookup_key, tag, is_convertible, preview).

    Tokens that touch a numeric span give way to it. With numeric spans the order is by place, longer first; without, the
    tokens' own.
    """
    few = tokenizations.where(F.col("result_rank") < TOP_TOKENIZATIONS)
    # a text is encoded once, not for each of its tokens
    raw = clauses.select("clause_id", F.encode("text", "UTF-16BE").alias("raw"))
    flat = few.join(raw, "clause_id").select("clause_id", "result_rank", "raw", F.posexplode_outer("tokens").alias("token_pos", "t"))  # not outer, a filter on the tokens would make them twice
    tokens = flat.where(F.col("t.tag").isin(*ELIGIBLE) & (F.col("t.length") > 0)).select(
        "clause_id", "result_rank", "token_pos", F.col("t.position").cast("long").alias("loc"), F.col("t.length").cast("long").alias("len"), F.col("t.tag").alias("tag"),
        units_slice(F.col("raw"), F.col("t.position").cast("long"), F.col("t.length").cast("long")).alias("surface"),
    ).where("surface is not null")
    keyed = tokens.withColumn("lookup_key", lookup_key(F.col("surface"))).withColumn("key_k", nfc_key(F.col("lookup_key")))
    known = keyed.join(lookup, "key_k", "left")
    held = ~prefers_hangul(F.coalesce("hangul_usage", F.lit(0)), F.col("top_usage")) & ~F.col("tag").isin(*NOT_UNASKED)
    words = known.select(
        "clause_id", "result_rank", "token_pos", "loc", "len", "surface", "lookup_key", "tag",
        (F.coalesce("n_candidates", F.lit(0)) > 0).alias("is_convertible"), F.when(held, F.col("top_value")).alias("preview"),
    )
    spans = clauses.select("clause_id", F.explode(numeric_spans(F.col("text"))).alias("s")).select("clause_id", "s.loc", "s.len", "s.surface")
    numbers = spans.join(few.select("clause_id", "result_rank"), "clause_id").select(
        "clause_id", "result_rank", F.lit(None).cast("int").alias("token_pos"), "loc", "len", "surface", lookup_key(F.col("surface")).alias("lookup_key"),
        F.lit("sn").alias("tag"), F.lit(True).alias("is_convertible"), F.lit(None).cast("string").alias("preview"),
    )
    both = without_overlaps(words, spans, "clause_id").unionByName(numbers).repartition("clause_id")
    mine = Window.partitionBy("clause_id", "result_rank")
    by_place = F.max(F.col("token_pos").isNull()).over(mine)
    order = mine.orderBy(F.when(F.col("by_place"), F.col("loc")).otherwise(F.col("token_pos")), F.when(F.col("by_place"), -F.col("len")), "token_pos")
    return both.withColumn("by_place", by_place).withColumn("idx", (F.row_number().over(order) - 1).cast("int")).drop("by_place", "token_pos")


def best_segments(segments: DataFrame, tokenizations: DataFrame) -> DataFrame:
    """Segments of the tokenization whose convertible stretches are longest in sum; of equals, the earlier one."""
    first = tokenizations.where(F.col("result_rank") < TOP_TOKENIZATIONS).groupBy("clause_id").agg(F.min("result_rank").alias("first_rank"))
    cover = F.sum(F.when(F.col("is_convertible"), F.col("len")).otherwise(0)).over(Window.partitionBy("clause_id", "result_rank"))
    best = F.max(F.struct("cover", (-F.col("result_rank")).alias("place"))).over(Window.partitionBy("clause_id"))
    # the first tokenization wins where none covers anything, even if it has no segments
    mine = (F.col("result_rank") == -F.col("best.place")) & ((F.col("cover") > 0) | (F.col("result_rank") == F.col("first_rank")))
    return segments.withColumn("cover", cover).withColumn("best", best).join(first, "clause_id").where(mine).select(*segments.columns)


def manual_segments(clauses: DataFrame, lookup: DataFrame) -> DataFrame:
    """Segments of clauses (clause_id, text, boundaries) cut at the boundaries: no gaps, no tags asked, usage ignored.

    Numbers are convertible but keep their digits.
    """
    n = utf16_length(F.col("text"))
    inner = F.array_sort(F.array_distinct(F.filter(F.transform("boundaries", lambda b: b.cast("long")), lambda b: (b > 0) & (b < n))))
    edges = F.concat(F.array(F.lit(0).cast("long")), inner, F.array(n))
    cut = clauses.where("text <> ''").select("clause_id", F.encode("text", "UTF-16BE").alias("raw"), edges.alias("e"))
    flat = cut.select("clause_id", "raw", "e", F.posexplode(F.slice("e", F.lit(1), F.size("e") - 1)).alias("k", "loc"))
    flat = flat.withColumn("len", F.get("e", F.col("k") + 1) - F.col("loc")).withColumn("surface", units_slice(F.col("raw"), F.col("loc"), F.col("len"))).where("len > 0 and surface is not null")
    keyed = flat.withColumn("lookup_key", lookup_key(F.col("surface"))).withColumn("key_k", nfc_key(F.col("lookup_key"))).join(lookup, "key_k", "left")
    number = normal_digits(F.col("surface")).isNotNull()
    order = Window.partitionBy("clause_id").orderBy("loc")
    return keyed.select(
        "clause_id", (F.row_number().over(order) - 1).cast("int").alias("idx"), "loc", "len", "surface", "lookup_key",
        F.when(number, "sn").otherwise("nng").alias("tag"), (number | (F.coalesce("n_candidates", F.lit(0)) > 0)).alias("is_convertible"),
        F.when(~number, F.col("top_value")).alias("preview"),
    )


def tokenize(texts: DataFrame, pattern: str = r"\S+") -> DataFrame:
    """A default tokenizer for tests and simple texts: runs that match the pattern, all tagged as common nouns."""
    tokens = F.transform(numeric_spans(F.col("text"), pattern), lambda s: F.struct(s["surface"].alias("form"), F.lit("nng").alias("tag"), s["loc"].cast("int").alias("position"), s["len"].cast("int").alias("length")))
    return texts.select("clause_id", F.lit(0).alias("result_rank"), F.lit(0.0).alias("score"), tokens.alias("tokens"))
