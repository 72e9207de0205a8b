"""Mixing sources to target weights by systematic sampling.

Within a source every document has expected copies = target / source size. The copies are prefix-summed in order of size,
one random offset per source is added, and a document is emitted once for every integer boundary that its own stretch
crosses. The order by size stratifies the sample, so the words taken come near the target, and no document is taken more
often than its expected copies rounded up, hence never beyond max_repeat times.

The prefix sum is distributed: documents fall into blocks (source, size class, hash slot) of about sqrt(rows) rows; block
totals are prefix-summed over the few blocks of a source and each block adds its own running sum. Sums are exact decimals,
so neither partitioning nor reruns change a copy.

Fixed cases: a null or empty text has size 0 and is taken as often as its stretch says, which costs no words; the null
source is a source of its own, last in order; repeated rows count one by one; ties in size go by doc_id, then by the
text's hash; a source of size 0 has target 0 and no copies; an empty table gives no rows; clashing column names in the
input do no harm, as only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

#: Weights of the sources in order of code point, repeated.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix"
EXACT = "decimal(38,12)"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, source_size): share of all sizes dealt by weight, capped, excess reshared.

    Sources in order of cap / weight are capped one after the other as long as the level they would get lies above their
    cap; what is left over the uncapped weights is the final level. One row for each source passes here, nothing else.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("w", pick.cast("long")).withColumn("cap", F.col("source_size") * F.lit(max_repeat))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole).cast("double") * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    ).cast("double")
    leveled = weighed.withColumn("level", level).withColumn("free", F.col("cap").cast("double") / F.col("w") >= F.col("level"))
    final = F.min(F.when(F.col("free"), F.struct(F.col("cap").cast("double") / F.col("w"), F.col("level")))).over(whole)["level"]
    return leveled.select("source", "source_size", F.when(F.col("free"), F.col("w") * final).otherwise(F.col("cap").cast("double")).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """The random offset of a source in [0, 1), a multiple of 2^-32."""
    key = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))))
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") / F.lit(2.0**32)).cast(EXACT)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, text_hash, size, source, source_size, target, copies."""
    deal = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.md5("text"), F.lit(""))))
    rows = cut(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), F.conv(F.substring(deal, 1, 8), 16, 10).cast("long").alias("deal")), "sizes"
    )
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    goal = targets(sizes, weights, share, max_repeat)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).cast(EXACT)
    block_rows = max(256, int(rows.count() ** 0.5))
    size_class = F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int")
    # a size class of a source is dealt to so many slots that blocks stay near block_rows rows
    slots = rows.groupBy("source", size_class.alias("c")).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("slots"))
    tagged = in_slots(rows.withColumn("c", size_class), slots)
    blocks = tagged.groupBy("source", "c", "slot").agg(F.count("*").alias("n"))
    priced = blocks.join(goal, blocks["source"].eqNullSafe(goal["source"])).select(blocks["source"], "c", "slot", "n", "source_size", "target", rate.alias("rate"))
    ahead = Window.partitionBy("source").orderBy("c", "slot").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") * F.col("rate")).over(ahead), F.lit(0)).cast(EXACT) + offset(F.col("source"), seed)
    starts = priced.withColumn("start", start.cast(EXACT))
    own = Window.partitionBy("source", "c", "slot").orderBy("size", F.col("doc_id").asc_nulls_last(), "text_hash")
    placed = tagged.withColumn("rank", F.row_number().over(own))
    s = starts.select(F.col("source").alias("s_"), F.col("c").alias("c_"), F.col("slot").alias("slot_"), "source_size", "target", "rate", "start")
    joined = placed.join(s, placed["source"].eqNullSafe(s["s_"]) & (placed["c"] == s["c_"]) & (placed["slot"] == s["slot_"]))
    after = (F.col("start") + F.col("rank") * F.col("rate")).cast(EXACT)
    prior = (F.col("start") + (F.col("rank") - 1) * F.col("rate")).cast(EXACT)
    return joined.select("doc_id", "text_hash", "size", "source", "source_size", "target", (F.floor(after) - F.floor(prior)).cast("long").alias("copies"))


def in_slots(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """rows with the column slot, by the hash of doc_id and text, so that rows of one id (or none) don't meet in one slot."""
    s = slots.select(F.col("source").alias("s_"), F.col("c").alias("c_"), "slots")
    joined = rows.join(s, rows["source"].eqNullSafe(s["s_"]) & (rows["c"] == s["c_"]))
    slot = F.pmod("deal", F.col("slots"))
    return joined.withColumn("slot", slot.cast("int")).drop("s_", "c_", "slots")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents taken, each once for every copy, with the column copy (from 0; a column of that name gives way)."""
    names = {"doc_id": "mix_id__", "text_hash": "mix_hash__", "source": "mix_source__"}
    taken = mix(docs, **options).select(*[F.col(k).alias(v) for k, v in names.items()], "copies")
    # repeated rows are alike in id, hash and source: the copies of such a group are dealt to one row
    taken = cut(taken.groupBy(*names.values()).agg(F.sum("copies").alias("mix_copies__"), F.count("*").alias("mix_rows__")).where("mix_copies__ > 0"), "taken")
    # docs travel as one column, so their names can't clash with those here
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "copy"]).alias("doc"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"), F.col("source").alias("own_source"))
    on = F.col("own_id").eqNullSafe(F.col("mix_id__")) & (F.col("own_hash") == F.col("mix_hash__")) & F.col("own_source").eqNullSafe(F.col("mix_source__"))
    met = rows.join(taken.hint("merge"), on)  # texts are shuffled once at every size
    if taken.where("mix_rows__ > 1").limit(1).count():
        met = met.where("mix_rows__ = 1").unionByName(met.where("mix_rows__ > 1").dropDuplicates(list(names.values())))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_copies__") - 1))
    return met.select("doc.*", copy.alias("copy"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, source, text,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
n AS (SELECT count(*) AS rows_, greatest(256, CAST(floor(sqrt(count(*))) AS BIGINT)) AS block_rows FROM t),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM t GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, source_size * 3 AS cap FROM s),
v AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio,
    (CAST(sum(source_size) OVER () AS DOUBLE)
      - CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM w),
g AS (SELECT source, source_size,
    CASE WHEN ratio >= level THEN w * (SELECT arg_min(level, ratio) FROM v WHERE ratio >= level) ELSE CAST(cap AS DOUBLE) END AS target FROM v),
r AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS DECIMAL(38, 12)) AS rate FROM g),
c AS (SELECT t.*, CAST(floor(log2(size + 1.0) * 8) AS INT) AS c FROM t),
k AS (SELECT c.*, CAST(ceil(count(*) OVER (PARTITION BY source, c) / CAST(block_rows AS DOUBLE)) AS BIGINT) AS slots FROM c, n),
m AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(md5(text), '')), 1, 8) AS BIGINT) % slots AS slot FROM k),
o AS (SELECT m.doc_id, m.size, r.source_size, r.target, r.rate,
    CAST(CAST('0x' || substr(md5('mix|' || coalesce('s' || m.source, 'n')), 1, 8) AS BIGINT) / 4294967296.0 AS DECIMAL(38, 12)) AS u,
    row_number() OVER (PARTITION BY m.source ORDER BY c, slot, size, doc_id) AS i
  FROM m JOIN r ON m.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(u + i * rate) - floor(u + (i - 1) * rate)) AS BIGINT) AS taken
FROM o
"""
