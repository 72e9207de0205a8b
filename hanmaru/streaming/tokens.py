"""A tokenizer's answers, joined to the keys whose clauses they read, in batches and streams alike.

The tokenizer sees what a client has composed after a key and answers with the clause and its tokenizations, best first
(ANSWERS). The join is by client and key, not by clause, so clauses that many clients type make no hot key; the clause goes along,
as an answer serves only while the source is the clause that it read.

Fixed cases: keys without an answer, or with one that comes before them or more than `late` after them, go without; of a batch's
answers to one key the earliest counts, of a stream's the one that arrived first; an answer of a null clause or without
tokenizations is none, and one with an empty list of them says that the clause has no words but its numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWERS = "client_id string, seq long, ts double, clause string, tokenizations array<array<struct<tag:string,position:int,length:int>>>"


def moment(ts: str) -> Column:
    """Seconds as a timestamp."""
    return F.timestamp_micros((F.col(ts) * 1e6).cast("long"))


def answered(keys: DataFrame, answers: DataFrame, late: str = "10 seconds") -> DataFrame:
    """keys with their time `at`, the clause, and its tokenizations as JSON in `tokens`; both null where no answer came."""
    known = answers.where("clause is not null and tokenizations is not null").select(
        F.col("client_id").alias("client__"), F.col("seq").alias("seq__"), moment("ts").alias("answered_at"), "clause", F.to_json("tokenizations").alias("tokens")
    )
    if answers.isStreaming:
        known = known.withWatermark("answered_at", late).dropDuplicatesWithinWatermark(["client__", "seq__"])
    else:
        first = F.min(F.struct("answered_at", "clause", "tokens")).alias("a")
        known = known.groupBy("client__", "seq__").agg(first).select("client__", "seq__", "a.*")
    timed = keys.withColumn("at", moment("ts")).withWatermark("at", late)
    mine = F.expr(f"client_id = client__ and seq = seq__ and answered_at >= at and answered_at <= at + interval {late}")
    return timed.join(known, mine, "left").drop("client__", "seq__", "answered_at")
