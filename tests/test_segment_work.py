"""Segments of long texts: spans of many words, tokens made once, and tokenizations without segments."""

from pyspark.sql import functions as F

from hanmaru.operators import segments as S
from hanmaru.plans import whole


def test_spans_of_a_long_text(spark):
    words = [f"w{i}😀" for i in range(20_000)]
    spans = spark.createDataFrame([(" ".join(words),)], "t string").select(S.numeric_spans(F.col("t"), r"\S+").alias("s")).first().s
    at = 0
    for s, w in zip(spans, words, strict=True):
        assert (s.loc, s.len, s.surface) == (at, len(w) + 1, w)
        at += len(w) + 2


def test_tokens_are_made_once(spark, sf_dir):
    plan = whole.turn_best_segments(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "size(transform(" in line]


def test_first_tokenization_without_segments_wins_where_none_covers(spark):
    clauses = spark.createDataFrame([(1, "ab cd")], "clause_id long, text string")
    token = "array<struct<form:string,tag:string,position:int,length:int>>"
    tokens = spark.createDataFrame([(1, 0, []), (1, 1, [("ab", "nng", 0, 2)])], f"clause_id long, result_rank int, tokens {token}")
    known = "key_k string, n_candidates long, top_value string, top_usage long, hangul_usage long"
    for lookup, best in (([], []), ([("ab", 1, "AB", 1, 0)], [(1, "ab")])):
        found = S.best_segments(S.realtime_segments(clauses, tokens, spark.createDataFrame(lookup, known)), tokens)
        assert [(r.result_rank, r.surface) for r in found.collect()] == best
