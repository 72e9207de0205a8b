"""The tokenizer against all ways to cut short clauses."""

import random

from hanmaru.operators import lattice as L
from hanmaru.operators.segments import best_segments, realtime_segments

WORDS = [("동해", "nnp", 5), ("동", "nng", 9), ("해", "nng", 8), ("해물", "nng", 6), ("물", "nng", 4), ("물", "vv", 4), ("과", "jc", 2), ("동해", "nnp", 7), ("", "nng", 0)]


def every(text, at=0):
    """All (cost, name) of a clause from a place on."""
    if at == len(text):
        return [(0, ())]
    known = {(f, t): c for f, t, c in sorted(WORDS, key=lambda w: -w[2]) if f} | {}
    steps = [(f, t, c) for (f, t), c in known.items() if text.startswith(f, at)] + [(text[at], L.UNKNOWN, L.UNKNOWN_COST)]
    return [(c + rest, ((f, t), *path)) for f, t, c in steps for rest, path in every(text, at + len(f))]


def test_cheapest_paths_against_all(spark):
    rng = random.Random(2)
    texts = {i: "".join(rng.choice("동해물과x") for _ in range(rng.randint(1, 7))) for i in range(40)} | {98: "", 99: None}
    clauses = spark.createDataFrame(list(texts.items()), "clause_id long, text string")
    got = {}
    for r in L.tokenizations(clauses, spark.createDataFrame(WORDS, "form string, tag string, cost int")).collect():
        got[r.clause_id, r.result_rank] = (-r.score, "|".join(f"{t.form}/{t.tag}" for t in r.tokens))
        assert [t.position for t in r.tokens] == [sum(u.length for u in r.tokens[:i]) for i in range(len(r.tokens))]
    want = {}
    for i, text in texts.items():
        if text:
            ranked = sorted((c, "|".join(f"{f}/{t}" for f, t in path)) for c, path in every(text))[:3]
            want |= {(i, k): (float(c), n) for k, (c, n) in enumerate(ranked)}
    assert got == want


def test_positions_count_utf16_units_and_feed_segments(spark):
    clauses = spark.createDataFrame([("a", "𠀀동해")], "clause_id string, text string")
    words = spark.createDataFrame(WORDS, "form string, tag string, cost int")
    tokens = L.tokenizations(clauses, words)
    known = spark.createDataFrame([("동해", 1, "東海", 0, 0)], "key_k string, n_candidates long, top_value string, top_usage long, hangul_usage long")
    best = best_segments(realtime_segments(clauses, tokens, known), tokens)
    assert [(r["loc"], r["len"], r.surface, r.preview) for r in best.where("is_convertible").collect()] == [(2, 2, "동해", "東海")]


def test_no_words(spark):
    clauses = spark.createDataFrame([("a", "xy")], "clause_id string, text string")
    got = L.tokenizations(clauses, spark.createDataFrame([], "form string, tag string, cost int")).collect()
    assert [[(t.form, t.tag) for t in r.tokens] for r in got] == [[("x", "un"), ("y", "un")]]
