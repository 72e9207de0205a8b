"""Sessions cut by a tokenizer's answers: published cases, the batch operators on random tokenizations, streams and batches."""

import json
import random

from pyspark.sql import functions as F

from hanmaru.functions import policy as P
from hanmaru.operators import clauses as C
from hanmaru.operators import segments as S
from hanmaru.plans import fixtures
from hanmaru.streaming import keys as K
from hanmaru.streaming import tokens as T
from hanmaru.streaming.session import Lookup, Session, key_of, units
from tests.test_keys import key, tuples


def lookup_of(known):
    out = Lookup({k: [v] for k, v, _, _ in known})
    out.hangul = frozenset(k for k, _, top, own in known if own > 0 and own >= top)
    return out


def read(text, tokenizations, lookup):
    s = Session(mode="realtime", clause=text)
    s.read(text, tokenizations, lookup)
    return s


def as_tokens(rows):
    """clause -> tokenizations by rank."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.clause_id, r.result_rank)):
        out.setdefault(r.clause_id, []).append([{"tag": t.tag, "position": t.position, "length": t.length} for t in r.tokens])
    return out


def compare(spark, texts, tokens, known, lookup):
    best = S.best_segments(S.realtime_segments(texts, tokens, known), tokens)
    want, shown = {}, {}
    for r in best.orderBy("clause_id", "idx").collect():
        want.setdefault(r.clause_id, []).append((r["loc"], r["len"], r.lookup_key, r.tag, r.is_convertible, r.preview))
    segs = best.groupBy("clause_id").agg(F.collect_list(F.struct("idx", "loc", "len", "preview")).alias("segs"))
    for r in texts.join(segs, "clause_id", "left").select("clause_id", F.coalesce(C.preview_text(F.col("text"), F.col("segs")), "text").alias("p")).collect():
        shown[r.clause_id] = r.p
    answers = as_tokens(tokens.collect())
    for clause_id, text in texts.collect():
        s = read(text, answers[clause_id], lookup)
        can = s.convertible(lookup)
        got = [(units(text[:a]), units(w), key_of(w), tag, i in can, s.unasked((a, w), lookup)) for i, (a, w, tag) in enumerate(s.tagged())]
        assert got == want.get(clause_id, []), text
        assert s.preview(lookup) == shown[clause_id]


def test_published_cases(spark):
    texts, tokens, known = fixtures._tokenizations(spark)
    compare(spark, texts, tokens, known, lookup_of(fixtures.KNOWN))


def test_random_tokenizations_against_the_batch_operators(spark):
    rng = random.Random(5)
    texts, tokens, known = [], [], []
    letters = "가나다라𠀀1,"
    for k in {"".join(rng.choice(letters[:4]) for _ in range(rng.randint(1, 2))) for _ in range(12)} | {"𠀀"}:
        known.append((k, f"<{k}>", rng.randint(0, 2), rng.randint(0, 2)))
    for i in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))
        texts.append((str(i), text))
        for rank in range(rng.randint(1, 4)):
            cuts = sorted({0, units(text), *(rng.randint(0, units(text)) for _ in range(3))})
            parts = [(a, z - a) for a, z in zip(cuts, cuts[1:])]
            tokens.append((str(i), rank, [("", rng.choice(("nng", "np", "jks", "vx")), a, n) for a, n in parts]))
    compare(spark, fixtures.clauses(spark, texts), spark.createDataFrame(tokens, fixtures.TOKENS), fixtures.lookups(spark, known), lookup_of(known))


KNOWN = Lookup({"가나": ["佳"], "가": ["家", "歌"], "나": ["我"]})
ONE, TWO = [[{"tag": "nng", "position": 0, "length": 2}]], [[{"tag": "np", "position": 0, "length": 1}, {"tag": "nng", "position": 1, "length": 1}]]


def test_an_answer_serves_its_clause_alone_and_survives_the_store():
    s = read("가나", TWO, KNOWN)
    assert s.preview(KNOWN) == "가我" and [w for _, w in s.segments(KNOWN)] == ["가", "나"]
    s = Session.load(s.dump())
    s.analyse(KNOWN)
    s.choose("歌", KNOWN)
    assert s.preview(KNOWN) == "歌我"  # asked for, a pronoun converts
    list(s.handle("key", "r", 0.0, KNOWN))
    assert s.tagged() is None and s.segments(KNOWN) == [(0, "가나")] and not s.locks
    s.forget()
    assert s.words is None
    s = read("가나", TWO, KNOWN)
    s.boundaries = [1]
    assert s.preview(KNOWN) == "家我"  # cuts by hand ask for no kind


def script(client, answers):
    rows = [key("a", P.CONTROL, ts=0.0), *[key(c, ts=1.0 + i) for i, c in enumerate("rkskrksk")], key("escape", ts=12.0), {"ts": 13.0, "source": "command", "command": "insertNewline:"}]
    return tuples(rows, client), [(client, seq, 1000.0 + ts, clause, toks) for seq, ts, clause, toks in answers]


def stream_input():
    """Three clients: answered at once, late and twice, and never."""
    long = [[{"tag": "nng", "position": 0, "length": 2}, {"tag": "np", "position": 2, "length": 2}]]
    a = script("a", [(4, 4.5, "가나", TWO), (8, 8.5, "가나가나", long)])
    b = script("b", [(8, 9.0, "가나가나", long), (4, 500.0, "가나", TWO), (2, 2.0, None, TWO), (3, 3.0, "간", None), (6, 6.5, "다른", ONE)])
    c = script("c", [])
    return a[0] + b[0] + c[0], a[1] + b[1] + c[1]


def test_batch_join_takes_answers_in_time(spark):
    rows, answers = stream_input()
    got = T.answered(spark.createDataFrame(rows, K.KEYS), spark.createDataFrame(answers + [("a", 8, 1009.5, "가나가나", ONE)], T.ANSWERS))
    assert got.count() == len(rows)
    found = {(r.client_id, r.seq): (r.clause, json.loads(r.tokens)) for r in got.where("tokens is not null").collect()}
    assert found.keys() == {("a", 4), ("a", 8), ("b", 8), ("b", 6)} and len(found["a", 8][1][0]) == 2
    out = {(r.client_id, r.text) for r in K.replay(got, KNOWN).where("kind = 'insert'").collect()}
    assert out == {("a", "佳가나"), ("b", "佳가나"), ("c", "佳佳")}


def test_stream_of_answers_equals_batch(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows, answers = stream_input()
        answers = [a for a in answers if a[2] < 1400]
        keys, read_ = spark.createDataFrame(rows, K.KEYS), spark.createDataFrame(answers, T.ANSWERS)
        flush = lambda ts: ([tuple(v if n != "ts" else ts for n, v in zip(K.FIELDS, tuples([key("q")], "z")[0], strict=True))], [("z", 99, ts, "", ONE)])
        parts = [(keys.where("ts < 1005"), read_.where("ts < 1005")), (keys.where("ts >= 1005"), read_.where("ts >= 1005"))]
        parts += [tuple(spark.createDataFrame(f, s) for f, s in zip(flush(ts), (K.KEYS, T.ANSWERS))) for ts in (1100.0, 1400.0, 1700.0)]
        for k, a in parts:
            k.coalesce(1).write.mode("append").parquet(str(tmp_path / "keys"))
            a.coalesce(1).write.mode("append").parquet(str(tmp_path / "answers"))
        stream = lambda df, name: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        q = K.run_read_stream(stream(keys, "keys"), stream(read_, "answers"), KNOWN, idle_ms=60_000).writeStream.format("memory").queryName("reads").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        got = spark.table("reads").where("client_id <> 'z'")
        assert sorted(r.client_id for r in got.where("kind = 'expired'").collect()) == ["a", "b", "c"]
        seen = lambda df: sorted(map(str, df.where("kind <> 'expired'").collect()))
        assert seen(got) == seen(K.replay(T.answered(keys, read_), KNOWN))
    finally:
        spark.conf.unset(provider)
