"""Queries over inline rows: published examples of each rule, with their expected rows as SQL."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import numerals as N
from ..functions import policy as Y
from ..functions.text import compose_jamo, drop_last_grapheme, graphemes, nfc_key, utf16_length, utf16_slice
from ..operators import candidates as C
from ..operators import clauses as K
from ..operators import paging as P
from ..operators import segments as S
from ..operators import targets as A
from ..operators import usage as U
from ..operators import userdict as D
from ..sources import stores as R
from ..streaming import ranges as H
from ..streaming import session as X
from .queries import ORACLE, QUERIES


def literal(x: Any) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, int | float):
        return str(x)
    return "'" + str(x).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SQL_TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}


def values(schema: str, rows: list[tuple]) -> str:
    """SQL of a table with these rows."""
    cols = [c.split() for c in schema.split(", ")]
    casts = ", ".join(f"CAST(c{i} AS {SQL_TYPES[t]}) AS {n}" for i, (n, t) in enumerate(cols))
    names = ", ".join(f"c{i}" for i in range(len(cols)))
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({names})"


def expects(schema: str, rows: list[tuple]):
    """Registers a query under its function's name, with the rows that it must return."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark)
        ORACLE[f.__name__] = values(schema, rows)
        return f

    return add


def seeds(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "case string, pos long, reading string, value string, comment string")


@expects(
    "case string, rn long, value string, source string, comment string, base_rank long",
    [
        ("user wins", 1, "漢字", "userDefined", "user-comment", 0), ("user wins", 2, "漢子", "system", "", 1),
        ("tie of usage", 1, "Alpha", "system", "", 0), ("tie of usage", 2, "Beta", "system", "", 1), ("tie of usage", 3, "Able", "system", "", 2), ("tie of usage", 4, "Zulu", "system", "", 3),
        ("user first", 1, "User", "userDefined", "", 0), ("user first", 2, "System", "system", "", 0),
        ("frequency", 1, "漢字", "system", "", 2), ("frequency", 2, "漢子", "system", "", 0), ("frequency", 3, "韓子", "system", "", 1),
        ("usage beats frequency", 1, "漢子", "system", "", 1), ("usage beats frequency", 2, "漢字", "system", "", 0),
        ("kept comment", 1, "v", "userDefined", "sys", 0), ("last duplicate", 1, "v", "system", "b", 1), ("comment chain", 1, "v", "userDefined", "a", 1),
        ("compatibility ideograph", 1, "樂", "userDefined", "own", 0),
    ],
)
def ranking_fixture(spark: SparkSession) -> DataFrame:
    """Merge and order of candidates; cases are kept apart by a reading of their own."""
    system = seeds(spark, [
        ("user wins", 0, "한자", "漢字", "system-comment"), ("user wins", 1, "한자", "漢子", ""),
        ("tie of usage", 0, "k", "Alpha", ""), ("tie of usage", 1, "k", "Beta", ""), ("tie of usage", 2, "k", "Able", ""), ("tie of usage", 3, "k", "Zulu", ""),
        ("user first", 0, "k", "System", ""), ("frequency", 0, "한자", "漢子", ""), ("frequency", 1, "한자", "韓子", ""), ("frequency", 2, "한자", "漢字", ""),
        ("usage beats frequency", 0, "한자", "漢字", ""), ("usage beats frequency", 1, "한자", "漢子", ""),
        ("kept comment", 0, "k", "v", "sys"), ("last duplicate", 0, "k", "v", "a"), ("last duplicate", 3, "k", "v", "b"),
        ("equals reading", 0, "k", "k", ""), ("no value", 0, "k", None, ""), ("compatibility ideograph", 0, "악", "樂", "sys"),
    ])
    user = seeds(spark, [
        ("user wins", 0, "한자", "漢字", "user-comment"), ("user first", 0, "k", "User", ""), ("kept comment", 0, "k", "v", ""),
        ("comment chain", 0, "k", "v", "a"), ("comment chain", 1, "k", "v", ""), ("compatibility ideograph", 0, "악", "\uf914", "own"),
    ])
    usage = spark.createDataFrame(
        [("user wins", "한자", "漢字", 5), ("user wins", "한자", "漢子", 5), ("tie of usage", "k", "Alpha", 5), ("tie of usage", "k", "Beta", 5), ("user first", "k", "System", 99), ("usage beats frequency", "한자", "漢子", 1)],
        "case string, lookup_key string, value string, count long",
    )
    # values that the frequency file knows, apart for the cases that ask for it
    freq = spark.createDataFrame([("frequency|漢字", 6009096), ("frequency|漢子", 5000099), ("frequency|韓子", 2000107), ("usage beats frequency|漢字", 6009096), ("usage beats frequency|漢子", 5000099)], "value string, freq long")
    apart = lambda df, *cs: df.select(*[F.concat("case", F.lit("|"), c).alias(c) if c in cs else F.col(c) for c in df.columns if c != "case"])
    found = C.ranked(apart(system, "reading", "value"), apart(user, "reading", "value"), apart(usage, "lookup_key", "value"), freq)
    tail = lambda c: F.regexp_extract(c, r"\|(.*)$", 1)
    return found.select(F.regexp_extract("reading", r"^([^|]*)", 1).alias("case"), "rn", nfc_key(tail(F.col("value"))).alias("value"), "source", "comment", "base_rank")


@expects("value string, freq long", [("한", 7), ("한", -2), ("a", 9), ("", 5)])
def frequency_line_parse(spark: SparkSession) -> DataFrame:
    bad = ["no colon", "x: 5", "x:5.7", "x:5\r", "x:", "x:99999999999999999999", "x:1:2"]
    return R.frequency(spark.createDataFrame([(x,) for x in ["한:7", "한:-2", "a:+9", ":5", *bad]], "value string"))


NUMERALS = {
    "123": ["百二十三", "一二三", "백이십삼"],
    "3015": ["三千十五", "三零一五", "三〇一五", "삼천십오"],
    "123456789": ["一二三四五六七八九", "一億二千三百四十五萬六千七百八十九", "1억2345만6789", "일억이천삼백사십오만육천칠백팔십구"],
    "123,456,789": ["一二三四五六七八九", "一億二千三百四十五萬六千七百八十九", "1억2345만6789", "일억이천삼백사십오만육천칠백팔십구"],
    "0012": ["零零一二", "〇〇一二", "영영일이"],
    "0": ["零", "〇", "영"],
    "1000": ["千", "一零零零", "一〇〇〇", "천"],
    "10000": ["一萬", "一零零零零", "一〇〇〇〇", "일만", "1만"],
    "111111111111111111111": ["一" * 21, "일" * 21],
}


@expects("key string, base_rank long, value string, comment string", [(k, i, v, "數字") for k, vs in NUMERALS.items() for i, v in enumerate(vs)])
def numeral_fixture(spark: SparkSession) -> DataFrame:
    keys = spark.createDataFrame([(k,) for k in [*NUMERALS, ",", "", "12a", "１２", None]], "key string")
    return N.numeral_candidates(keys).select("key", "base_rank", "value", "comment")


def clauses(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "clause_id string, text string")


def lookups(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(key, first candidate, its usage, usage of the key itself)."""
    return spark.createDataFrame([(k, 1, v, u, h) for k, v, u, h in rows], "key_k string, n_candidates long, top_value string, top_usage long, hangul_usage long")


KNOWN = [("한국", "韓國", 0, 0), ("동해", "東海", 0, 0), ("물", "物", 0, 0), ("백두산", "白頭山", 0, 0), ("통통", "通通", 1, 2)]
TOKENS = "clause_id string, result_rank int, tokens array<struct<form:string,tag:string,position:int,length:int>>"
G2 = [("동해", "nnp", 0, 2), ("물", "nng", 2, 1), ("과", "jc", 3, 1), ("백두산", "nnp", 5, 3), ("이", "jks", 8, 1)]
TAGGED = ("np", "ic", "vx", "xsv", "xsa", "xsn")


def _tokenizations(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    texts = [("G1", "한국은abc"), ("G2", "동해물과 백두산이"), ("G4", "한국 없는ㄱ"), ("G5", "한국123"), ("G6", "통통"), ("G9", "한국"), ("G10", "x,12,y"), ("astral", "𠀀한국"), *[(t, "한국") for t in TAGGED]]
    rows = [
        ("G1", 0, [("한국", "nnp", 0, 2), ("은", "jx", 2, 1), ("abc", "sl", 3, 3)]), ("G2", 0, [("동해물과 백두산이", "nnp", 0, 9)]), ("G2", 1, G2),
        ("G4", 0, [("한국", "nnp", 0, 2), ("없는", "va", 3, 2)]), ("G5", 0, [("한국", "nnp", 0, 2), ("123", "sn", 2, 3)]), ("G6", 0, [("통통", "nng", 0, 2)]),
        ("G9", 0, [("한국", "nnp", 0, 2)]), ("G9", 1, [("한국", "nng", 0, 2)]), ("G10", 0, []), ("astral", 0, [("한국", "nnp", 2, 2), ("?", "nng", 1, 1), ("!", "nng", 3, 9)]),
        *[(t, 0, [("한국", t, 0, 2)]) for t in TAGGED],
    ]
    return clauses(spark, texts), spark.createDataFrame(rows, TOKENS), lookups(spark, KNOWN)


@expects(
    "clause_id string, result_rank int, idx int, loc long, len long, surface string, lookup_key string, tag string, is_convertible boolean, preview string",
    [
        ("G1", 0, 0, 0, 2, "한국", "한국", "nnp", True, "韓國"),
        ("G2", 1, 0, 0, 2, "동해", "동해", "nnp", True, "東海"), ("G2", 1, 1, 2, 1, "물", "물", "nng", True, "物"), ("G2", 1, 2, 5, 3, "백두산", "백두산", "nnp", True, "白頭山"),
        ("G4", 0, 0, 0, 2, "한국", "한국", "nnp", True, "韓國"), ("G4", 0, 1, 3, 2, "없는", "없는", "va", False, None),
        ("G5", 0, 0, 0, 2, "한국", "한국", "nnp", True, "韓國"), ("G5", 0, 1, 2, 3, "123", "123", "sn", True, None),
        ("G6", 0, 0, 0, 2, "통통", "통통", "nng", True, None), ("G9", 0, 0, 0, 2, "한국", "한국", "nnp", True, "韓國"),
        ("G10", 0, 0, 1, 4, ",12,", "12", "sn", True, None), ("astral", 0, 0, 2, 2, "한국", "한국", "nnp", True, "韓國"),
        *[(t, 0, 0, 0, 2, "한국", "한국", t, True, None) for t in TAGGED],
    ],
)
def segmentation_fixture(spark: SparkSession) -> DataFrame:
    texts, tokens, known = _tokenizations(spark)
    found = S.best_segments(S.realtime_segments(texts, tokens, known), tokens)
    return found.select("clause_id", "result_rank", "idx", "loc", "len", "surface", "lookup_key", "tag", "is_convertible", "preview")


@expects("clause_id string, preview string", [("G1", "韓國은abc"), ("G2", "東海物과 白頭山이"), ("G4", "韓國 없는ㄱ"), ("G5", "韓國123"), ("G6", "통통"), ("G9", "韓國"), ("G10", "x,12,y"), ("astral", "𠀀韓國"), *[(t, "한국") for t in TAGGED]])
def preview_fixture(spark: SparkSession) -> DataFrame:
    texts, tokens, known = _tokenizations(spark)
    best = S.best_segments(S.realtime_segments(texts, tokens, known), tokens)
    segs = best.groupBy("clause_id").agg(F.collect_list(F.struct("idx", "loc", "len", "preview")).alias("segs"))
    return texts.join(segs, "clause_id").select("clause_id", K.preview_text(F.col("text"), F.col("segs")).alias("preview"))


@expects(
    "clause_id string, idx int, loc long, len long, surface string, tag string, is_convertible boolean, preview string",
    [
        ("G8", 0, 0, 2, "한국", "nng", True, "韓國"), ("G8", 1, 2, 2, "12", "sn", True, None), ("G8", 2, 4, 1, "3", "sn", True, None),
        ("wild", 0, 0, 1, "물", "nng", True, "物"), ("wild", 1, 1, 1, "가", "nng", False, None),
    ],
)
def manual_partition(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("G8", "한국123", [2, 4]), ("wild", "물가", [9, 1, 1, 0, -3]), ("none", "", [1])], "clause_id string, text string, boundaries array<int>")
    return S.manual_segments(rows, lookups(spark, KNOWN)).select("clause_id", "idx", "loc", "len", "surface", "tag", "is_convertible", "preview")


@expects(
    "case string, result string",
    [("seed", "2,3"), ("grow", "3"), ("shrink", "2"), ("last can't grow", "2"), ("one is least", "2,3"), ("last shrinks", "2,3"), ("merge", "3"), ("whole character", "4")],
)
def boundary_adjust(spark: SparkSession) -> DataFrame:
    w = "한국역사"
    rows = [("grow", w, [2], 0, 1), ("shrink", w, [3], 0, -1), ("last can't grow", w, [2], 2, 1), ("one is least", w, [2, 3], 3, -1), ("last shrinks", w, [2], 2, -1), ("merge", w, [2, 3], 0, 1), ("whole character", "한국𠀀사", [2], 0, 1)]
    df = spark.createDataFrame(rows, "case string, text string, b array<int>, focus long, step int")
    moved = F.when(F.col("step") > 0, K.moved_boundary(F.col("text"), F.col("b"), F.col("focus"), 1)).otherwise(K.moved_boundary(F.col("text"), F.col("b"), F.col("focus"), -1))
    seg = "array<struct<loc:bigint,len:bigint>>"
    seeded = spark.createDataFrame([("seed", "한국 역사", [(0, 2), (3, 2)])], f"case string, text string, s {seg}").select("case", K.seeded_boundaries(F.col("text"), F.col("s")).alias("r"))
    return df.select("case", moved.alias("r")).unionByName(seeded).select("case", F.array_join(F.col("r").cast("array<string>"), ",").alias("result"))


LOCK = "clause_id string, loc long, surface string, lookup_key string"


@expects("clause_id string, loc long, preview string, pending long", [("a", 0, "漢國", 1), ("a", 2, None, 1), ("a", 4, "物", 0)])
def lock_reconcile(spark: SparkSession) -> DataFrame:
    """Locks of segments that are gone (here b's) have no say; a Hangul lock beats a candidate's."""
    segs = spark.createDataFrame([("a", 0, "한국", "한국", "韓國"), ("a", 2, "동해", "동해", "東海"), ("a", 4, "물", "물", "物")], LOCK + ", preview string")
    locks = spark.createDataFrame([("a", 0, "한국", "한국", "hanja", "漢國"), ("a", 2, "동해", "동해", "hanja", "東海"), ("a", 2, "동해", "동해", "hangul", None), ("b", 9, "물", "물", "hanja", "勿")], LOCK + ", kind string, value string")
    pending = locks.where("value is not null")
    count = K.surviving(pending, segs).groupBy("clause_id", "loc").agg(F.count("*").alias("pending"))
    return K.reconciled(segs, locks).join(count, ["clause_id", "loc"], "left").select("clause_id", "loc", "preview", F.coalesce("pending", F.lit(0).cast("long")).alias("pending"))


@expects("case string, result int", [("kept", 1), ("gone", 0), ("focus", 1), ("focus gone", 0), ("not convertible", 0)])
def selection_kept(spark: SparkSession) -> DataFrame:
    segs = [(0, 0, "한국", "한국", True), (1, 2, "동해", "동해", True), (2, 4, "물", "물", False)]
    kind = "array<struct<idx:int,loc:bigint,surface:string,lookup_key:string,is_convertible:boolean>>"
    rows = [("kept", segs, None, False, (2, "동해", "동해")), ("gone", segs, None, False, (3, "동해", "동해")), ("focus", segs, 2, True, None), ("focus gone", segs, 7, True, None), ("not convertible", segs, None, False, (4, "물", "물"))]
    df = spark.createDataFrame(rows, f"case string, s {kind}, focus long, manual boolean, lock struct<loc:bigint,surface:string,lookup_key:string>")
    return df.select("case", K.kept_selection(F.col("s"), F.col("focus"), F.col("manual"), F.col("lock")).alias("result"))


@expects(
    "case string, text string, loc long, len long, anchor long",
    [("M1", "대한민국", 24, 4, 28), ("M2", "안녕", 0, 2, 2), ("M3a", "민국", 3, 2, 5), ("M3b", "대한민국", 2, 4, 6), ("M3c", "대한민국", 3, 4, 7), ("M4a", None, -1, -1, -1), ("M4b", None, -1, -1, -1),
     ("M5a", "한국 사람", 5, 5, 10), ("M5b", None, -1, -1, -1), ("M5c", None, -1, -1, -1), ("gap", None, -1, -1, -1)],
)
def manual_target(spark: SparkSession) -> DataFrame:
    n = lambda s: len(s)
    left = [("M1", "abc 대한민국", 20, 8, 28), *[(c, s, 0, n(s), n(s)) for c, s in (("M3a", "대한)민국"), ("M3b", "韓國대한민국"), ("M3c", "abc대한민국"), ("M4a", "대한민국)"), ("M4b", "대한민국韓"))], ("gap", "가", 0, 1, 3)]
    a = spark.createDataFrame(left, "case string, s string, l long, n long, c long").select("case", A.from_left_context(F.col("s"), F.col("l"), F.col("n"), F.col("c")).alias("t"))
    b = spark.createDataFrame([("M2", "안", 0, 1, "녕", 1, 1)], "case string, s string, l long, n long, m string, ml long, mn long")
    b = b.select("case", A.from_composition(*[F.col(c) for c in ("s", "l", "n", "m", "ml", "mn")]).alias("t"))
    c = spark.createDataFrame([("M5a", "한국 사람", 5, 5), ("M5b", "  ", 5, 2), ("M5c", "한국", None, 2)], "case string, s string, l long, n long").select("case", A.from_selection(F.col("s"), F.col("l"), F.col("n")).alias("t"))
    or_none = lambda k: F.coalesce(f"t.{k}", F.lit(-1).cast("long")).alias(k)
    return a.unionByName(b).unionByName(c).select("case", "t.text", or_none("loc"), or_none("len"), or_none("anchor"))


@expects("case string, result string", [("blocked", "blocked"), ("none", "no_target"), ("loading", "loading"), ("off", "unavailable"), ("go", "panel")])
def trigger_outcomes(spark: SparkSession) -> DataFrame:
    rows = [("blocked", True, "ready", "x"), ("none", False, "ready", None), ("loading", False, "loading", "x"), ("off", False, "unavailable", "x"), ("go", False, "ready", "x")]
    df = spark.createDataFrame(rows, "case string, rt boolean, st string, t string")
    return df.select("case", A.trigger_outcome(F.col("rt"), F.col("st"), F.col("t")).alias("result"))


@expects(
    "case string, typed string, step int, passes boolean, manual boolean, toggle boolean, candidate int",
    [("q", "Q", 0, False, False, False, -1), ("s", "s", 0, False, False, False, -1), ("code 18", "!", 0, False, False, False, 0), ("right", None, 1, False, False, False, -1),
     ("left", None, -1, False, False, False, -1), ("right only", None, 0, False, False, False, -1), ("return", None, 0, False, True, False, -1), ("ctrl a", "a", 0, True, False, True, -1), ("command", "c", 0, True, False, False, -1)],
)
def key_policy(spark: SparkSession) -> DataFrame:
    s, c, o, m = Y.SHIFT, Y.CONTROL, Y.OPTION, Y.COMMAND
    rows = [("q", "q", 12, s), ("s", "s", 1, s), ("code 18", None, 18, s), ("right", "", 124, s), ("left", "", 123, s), ("right only", "", 124, 0), ("return", "", 36, o), ("ctrl a", "A", 0, c), ("command", "c", 8, m)]
    df = spark.createDataFrame(rows, "case string, ch string, code int, mods int")
    ch, code, mods = F.col("ch"), F.col("code"), F.col("mods")
    shift_free = Y.typed_character(ch, code, mods)
    return df.select("case", shift_free.alias("typed"), F.coalesce(Y.boundary_step(code, mods), F.lit(0)).alias("step"), Y.passes_through(mods).alias("passes"), Y.is_manual_trigger(code, mods).alias("manual"), F.coalesce(Y.is_realtime_toggle(ch, mods), F.lit(False)).alias("toggle"), F.coalesce(Y.candidate_index(code), F.lit(-1)).alias("candidate"))


COMMITS, STAYS = ".?!;\n\raZm", "059,: 한ㄱ漢"


@expects("code int, commits boolean", [(ord(x), True) for x in COMMITS] + [(ord(x), False) for x in STAYS])
def autocommit_policy(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(ord(x), x) for x in COMMITS + STAYS], "code int, ch string")
    return df.select("code", Y.commits_clause(F.col("ch")).alias("commits"))


@expects("command string, navigation boolean, newline boolean", [("moveLeft:", True, False), ("moveToEndOfLine:", True, False), ("pageUp:", True, False), ("insertNewline:", False, True), ("insertTab:", False, False), ("insertLineBreak:", False, True)])
def command_policy(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(x,) for x in ("moveLeft:", "moveToEndOfLine:", "pageUp:", "insertNewline:", "insertTab:", "insertLineBreak:")], "command string")
    return df.select("command", Y.is_navigation(F.col("command")).alias("navigation"), Y.is_newline_command(F.col("command")).alias("newline"))


@expects("case string, x double, y double", [("below", 100.0, 376.0), ("above", 100.0, 42.0), ("right edge", 1234.0, 376.0), ("no room", 6.0, 6.0)])
def panel_origin(spark: SparkSession) -> DataFrame:
    kind = "struct<x:double,y:double,w:double,h:double>"
    screen = (0.0, 0.0, 1440.0, 900.0)
    rows = [("below", (100.0, 500.0, 0.0, 18.0), (200.0, 120.0), screen), ("above", (100.0, 20.0, 0.0, 18.0), (200.0, 120.0), screen), ("right edge", (1430.0, 500.0, 0.0, 18.0), (200.0, 120.0), screen), ("no room", (-50.0, 50.0, 0.0, 18.0), (200.0, 120.0), (0.0, 0.0, 100.0, 100.0))]
    df = spark.createDataFrame(rows, f"case string, a {kind}, p struct<w:double,h:double>, s {kind}")
    return df.select("case", G.panel_origin(F.col("a"), F.col("p"), F.col("s")).alias("o")).select("case", "o.x", "o.y")


@expects("case string, valid boolean, first_y double, width double", [("fine", True, 500.0, 176.0), ("flat", False, 510.0, 560.0), ("off screen", False, None, 300.0)])
def anchor_validity(spark: SparkSession) -> DataFrame:
    kind = "struct<x:double,y:double,w:double,h:double>"
    screens = [(0.0, 0.0, 1440.0, 900.0)]
    good, flat, off = (100.0, 500.0, 0.0, 18.0), (100.0, 500.0, 0.0, 0.5), (5000.0, 500.0, 0.0, 18.0)
    rows = [("fine", good, [good], screens, 10.0), ("flat", flat, [off, flat, (100.0, 510.0, 0.0, 18.0)], screens, 900.0), ("off screen", off, [off] * 9 + [good], screens, 300.0)]
    df = spark.createDataFrame(rows, f"case string, r {kind}, probes array<{kind}>, s array<{kind}>, w double")
    return df.select("case", G.valid_anchor(F.col("r"), F.col("s")).alias("valid"), G.first_valid(F.col("probes"), F.col("s"))["y"].alias("first_y"), G.row_width(F.col("w")).alias("width"))


@expects(
    "case string, size long, highlight long, page long, row9 long, row10 long",
    [("start", 9, 0, 0, 9, -1), ("page wins", 9, 9, 1, 9, -1), ("clamped", 1, 11, 11, 9, -1), ("empty", 9, 0, 0, -1, -1)],
)
def panel_state(spark: SparkSession) -> DataFrame:
    """A panel's start and what number keys pick: of twelve candidates number 1 on page 2 exists, number 4 doesn't."""
    df = spark.createDataFrame([("start", 0, 0, 12, 9), ("page wins", 2, 1, 12, 9), ("clamped", 99, 99, 12, 0), ("empty", 5, 5, 0, 9)], "case string, h long, p long, n long, s long")
    one = F.lit(1).cast("long")
    return df.select("case", P.initial(F.col("h"), F.col("p"), F.col("n"), F.col("s")).alias("i"), F.coalesce(P.row_at(one, F.lit(0), F.col("n")), -one).alias("row9"), F.coalesce(P.row_at(one, F.lit(3), F.col("n")), -one).alias("row10")).select("case", "i.size", "i.highlight", "i.page", "row9", "row10")


@expects("case string, units long, nfc string, jamo string, last_dropped string, characters int, slice string", [
    ("astral", 3, "𠀀한", "𠀀한", "𠀀", 2, "한"), ("decomposed", 3, "한", "한", "", 1, None), ("compatibility", 1, "樂", "樂", "", 1, None), ("lone jamo", 2, "ᄀa", "ㄱa", "ᄀ", 2, None),
])
def text_rules(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([("astral", "𠀀한"), ("decomposed", "\u1112\u1161\u11ab"), ("compatibility", "\uf914"), ("lone jamo", "ᄀa")], "case string, s string")
    s = F.col("s")
    two, one = F.lit(2).cast("long"), F.lit(1).cast("long")
    return df.select("case", utf16_length(s).alias("units"), nfc_key(s).alias("nfc"), compose_jamo(s).alias("jamo"), drop_last_grapheme(s).alias("last_dropped"), F.size(graphemes(s)).alias("characters"), F.when(F.col("case") == "astral", utf16_slice(s, two, one)).alias("slice"))


@expects("lookup_key string, value string, count long, last long", [("한자", "漢字", 4, 2000), ("b", "x", 1, 9)])
def usage_merge_fixture(spark: SparkSession) -> DataFrame:
    """The last selection by processing order, not by clock."""
    old = spark.createDataFrame([("한자", "漢字", 2, 3000)], "lookup_key string, value string, count long, last_selected_at long")
    events = spark.createDataFrame([(1, "한자", "漢字", 5000), (2, "한자", "漢字", 2000), (3, "", "漢字", 1), (4, "b", "x", 9), (5, "b", "", 1)], "seq long, lookup_key string, value string, ts long")
    return U.merged_usage(old, events).withColumnRenamed("last_selected_at", "last")


@expects("reading string, value string, comment string, id string, created_at long, updated_at long", [("한자", "漢字", "second", "id1", 1000, 2000), ("새", "新", "c", "id3", 7, 7)])
def userdict_edits(spark: SparkSession) -> DataFrame:
    cols = "id string, reading string, value string, comment string, created_at long, updated_at long"
    old = spark.createDataFrame([("id1", "한자", "漢字", "first", 1000, 1000), ("id2", "옛", "古", "", 5, 5)], cols)
    saves = spark.createDataFrame([("id9", "한자", "漢字", "second", 2000, 2000, 1, "save"), ("id8", "", "x", "", 1, 1, 2, "save"), ("", "없", "無", "", 1, 1, 3, "delete")], cols + ", seq long, op string")
    edit = spark.createDataFrame([("id3", "옛", "古", "새", "新", "c", 7, 7, 5)], "id string, old_reading string, old_value string, reading string, value string, comment string, created_at long, updated_at long, seq long")
    return D.applied(old, saves.unionByName(D.renames(edit)))


EVENT_ROWS = [
    ("T1", "toggle", ""), *[("T1", "key", k) for k in "gksrnr"], ("T1", "select", "漢國"), ("T1", "commit", ""),
    ("T2", "toggle", ""), *[("T2", "key", k) for k in "gksrnr"], ("T2", "commit", ""),
    ("T3", "toggle", ""), *[("T3", "key", k) for k in "gksrnr"], ("T3", "select", "漢國"), ("T3", "cancel", ""), ("T3", "commit", ""),
    ("T4", "toggle", ""), *[("T4", "key", k) for k in "gksrnr"], ("T4", "select", "漢國"), ("T4", "select", "韓國"), ("T4", "commit", ""), ("T4", "commit", ""),
    ("T5", "toggle", ""), *[("T5", "key", k) for k in "gksrnr"], ("T5", "select", "漢國"), ("T5", "hangul", ""), ("T5", "commit", ""),
    ("T6", "toggle", ""), *[("T6", "key", k) for k in "gksrnr"], ("T6", "select", "漢國"), ("T6", "backspace", ""), ("T6", "commit", ""),
    ("T13", "key", "g"), ("T13", "key", "k"), ("T13", "key", "s"), ("T13", "key", "r"), ("T13", "commit", ""),
]
SESSION_LOOKUP = {"한국": ["韓國", "漢國"]}


def session_events(spark: SparkSession) -> DataFrame:
    """Events of some clients, and of two with time limits: an arming is used up once, a suppression holds."""
    rows = [(c, i, float(i), a, t) for i, (c, a, t) in enumerate(EVENT_ROWS)]
    timed = [("T9", 10.0, "arm"), ("T9", 10.25, "newline"), ("T9", 10.5, "newline"), ("T10", 5.0, "arm"), ("T10", 6.5, "newline"), ("T11", 10.0, "suppress"), ("T11", 10.25, "newline"), ("T11", 10.3, "newline"), ("T12", 5.0, "suppress"), ("T12", 5.75, "newline")]
    rows += [(c, 1000 + i, t, a, "") for i, (c, t, a) in enumerate(timed)]
    return spark.createDataFrame(rows, X.EVENTS)


@expects(
    "client_id string, kind string, text string, value string",
    [("T1", "insert", "漢國", None), ("T1", "usage", "한국", "漢國"), ("T2", "insert", "韓國", None), ("T4", "insert", "韓國", None), ("T4", "usage", "한국", "韓國"), ("T5", "insert", "한국", None), ("T5", "usage", "한국", "한국"),
     ("T6", "insert", "한구", None), ("T13", "insert", "한", None), ("T13", "insert", "ㄱ", None),
     ("T9", "trigger", "", None), ("T9", "insert", "\n", None), ("T10", "insert", "\n", None), ("T11", "suppressed", "", None), ("T11", "suppressed", "", None), ("T12", "insert", "\n", None)],
)
def session_state_machine(spark: SparkSession) -> DataFrame:
    return X.run_batch(session_events(spark), SESSION_LOOKUP).where("kind not in ('mark', 'mode', 'selected')").select("client_id", "kind", "text", "value")


@expects(
    "client_id string, mode string, loc long, len long",
    [("begin", "initial-selection", 4, 2), ("begin twice", "initial-selection", 4, 2), ("marked", "client-marked", 3, 1), ("lost", "implicit", -1, -1), ("inserted", "initial-selection", 7, 0), ("cleared", "initial-selection", 8, 0), ("finished", "none", -1, -1), ("unknown place", "implicit", -1, -1)],
)
def range_states(spark: SparkSession) -> DataFrame:
    rows = [
        ("begin", 0, "begin", 4, 2, 0), ("begin twice", 0, "begin", 4, 2, 0), ("begin twice", 1, "begin", 9, 9, 0), ("marked", 0, "sync", 3, 1, 0), ("lost", 0, "sync", 3, 1, 0), ("lost", 1, "sync", None, 0, 0),
        ("inserted", 0, "insert", 5, 1, 2), ("cleared", 0, "sync", 8, 2, 0), ("cleared", 1, "clear", None, None, 0), ("finished", 0, "begin", 1, 0, 0), ("finished", 1, "finish", None, None, 0), ("unknown place", 0, "insert", None, 0, 2),
    ]
    got = H.range_states(spark.createDataFrame(rows, "client_id string, seq long, kind string, loc long, len long, text_len long"))
    none = F.lit(-1).cast("long")
    return got.select("client_id", "mode", F.coalesce("loc", none).alias("loc"), F.coalesce("len", none).alias("len"))


@expects("case string, ranges string, moved boolean", [("all", "9+0,3+2,1+4", True), ("repeats", "9+0", False), ("nothing marked", "9+0,1+4", False)])
def anchor_range_order(spark: SparkSession) -> DataFrame:
    kind = "struct<loc:bigint,len:bigint>"
    rows = [("all", (9, 0), (3, 2), (1, 4), (9, 0), (5, 2)), ("repeats", (9, 0), (9, 0), (9, 0), (9, 0), (9, 0)), ("nothing marked", (9, 0), (3, 0), (1, 4), (None, 0), (3, 0))]
    df = spark.createDataFrame(rows, f"case string, a {kind}, m {kind}, r {kind}, s {kind}, h {kind}")
    shown = F.array_join(F.transform(H.anchor_ranges(*[F.col(c) for c in "amrs"]), lambda r: F.concat_ws("+", r["loc"].cast("string"), r["len"].cast("string"))), ",")
    moved = H.host_moved(F.lit(True), F.lit("x"), F.col("m.loc"), F.col("m.len"), F.col("h.loc"), F.col("h.len"))
    return df.select("case", shown.alias("ranges"), moved.alias("moved"))
