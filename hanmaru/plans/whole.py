"""Rules of segments, locks, keys, targets, panels and stores over the driver's whole tables, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import policy as P
from ..functions import text as X
from ..operators import clauses as K
from ..operators import paging
from ..operators import segments as S
from ..operators import targets as A
from ..operators import usage as U
from ..operators import userdict as D
from ..sources import stores, versions
from ..streaming import ranges as H
from . import tables as T
from .queries import SPANS, query

#: Tokenizations of every turn: the fourth is one more than counts.
PATTERNS = [r"[^\x20\x09-\x0D]+", "[A-Za-z]+", "[A-Za-z0-9,]+", "[a-z]+"]
TAGS = ["nng", "nnp", "np", "jx", "vv", "xsn"]


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("clause_id"), "text")


def _tokenizations(turns: DataFrame) -> DataFrame:
    out = None
    for rank, pattern in enumerate(PATTERNS):
        tag = lambda s: F.array(*map(F.lit, TAGS))[(s["loc"] % len(TAGS)).cast("int")]
        token = lambda s: F.struct(s["surface"].alias("form"), tag(s).alias("tag"), s["loc"].cast("int").alias("position"), s["len"].cast("int").alias("length"))
        one = turns.select("clause_id", F.lit(rank).alias("result_rank"), F.transform(S.numeric_spans(F.col("text"), pattern), token).alias("tokens"))
        out = one if out is None else out.unionByName(one)
    return out


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark as a lookup; how often they occur and how long they are stand for usage."""
    words = T.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("key_k"))
    return words.groupBy("key_k").agg(F.count("*").alias("n_candidates")).select("key_k", "n_candidates", F.upper("key_k").alias("top_value"), (F.col("n_candidates") % 5).alias("top_usage"), (F.length("key_k") % 4).cast("long").alias("hangul_usage"))


def _spans_sql(name: str, rank: int, pattern: str) -> str:
    return f"""{name} AS (SELECT id, {rank} AS result_rank, i - 1 AS pos, m[i] AS surface, CAST(len(m[i]) AS BIGINT) AS len,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS loc
  FROM (SELECT id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM t) WHERE len(m) > 0))"""


SEGMENTS = f"""t AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations),
{", ".join(_spans_sql(f"k{r}", r, p) for r, p in enumerate(PATTERNS[:3]))}, {_spans_sql("num", 0, "[0-9,]*[0-9][0-9,]*")},
w AS (SELECT key_k, count(*) AS n, upper(key_k) AS top_value, count(*) % 5 AS top_usage, length(key_k) % 4 AS own FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS key_k FROM benchmark) GROUP BY key_k),
k AS (SELECT *, {TAGS}[CAST(loc % 6 AS INT) + 1] AS tag FROM (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2)),
a AS (SELECT k.*, CASE WHEN regexp_full_match(surface, '[0-9,]*[0-9][0-9,]*') THEN replace(surface, ',', '') ELSE surface END AS lookup_key FROM k
  WHERE tag IN ('nng', 'nnp', 'np', 'vv', 'xsn') AND NOT EXISTS (SELECT 1 FROM num WHERE num.id = k.id AND num.loc < k.loc + k.len AND k.loc < num.loc + num.len)),
b AS (SELECT id, result_rank, pos, loc, len, surface, lookup_key, tag, coalesce(n, 0) > 0 AS conv,
    CASE WHEN NOT (own > 0 AND own >= coalesce(top_usage, 0)) AND tag NOT IN ('np', 'xsn') THEN top_value END AS preview FROM a LEFT JOIN w ON lookup_key = key_k
  UNION ALL SELECT num.id, r, NULL, loc, len, surface, replace(surface, ',', ''), 'sn', true, NULL FROM num, (VALUES (0), (1), (2)) q(r)),
s AS (SELECT b.*, row_number() OVER (PARTITION BY b.id, result_rank ORDER BY CASE WHEN x.id IS NULL THEN pos ELSE loc END, CASE WHEN x.id IS NOT NULL THEN -len END, pos) - 1 AS idx FROM b LEFT JOIN (SELECT DISTINCT id FROM num) x ON b.id = x.id)"""


@query(f"WITH {SEGMENTS} SELECT id AS clause_id, result_rank, CAST(idx AS INT) AS idx, loc, len, surface, lookup_key, tag, conv AS is_convertible, preview FROM s")
def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of three tokenizations of every turn."""
    turns = _turns(spark, sf_dir)
    return S.realtime_segments(turns, _tokenizations(turns), _known(spark, sf_dir))


@query(f"""WITH {SEGMENTS}, r AS (SELECT t.id, q.r AS result_rank FROM t, (VALUES (0), (1), (2)) q(r)),
c AS (SELECT r.id, r.result_rank, coalesce(sum(CASE WHEN conv THEN len END), 0) AS cover FROM r LEFT JOIN s ON r.id = s.id AND r.result_rank = s.result_rank GROUP BY ALL),
d AS (SELECT id, result_rank FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY cover DESC, result_rank) = 1)
SELECT s.id AS clause_id, s.result_rank, CAST(idx AS INT) AS idx, loc, len, surface, conv AS is_convertible, preview FROM s JOIN d ON s.id = d.id AND s.result_rank = d.result_rank""")
def turn_best_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each turn's best tokenization."""
    turns = _turns(spark, sf_dir)
    tokens = _tokenizations(turns)
    return S.best_segments(S.realtime_segments(turns, tokens, _known(spark, sf_dir)), tokens).select("clause_id", "result_rank", "idx", "loc", "len", "surface", "is_convertible", "preview")


@query(f"""WITH {SEGMENTS},
e AS (SELECT id, text, list_sort(list_distinct(list_filter([0, 5, 3, 12, 40, length(text)], lambda p: p <= length(text)))) AS e FROM t WHERE text <> ''),
c AS (SELECT id, text, e[i] AS loc, e[i + 1] - e[i] AS len, substr(text, e[i] + 1, e[i + 1] - e[i]) AS surface FROM (SELECT *, unnest(range(1, len(e))) AS i FROM e)),
n AS (SELECT *, regexp_full_match(surface, '[0-9,]*[0-9][0-9,]*') AS number FROM c)
SELECT n.id AS clause_id, CAST(row_number() OVER (PARTITION BY n.id ORDER BY loc) - 1 AS INT) AS idx, CAST(loc AS BIGINT) AS loc, CAST(len AS BIGINT) AS len, surface, CASE WHEN number THEN replace(surface, ',', '') ELSE surface END AS lookup_key,
  CASE WHEN number THEN 'sn' ELSE 'nng' END AS tag, number OR coalesce(w.n, 0) > 0 AS is_convertible, CASE WHEN NOT number THEN top_value END AS preview
FROM n LEFT JOIN w ON key_k = CASE WHEN number THEN replace(surface, ',', '') ELSE surface END""")
def manual_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn cut by hand at the same places, some of them beyond its ends or named twice."""
    cut = F.array(*map(F.lit, (5, 3, 12, 5, 0, -2, 40, 10_000_000)))
    return S.manual_segments(_turns(spark, sf_dir).withColumn("boundaries", cut), _known(spark, sf_dir))


def _numbers() -> Column:
    """A document's numeric spans as segments, those of more than four characters convertible."""
    one = lambda s, i: F.struct(i.cast("int").alias("idx"), s["loc"].alias("loc"), s["len"].alias("len"), s["surface"].alias("surface"), S.lookup_key(s["surface"]).alias("lookup_key"), (s["len"] > 4).alias("is_convertible"))
    return F.transform(S.numeric_spans(F.col("text")), one)


@query(f"""WITH {SPANS},
l AS (SELECT doc_id, loc, len FROM sp),
p AS (SELECT d.doc_id, length(text) AS n, coalesce((SELECT list_sort(list_distinct(list(x))) FROM (SELECT unnest([loc, loc + len]) AS x FROM l WHERE l.doc_id = d.doc_id) WHERE x > 0 AND x < length(text)), []) AS b FROM documents d),
e AS (SELECT doc_id, n, b, [CAST(0 AS BIGINT)] || b || [CAST(n AS BIGINT)] AS e FROM p WHERE n > 0 AND len(b) > 0)
SELECT doc_id, array_to_string(b, ',') AS seeded,
  array_to_string(CASE WHEN e[2] + 1 = e[3] THEN b[2:] ELSE list_sort([e[2] + 1] || b[2:]) END, ',') AS grown,
  array_to_string(CASE WHEN e[2] - 1 > 0 THEN list_sort([e[2] - 1] || b[2:]) ELSE b END, ',') AS shrunk,
  array_to_string(CASE WHEN n - 1 > b[-1] THEN b || [CAST(n - 1 AS BIGINT)] ELSE b END, ',') AS last_shrunk FROM e""")
def boundary_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of every document's numbers, and after the first span grew, shrank, and the last one shrank by a character."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text", _numbers().alias("s")).withColumn("b", K.seeded_boundaries(F.col("text"), F.col("s"))).where("size(b) > 0")
    text, b, start = F.col("text"), F.col("b"), F.lit(0).cast("long")
    joined = lambda c, name: F.array_join(c.cast("array<string>"), ",").alias(name)
    return docs.select("doc_id", joined(b, "seeded"), joined(K.moved_boundary(text, b, start, 1), "grown"), joined(K.moved_boundary(text, b, start, -1), "shrunk"), joined(K.moved_boundary(text, b, F.element_at(b, -1), -1), "last_shrunk"))


@query(f"""WITH {SPANS},
s AS (SELECT doc_id, loc, surface, replace(surface, ',', '') AS k, '#' AS preview FROM sp),
h AS (SELECT doc_id, loc, max(loc % 5 = 0) AS hangul, max(CASE WHEN loc % 3 = 0 THEN 'L' || surface END) AS locked FROM s WHERE loc % 15 IN (0, 3, 5, 6, 9, 10, 12) GROUP BY ALL)
SELECT s.doc_id AS clause_id, s.loc, CASE WHEN coalesce(hangul, false) THEN NULL ELSE coalesce(locked, preview) END AS preview, CAST(CASE WHEN s.loc % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS pending
FROM s LEFT JOIN h ON s.doc_id = h.doc_id AND s.loc = h.loc""")
def lock_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of every document under locks: at each third place a candidate's, at each fifth the text's own, and some of segments that are gone."""
    flat = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clause_id"), F.explode(_numbers()).alias("s")).select("clause_id", "s.loc", "s.surface", "s.lookup_key")
    key = ["clause_id", "loc", "surface", "lookup_key"]
    hanja = flat.where("loc % 3 = 0").select(*key, F.lit("hanja").alias("kind"), F.concat(F.lit("L"), "surface").alias("value"))
    own = flat.where("loc % 5 = 0").select(*key, F.lit("hangul").alias("kind"), F.lit(None).cast("string").alias("value"))
    gone = hanja.withColumn("surface", F.concat("surface", F.lit("x")))
    segs = flat.withColumn("preview", F.lit("#"))
    kept = K.surviving(hanja.unionByName(gone), segs).groupBy("clause_id", "loc").agg(F.count("*").alias("pending"))
    return K.reconciled(segs, hanja.unionByName(own).unionByName(gone)).join(kept, ["clause_id", "loc"], "left").select("clause_id", "loc", "preview", F.coalesce("pending", F.lit(0).cast("long")).alias("pending"))


@query(f"""WITH {SPANS}, g AS (SELECT doc_id, list(struct_pack(i := idx, l := loc, c := len > 4) ORDER BY idx) AS s FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY loc) - 1 AS INT) AS idx FROM sp) GROUP BY doc_id),
d AS (SELECT *, list_min(list_transform(list_filter(s, lambda x: x.c), lambda x: x.i)) AS first_ FROM g)
SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 > 0 AND len(s) > 1 THEN 1 ELSE first_ END WHEN doc_id % 3 > 0 AND len(s) > 2 AND s[3].c THEN 2 ELSE first_ END, -1) AS kept FROM d""")
def selection_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays selected: on even documents the second segment had the focus by hand, on others the third was selected; on every third it's gone."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", _numbers().alias("s")).where("size(s) > 0")
    third, there = F.get("s", F.lit(2)), F.col("doc_id") % 3 > 0
    lock = F.struct(third["loc"].alias("loc"), F.when(there, third["surface"]).otherwise("gone").alias("surface"), third["lookup_key"].alias("lookup_key"))
    kept = K.kept_selection(F.col("s"), F.when(there, F.get("s", F.lit(1))["loc"]).otherwise(-5), F.col("doc_id") % 2 == 0, lock)
    return docs.select("doc_id", F.coalesce(kept, F.lit(-1)).alias("kept"))


#: Letters of the texts that stand for Hangul.
LATIN, HANGUL = "abcdefghij", "가나다ㄱㅏᄀ라마바사"


@query(f"""SELECT doc_id, CAST(len(regexp_extract_all(t, '[가-힣ㄱ-ㆎᄀ-ᇿ]')) AS BIGINT) AS hangul, CAST(len(regexp_extract_all(t, '[ -~]')) AS BIGINT) AS printable,
  CAST(len(regexp_extract_all(t, '[.?!;\\n\\rA-Za-z]')) AS BIGINT) AS ends, CAST(len(regexp_extract_all(t, '[\\n\\r]')) AS BIGINT) AS newlines, replace(t[1:1], '`', '₩') AS first_, regexp_extract(t, '[가-힣ㄱ-ㆎᄀ-ᇿ]*$') AS tail,
  md5(translate(nfc_normalize(translate(text, 'abc', '각')), '각', 'ㄱㅏㄱ')) AS composed, CAST(greatest(length(text) - 1, 0) AS BIGINT) AS shorter
FROM (SELECT doc_id, text, translate(text, '{LATIN}', '{HANGUL}') AS t FROM documents)""")
def character_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of every text by class, its Hangul tail, its jamo composed, and its length without the last character."""
    docs = T.table(spark, sf_dir, "documents").withColumn("t", F.translate("text", LATIN, HANGUL))
    count = lambda chars, name: X.count_of(F.col("t"), chars).alias(name)
    jamo = X.compose_jamo(F.translate("text", "abc", "각"))
    return docs.select(
        "doc_id", X.hangul_count(F.col("t")).alias("hangul"), count(P.PRINTABLE, "printable"), count(P.CLAUSE_ENDS, "ends"), count(P.NEWLINES, "newlines"),
        P.shown_character(F.substring("t", 1, 1)).alias("first_"), X.hangul_tail(F.col("t")).alias("tail"), F.md5(jamo).alias("composed"), X.utf16_length(X.drop_last_grapheme(F.col("text"))).alias("shorter"),
    )


KEYED = "CAST(json_extract_string(props, '$.k') AS INT)"
MODS = [0, P.SHIFT, P.OPTION, P.CONTROL, P.SHIFT | P.COMMAND, P.OPTION | 1]
CODES = [36, 76, 123, 124, 0, 18]
COMMANDS = ["insertNewline:", "pageUp:", "moveLeft:", "moveLeftAndModifySelection:", "insertLineBreak:", "pageUpAndModifySelection:", "cancelOperation:", "moveToEndOfLine:"]
CHARS = ["a", "Q", "z", "1", "é", ""]


@query(f"""WITH e AS (SELECT event_id, {KEYED} AS k, {MODS}[CAST(event_id % 6 AS INT) + 1] AS m, {CODES}[CAST(event_id % 5 % 6 AS INT) + 1] AS code, CASE WHEN event_id % 7 < 6 THEN {CHARS}[CAST(event_id % 7 AS INT) + 1] END AS c, {COMMANDS}[CAST(event_id % 8 AS INT) + 1] AS w FROM events),
x AS (SELECT *, (m // {P.SHIFT}) % 2 = 1 AS shift, element_at(MAP {{{", ".join(f"{k}: '{v.replace(chr(39), chr(39) * 2)}'" for k, v in P.ANSI_KEYS.items())}}}, k)[1] AS printed FROM e),
y AS (SELECT *, CASE WHEN c BETWEEN ' ' AND '~' AND c <> '' AND c <> 'é' THEN lower(c) ELSE printed END AS base FROM x)
SELECT event_id, coalesce(code IN (36, 76) AND m // 2 * 2 = {P.OPTION}, false) AS trigger, coalesce(lower(c) = 'a' AND m = {P.CONTROL}, false) AS toggle, m IN ({P.CONTROL}, {P.SHIFT | P.COMMAND}) AS away,
  CASE WHEN NOT shift OR base IS NULL THEN base WHEN base IN ('q', 'w', 'e', 'r', 't', 'o', 'p') THEN upper(base) WHEN base BETWEEN 'a' AND 'z' THEN base ELSE translate(base, '1234567890-=[]\\;'',./`', '!@#$%^&*()_+{{}}|:"<>?~') END AS typed,
  CASE WHEN m = {P.SHIFT} AND code = 124 THEN 1 WHEN m = {P.SHIFT} AND code = 123 THEN -1 ELSE 0 END AS step, coalesce(element_at(MAP {{{", ".join(f"{k}: {v}" for k, v in P.CANDIDATE_KEYS.items())}}}, k)[1], -1) AS number,
  w IN ('pageUp:', 'moveLeft:', 'moveLeftAndModifySelection:', 'moveToEndOfLine:') AS navigation, w IN ('insertNewline:', 'insertLineBreak:') AS newline FROM y""")
def key_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every event is as a key, a character or a command."""
    n = F.col("event_id")
    at = lambda values, i: F.array(*map(F.lit, values))[i.cast("int")]
    e = T.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), at(MODS, n % 6).cast("long").alias("m"), at(CODES, n % 5).alias("code"), F.when(n % 7 < 6, F.get(F.array(*map(F.lit, CHARS)), (n % 7).cast("int"))).alias("c"), at(COMMANDS, n % 8).alias("w"))
    m, c, false = F.col("m"), F.col("c"), F.lit(False)
    return e.select(
        "event_id", P.is_manual_trigger(F.col("code"), m).alias("trigger"), F.coalesce(P.is_realtime_toggle(c, m), false).alias("toggle"), P.passes_through(m).alias("away"), P.typed_character(c, F.col("k"), m).alias("typed"),
        F.coalesce(P.boundary_step(F.col("code"), m), F.lit(0)).alias("step"), F.coalesce(P.candidate_index(F.col("k")), F.lit(-1)).alias("number"), P.is_navigation(F.col("w")).alias("navigation"), P.is_newline_command(F.col("w")).alias("newline"),
    )


@query(f"""WITH d AS (SELECT doc_id, translate(text, '{LATIN}', '{HANGUL}') AS t, length(text) AS n FROM documents WHERE text IS NOT NULL),
x AS (SELECT *, regexp_extract(t, '[가-힣ㄱ-ㆎᄀ-ᇿ]+$') AS tail, regexp_extract(t || '가', '[가-힣ㄱ-ㆎᄀ-ᇿ]+$') AS joint FROM d),
r AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 8 = 0 THEN joint END WHEN 1 THEN CASE WHEN n > 0 AND regexp_matches(t, '[^\\s]') THEN t END WHEN 2 THEN nullif(tail, '') END AS target,
  CASE doc_id % 4 WHEN 0 THEN n + 1 WHEN 1 THEN n ELSE n END AS ends FROM x)
SELECT doc_id, md5(target) AS target, CASE WHEN target IS NOT NULL THEN CAST(ends - length(target) AS BIGINT) ELSE -1 END AS loc, CAST(coalesce(length(target), -1) AS BIGINT) AS len,
  CASE WHEN doc_id % 5 = 0 THEN 'blocked' WHEN target IS NULL THEN 'no_target' WHEN doc_id % 3 = 1 THEN 'loading' WHEN doc_id % 3 = 2 THEN 'unavailable' ELSE 'panel' END AS outcome FROM r""")
def conversion_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a conversion would be about in every document: composed text behind it, all of it selected, or what stands left of a
    caret at its end; and what a trigger leads to. Ranges disagree on every eighth and fourth."""
    docs = T.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.translate("text", LATIN, HANGUL).alias("t"))
    n, t, k = X.utf16_length(F.col("t")), F.col("t"), F.col("doc_id") % 4
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    composed = A.from_composition(t, zero, n, F.lit("가"), F.when(F.col("doc_id") % 8 == 0, n).otherwise(n + 1), F.lit(1).cast("long"))
    target = A.chosen(F.when(k == 0, composed), F.when(k == 1, A.from_selection(t, zero, n)), F.when(k == 2, A.from_left_context(t, zero, n, n)))
    status = F.when(F.col("doc_id") % 3 == 1, "loading").when(F.col("doc_id") % 3 == 2, "unavailable").otherwise("ready")
    found = docs.select("doc_id", target.alias("g"), status.alias("status"))
    return found.select("doc_id", F.md5("g.text").alias("target"), F.coalesce("g.loc", none).alias("loc"), F.coalesce("g.len", none).alias("len"), A.trigger_outcome(F.col("doc_id") % 5 == 0, F.col("status"), F.col("g")).alias("outcome"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) % 40 - 5 AS h, CAST(l_suppkey AS BIGINT) % 7 - 1 AS p, CAST(l_quantity AS BIGINT) AS n, l_linenumber % 3 * 5 - 1 AS z FROM lineitem),
s AS (SELECT *, greatest(z, 1) AS s FROM l), c AS (SELECT *, least(greatest(p, 0), greatest((n + s - 1) // s - 1, 0)) AS page, least(greatest(h, 0), greatest(n - 1, 0)) AS hl FROM s)
SELECT l_orderkey, l_linenumber, CAST(s AS BIGINT) AS size, CAST(CASE WHEN n = 0 OR hl // s = page THEN hl ELSE page * s END AS BIGINT) AS highlight, CAST(page AS BIGINT) AS page,
  CAST(CASE WHEN h BETWEEN 0 AND 8 AND page * 9 + h < n THEN page * 9 + h ELSE -1 END AS BIGINT) AS row FROM c""")
def panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of as many candidates as each order line has pieces: their start brought into range, and the row that a number picks."""
    l = T.table(spark, sf_dir, "lineitem")  # noqa: E741
    h, p, n = F.col("l_partkey").cast("long") % 40 - 5, F.col("l_suppkey").cast("long") % 7 - 1, F.col("l_quantity").cast("long")
    start = paging.initial(h, p, n, F.col("l_linenumber") % 3 * 5 - 1)
    return l.select("l_orderkey", "l_linenumber", start.alias("s"), h.alias("h"), n.alias("n")).select("l_orderkey", "l_linenumber", "s.size", "s.highlight", "s.page", F.coalesce(paging.row_at(F.col("s.page"), F.col("h"), F.col("n")), F.lit(-1).cast("long")).alias("row"))


RECTS = """r AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 1500 AS DOUBLE) AS x, CAST(l_suppkey % 900 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS w, CAST(l_linenumber % 4 * 8 AS DOUBLE) AS h, CAST(l_quantity AS DOUBLE) * 6 AS pw, CAST(l_linenumber AS DOUBLE) * 90 AS ph FROM lineitem)"""


@query(f"""WITH {RECTS}, o AS (SELECT *, y - 4.0 - ph AS below, y + h + 4.0 AS above FROM r),
q AS (SELECT *, CASE WHEN below >= 6.0 THEN below WHEN above + ph <= 794.0 THEN above WHEN greatest(y - 10.0, 0.0) >= greatest(794.0 - above, 0.0) THEN below ELSE above END AS py FROM o)
SELECT l_orderkey, l_linenumber, least(greatest(x + w, 6.0), greatest(6.0, 1434.0 - pw)) AS px, least(greatest(py, 6.0), greatest(6.0, 794.0 - ph)) AS py,
  h >= 1 AND x + w / 2 < 1440 AND y + h / 2 < 800 AS valid, CAST(CASE WHEN h >= 1 AND x + w / 2 < 1440 AND y + h / 2 < 800 THEN 0 WHEN x + w / 2 + 1 < 1441 AND y + 0.5 < 800 THEN 1 ELSE -1 END AS INT) AS probe, greatest(176.0, least(560.0, pw)) AS width FROM q""")
def panel_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels beside the place of every order line on a screen of 1440 by 800, whether that place is valid, and the first valid one of two."""
    d = lambda c: c.cast("double")
    rect = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    x, y, w, h = d(F.col("l_partkey") % 1500), d(F.col("l_suppkey") % 900), d(F.col("l_quantity")), d(F.col("l_linenumber") % 4 * 8)
    screen = rect(F.lit(0.0), F.lit(0.0), F.lit(1440.0), F.lit(800.0))
    rows = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rect(x, y, w, h).alias("a"), rect(x, y, w, F.lit(1.0)).alias("b"), F.struct((w * 6).alias("w"), (d(F.col("l_linenumber")) * 90).alias("h")).alias("p"))
    screens = F.array(screen)
    first = G.first_valid(F.array("a", "b"), screens)
    origin = G.panel_origin(F.col("a"), F.col("p"), screen)
    probe = F.when(first.isNull(), -1).when(G.valid_anchor(F.col("a"), screens), 0).otherwise(1)
    return rows.select("l_orderkey", "l_linenumber", origin["x"].alias("px"), origin["y"].alias("py"), G.valid_anchor(F.col("a"), screens).alias("valid"), probe.alias("probe"), G.row_width(F.col("p.w")).alias("width"))


@query(f"""WITH e AS (SELECT event_id, {KEYED} AS k, event_id % 10 AS j FROM events),
r AS (SELECT event_id, k, j, [CASE WHEN k % 3 > 0 THEN k || '+0' END, CASE WHEN j % 4 > 0 THEN j || '+' || (j % 4) END, CASE WHEN k % 2 = 0 THEN j || '+' || (j % 4) ELSE k || '+0' END, '3+1'] AS a FROM e)
SELECT event_id, array_to_string(list_transform(list_filter(range(1, 5), lambda i: a[i] IS NOT NULL AND list_position(a, a[i]) = i), lambda i: a[i]), ',') AS ranges, k % 5 > 0 AND j <> 0 AND k % 3 > 0 AND (k <> j OR k % 4 <> j % 4) AS moved FROM r""")
def anchor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges to try as an anchor at every event, and whether the host moved the marked text."""
    e = T.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("event_id") % 10).alias("j"))
    k, j = F.col("k"), F.col("j")
    place = lambda loc, size: F.struct(loc.cast("long").alias("loc"), size.cast("long").alias("len"))
    found = H.anchor_ranges(place(F.when(k % 3 > 0, k), F.lit(0)), place(j, j % 4), place(F.when(k % 2 == 0, j).otherwise(k), F.when(k % 2 == 0, j % 4).otherwise(0)), place(F.lit(3), F.lit(1)))
    moved = H.host_moved(k % 5 > 0, F.when(j == 0, "").otherwise("x"), F.when(k % 3 > 0, k), k % 4, j, j % 4)
    return e.select("event_id", F.array_join(F.transform(found, lambda r: F.concat_ws("+", r["loc"].cast("string"), r["len"].cast("string"))), ",").alias("ranges"), moved.alias("moved"))


@query("""WITH b AS (SELECT 'u' || p_partkey AS id, p_brand AS reading, p_name AS value, CAST(p_partkey AS BIGINT) AS at_, p_partkey FROM part),
e AS (SELECT id, reading, CASE WHEN p_partkey % 3 = 0 THEN value || '*' WHEN p_partkey % 7 = 0 THEN '' ELSE value END AS value, reading AS old_reading, value AS old_value, CAST(p_partkey + 1 AS BIGINT) AS seq, at_ FROM b WHERE p_partkey % 2 = 0),
c AS (SELECT id, reading, value, at_, -1 AS seq, 'save' AS op FROM b QUALIFY row_number() OVER (PARTITION BY reading, value ORDER BY p_partkey) = 1
  UNION ALL SELECT id, old_reading, old_value, at_, seq * 2, 'delete' FROM e WHERE value <> old_value UNION ALL SELECT id, reading, value, at_ + 1, seq * 2 + 1, 'save' FROM e WHERE value <> ''),
x AS (SELECT *, max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY reading, value) AS gone FROM c)
SELECT arg_min(id, seq) AS id, reading, value, arg_min(at_, seq) AS created_at, arg_max(at_, seq) AS updated_at FROM x WHERE op = 'save' AND seq > coalesce(gone, -2) GROUP BY reading, value""")
def userdict_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries, of which every second was edited: some renamed, some left without a value."""
    p, at = T.table(spark, sf_dir, "part"), F.col("p_partkey").cast("long")
    base = [F.concat(F.lit("u"), at.cast("string")).alias("id"), F.col("p_brand").alias("reading"), F.col("p_name").alias("value"), F.lit("").alias("comment"), at.alias("created_at"), at.alias("updated_at")]
    old = p.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("p_partkey")).select(*base)
    edits = p.where("p_partkey % 2 = 0").select(*base, F.col("p_brand").alias("old_reading"), F.col("p_name").alias("old_value"), (at + 1).alias("seq"), F.when(at % 3 == 0, F.concat("p_name", F.lit("*"))).when(at % 7 == 0, "").otherwise(F.col("p_name")).alias("new"))
    edits = edits.withColumn("value", F.col("new")).drop("new").withColumn("created_at", F.col("updated_at") + 1).withColumn("updated_at", F.col("updated_at") + 1)
    return D.applied(old, D.renames(edits)).select("id", "reading", "value", "created_at", "updated_at")


@query("""SELECT lookup_key, value, count, strftime(last_selected_at, '%Y-%m-%d %H:%M:%S') AS last_selected_at FROM (
  SELECT event_type AS lookup_key, json_extract_string(props, '$.k') AS value, count(*) AS count, arg_max(ts, event_id) AS last_selected_at FROM events WHERE length(json_extract_string(props, '$.k')) > 0 GROUP BY 1, 2)""")
def usage_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of all events written as a store's document, replaced once, and loaded again."""
    path = f"{versions.shared_folder(spark)}/store-{uuid.uuid4().hex}"
    document = stores.usage_document(U.upserted(T.events(spark, sf_dir)))
    stores.save(document.where("false").unionByName(stores.usage_document(U.upserted(T.events(spark, sf_dir).where("false")))), path)
    stores.save(document, path)
    return stores.load_usage(spark, f"{path}/document.json").select("lookup_key", "value", "count", F.date_format("last_selected_at", "yyyy-MM-dd HH:mm:ss").alias("last_selected_at"))


@query("""SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, 'e' || p_partkey AS id, p_brand AS reading, p_name AS value, p_type AS comment FROM part""")
def user_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a user dictionary, written as a store's document and loaded again in its order."""
    path, at = f"{versions.shared_folder(spark)}/store-{uuid.uuid4().hex}", F.lit("2024-01-01 00:00:00").cast("timestamp")
    p = T.table(spark, sf_dir, "part")
    stores.save(stores.user_document(p.select(F.col("p_partkey").alias("pos"), F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("reading"), F.col("p_name").alias("value"), F.col("p_type").alias("comment"), at.alias("created_at"), at.alias("updated_at"))), path)
    return stores.load_user_entries(spark, f"{path}/document.json").select("pos", "id", "reading", "value", "comment")


@query("""SELECT p_name AS value, CAST(p_partkey AS BIGINT) AS freq FROM part WHERE p_partkey % 5 > 1""")
def frequency_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a frequency file, written and loaded; of every five one has no colon and one no number."""
    path = f"{versions.shared_folder(spark)}/frequency-{uuid.uuid4().hex}"
    key = F.col("p_partkey").cast("string")
    line = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).when(F.col("p_partkey") % 5 == 1, F.concat("p_name", F.lit(": "), key)).otherwise(F.concat("p_name", F.lit(":"), key))
    T.table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return stores.load_frequency(spark, [path, f"{path}-none"])


@query("""SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS nth, p_brand AS reading, p_name AS value, p_type AS comment FROM part""")
def dictionary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a dictionary file, written in order and loaded with their places."""
    from pyspark.sql import Window

    path = f"{versions.shared_folder(spark)}/dictionary-{uuid.uuid4().hex}"
    T.table(spark, sf_dir, "part").orderBy("p_partkey").select(F.concat_ws("\t", "p_brand", "p_name", "p_type").alias("value")).write.text(path)
    loaded = stores.load_dictionary(spark, path)
    return loaded.select((F.row_number().over(Window.orderBy("pos")) - 1).cast("long").alias("nth"), "reading", "value", "comment")


@query("""WITH RECURSIVE b AS (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM benchmark), c AS (SELECT DISTINCT w FROM b),
x AS (SELECT substr(w, i, n) AS form FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM b), (VALUES (2), (3)) q(n) WHERE i + n - 1 <= length(w) AND (i = 1 OR i + n - 1 = length(w))),
d AS (SELECT form, CASE WHEN length(form) = 2 THEN 'nng' ELSE 'nnp' END AS tag, 100 - least(99, count(*)) AS cost FROM x GROUP BY form),
e AS (SELECT form, tag, cost, length(form) AS n FROM d),
p AS (
  SELECT w, 0 AS pos, CAST(0 AS BIGINT) AS cost, '' AS name FROM c
  UNION ALL
  SELECT * FROM (
    SELECT w, pos + n AS pos, cost + more AS cost, CASE WHEN name = '' THEN '' ELSE name || '|' END || form || '/' || tag AS name FROM (
      SELECT p.*, e.n, e.cost AS more, e.form, e.tag FROM p JOIN e ON e.form = substr(p.w, p.pos + 1, e.n) AND p.pos + e.n <= length(p.w)
      UNION ALL SELECT p.*, 1, 1000, substr(p.w, p.pos + 1, 1), 'un' FROM p WHERE pos < length(w)))
  WHERE cost < 1000 * (length(w) // 2 + 2))
SELECT w AS clause, CAST(row_number() OVER (PARTITION BY w ORDER BY cost, name) - 1 AS INT) AS result_rank, -CAST(cost AS DOUBLE) AS score, name AS path FROM p WHERE pos = length(w)
QUALIFY row_number() OVER (PARTITION BY w ORDER BY cost, name) <= 3""")
def lattice_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three cheapest ways to put every word of the benchmark together from the beginnings and ends of all its words."""
    from ..operators import lattice

    words = T.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("w"))
    at = lambda n: F.array(F.when(F.length("w") >= n, F.substring("w", 1, n)), F.when(F.length("w") > n, F.expr(f"right(w, {n})")))
    pieces = words.select(F.explode(F.concat(at(2), at(3))).alias("form")).where("form is not null")
    known = pieces.groupBy("form").agg((100 - F.least(F.lit(99), F.count("*"))).alias("cost")).select("form", F.when(F.length("form") == 2, "nng").otherwise("nnp").alias("tag"), "cost")
    clauses = words.distinct().select(F.col("w").alias("clause_id"), F.col("w").alias("text"))
    path = F.array_join(F.transform("tokens", lambda t: F.concat(t["form"], F.lit("/"), t["tag"])), "|")
    return lattice.tokenizations(clauses, known).select(F.col("clause_id").alias("clause"), "result_rank", "score", path.alias("path"))
