"""Registered queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numerals as N
from ..functions.text import nfc_key, utf16_length
from ..operators import candidates as C
from ..operators import clauses as K
from ..operators import paging as P
from ..operators import segments as S
from ..operators import usage as U
from ..operators import userdict as D
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Merge and rank in SQL.
RANKED = """
s AS (SELECT p_partkey AS pos, p_brand AS reading, p_name AS value, p_type AS comment, false AS is_user,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS base_rank FROM part),
u AS (SELECT p_partkey AS pos, p_brand AS reading, p_name AS value, CASE WHEN p_type = 'PROMO' THEN '' ELSE 'own ' || p_type END AS comment, true AS is_user,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS base_rank FROM part WHERE p_size = 1),
m AS (SELECT reading, value, bool_or(is_user) AS is_user,
    coalesce(arg_max(comment, pos) FILTER (WHERE is_user AND comment <> ''), arg_max(comment, pos) FILTER (WHERE NOT is_user), '') AS comment,
    coalesce(arg_max(base_rank, pos) FILTER (WHERE is_user), arg_max(base_rank, pos) FILTER (WHERE NOT is_user)) AS base_rank
  FROM (SELECT * FROM s UNION ALL SELECT * FROM u) GROUP BY reading, value),
g AS (SELECT p_brand AS reading, p_name AS value, count(*) AS usage_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
f AS (SELECT p_name AS value, max(p_size) AS frequency FROM part GROUP BY 1),
r AS (SELECT m.reading, m.value, m.comment, CASE WHEN is_user THEN 'userDefined' ELSE 'system' END AS source,
    CAST(coalesce(usage_count, 0) AS BIGINT) AS usage_count, CAST(coalesce(frequency, 0) AS BIGINT) AS frequency, CAST(base_rank AS BIGINT) AS base_rank,
    row_number() OVER (PARTITION BY m.reading ORDER BY is_user DESC, coalesce(usage_count, 0) DESC, coalesce(frequency, 0) DESC, base_rank, m.value) AS rn
  FROM m LEFT JOIN g ON m.reading = g.reading AND m.value = g.value LEFT JOIN f ON m.value = f.value WHERE m.value <> m.reading)"""
REQ = "q AS (SELECT DISTINCT p_brand AS key, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS request_id FROM part)"


@query(f"WITH {RANKED}, {REQ} SELECT q.request_id, q.key, r.* FROM q JOIN r ON q.key = r.reading")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exact_candidates(T.requests(spark, sf_dir), T.ranked(spark, sf_dir))


@query(f"""WITH {RANKED}, {REQ}, n AS (SELECT reading, count(*) AS n FROM r GROUP BY 1)
SELECT request_id, rn, value, CAST((rn - 1) // 9 AS BIGINT) AS page, CAST((rn - 1) % 9 + 1 AS BIGINT) AS label, CAST((n + 8) // 9 AS BIGINT) AS pages
FROM q JOIN r ON q.key = r.reading JOIN n ON n.reading = r.reading""")
def candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.exact_candidates(T.requests(spark, sf_dir), T.ranked(spark, sf_dir))
    size = found.groupBy("request_id").agg(F.count("*").alias("n"))
    return found.join(size, "request_id").select("request_id", "rn", "value", P.page_of(F.col("rn")).alias("page"), P.label_of(F.col("rn")).alias("label"), P.page_count(F.col("n")).alias("pages"))


@query(f"""WITH {RANKED}, {REQ},
h AS (SELECT p_brand AS key, CAST(floor(count(*) / 40) AS BIGINT) AS own FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1)
SELECT request_id, q.key, coalesce(own, 0) AS hangul_usage, t.value AS top_value, t.usage_count AS top_usage,
  (SELECT count(*) FROM r WHERE r.reading = q.key) AS n_candidates, coalesce(own, 0) > 0 AND coalesce(own, 0) >= coalesce(t.usage_count, 0) AS prefer_hangul
FROM q LEFT JOIN h ON q.key = h.key LEFT JOIN r t ON t.reading = q.key AND t.rn = 1""")
def top_candidate_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.preference(T.requests(spark, sf_dir), T.ranked(spark, sf_dir), T.own_usage(spark, sf_dir))


@query("SELECT p_name AS value, CAST(max(p_size) AS BIGINT) AS freq FROM part GROUP BY 1")
def frequency_max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.max_frequency(T.frequency(spark, sf_dir)).withColumnRenamed("value_k", "value")


@query(f"""WITH {RANKED}, {REQ},
k AS (SELECT request_id, key || '7' AS key FROM q),
x AS (SELECT request_id, key, unnest(range(1, length(key) + 1)) AS n FROM k)
SELECT request_id, x.key, r.reading, value, comment, source, usage_count, frequency, base_rank,
  row_number() OVER (PARTITION BY request_id ORDER BY n DESC, rn) AS prn
FROM x JOIN r ON r.reading = substr(x.key, 1, n)""")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    longer = T.requests(spark, sf_dir).select("request_id", F.concat("key", F.lit("7")).alias("key"))
    return C.prefix_candidates(longer, T.ranked(spark, sf_dir))


#: Readings of digit strings in SQL: a four-digit group, then groups with their names.
NUMERAL_MACROS = """
g AS (SELECT id, d, n, i, substr(lpad(d, n * 4, '0'), CAST(i * 4 + 1 AS INT), 4) AS g FROM (
    SELECT id, d, n, unnest(range(0, n)) AS i FROM (SELECT id, d, CAST(ceil(length(d) / 4.0) AS INT) AS n FROM d WHERE length(d) <= 20))),
h AS (SELECT id, d, n, i, g,
    [substr(g, 1, 1), substr(g, 2, 1), substr(g, 3, 1), substr(g, 4, 1)] AS c,
    ['', '萬', '億', '兆', '京'] AS hn, ['', '만', '억', '조', '경'] AS kn FROM g),
e AS (SELECT id, d, n, i, g, hn[n - i] AS hu, kn[n - i] AS ku,
    array_to_string([CASE WHEN c[k] = '0' THEN '' WHEN c[k] = '1' AND k < 4 THEN ['千', '百', '十'][k] ELSE translate(c[k], '123456789', '一二三四五六七八九') || ['千', '百', '十', ''][k] END FOR k IN [1, 2, 3, 4]], '') AS hs,
    array_to_string([CASE WHEN c[k] = '0' THEN '' WHEN c[k] = '1' AND k < 4 THEN ['천', '백', '십'][k] ELSE translate(c[k], '123456789', '일이삼사오육칠팔구') || ['천', '백', '십', ''][k] END FOR k IN [1, 2, 3, 4]], '') AS ks FROM h),
q AS (SELECT id, string_agg(CASE WHEN g = '0000' THEN '' ELSE hs || hu END, '' ORDER BY i) AS hq, string_agg(CASE WHEN g = '0000' THEN '' ELSE ks || ku END, '' ORDER BY i) AS kq,
    string_agg(CASE WHEN g = '0000' THEN '' ELSE CAST(CAST(g AS INT) AS VARCHAR) || ku END, '' ORDER BY i) AS gq, max(n) AS n FROM e GROUP BY id),
l AS (SELECT d.id, d.d, translate(d, '0123456789', '零一二三四五六七八九') AS z, CASE WHEN contains(d, '0') THEN translate(d, '0123456789', '〇一二三四五六七八九') END AS c0,
    translate(d, '0123456789', '영일이삼사오육칠팔구') AS k, CASE WHEN regexp_matches(d, '^0+$') THEN '零' ELSE hq END AS hq, CASE WHEN regexp_matches(d, '^0+$') THEN '영' ELSE kq END AS kq,
    CASE WHEN q.n BETWEEN 2 AND 5 AND NOT regexp_matches(d, '^0+$') THEN gq END AS gq,
    length(d) > 20 OR (length(d) > 1 AND d[1] = '0') AS unitless, length(ltrim(d, '0')) >= 9 AS large FROM d LEFT JOIN q ON d.id = q.id),
o AS (SELECT id, d, list_filter(CASE WHEN unitless THEN [z, c0, k] WHEN large THEN [z, hq, c0, gq, kq] ELSE [hq, z, c0, kq, gq] END, lambda x: x IS NOT NULL) AS v FROM l),
p AS (SELECT id, d, v[i] AS value, i FROM (SELECT id, d, v, unnest(range(1, len(v) + 1)) AS i FROM o)),
t AS (SELECT id, d, value, min(i) AS i FROM p GROUP BY id, d, value)
SELECT id, d AS reading, value, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS base_rank FROM t"""


def _readings(keys: DataFrame) -> DataFrame:
    return N.numeral_candidates(keys).select("id", "reading", "value", "base_rank")


@query("WITH d AS (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS d FROM orders)," + NUMERAL_MACROS)
def numeral_readings_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readings(T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("key")))


@query("WITH d AS (SELECT o_orderkey AS id, CAST((o_orderkey + 1) * 7654321012 AS VARCHAR) AS d FROM orders)," + NUMERAL_MACROS)
def numeral_readings_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders")
    return _readings(o.select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") + 1) * F.lit(7654321012)).cast("string").alias("key")))


@query("WITH d AS (SELECT o_orderkey AS id, '00' || CAST(o_orderkey AS VARCHAR) AS d FROM orders)," + NUMERAL_MACROS)
def numeral_readings_leading_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readings(T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("00"), F.col("o_orderkey").cast("string")).alias("key")))


SPANS = r"""
n AS (SELECT doc_id, regexp_extract_all(text, '[0-9,]*[0-9][0-9,]*') AS m, string_split_regex(text, '[0-9,]*[0-9][0-9,]*') AS g FROM documents),
sp AS (SELECT doc_id, m[i] AS surface, CAST(len(m[i]) AS BIGINT) AS len,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS loc
  FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM n WHERE len(m) > 0))"""


@query(f"WITH {SPANS} SELECT doc_id, loc, len, surface, replace(surface, ',', '') AS lookup_key FROM sp")
def numeric_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(S.numeric_spans(F.col("text"))).alias("s"))
    return spans.select("doc_id", "s.loc", "s.len", "s.surface", S.lookup_key(F.col("s.surface")).alias("lookup_key"))


TOKENS = r"""
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]*[0-9,][^\x20\x09-\x0D]*') AS m, string_split_regex(text, '[^\x20\x09-\x0D]*[0-9,][^\x20\x09-\x0D]*') AS g FROM documents),
tk AS (SELECT doc_id, m[i] AS surface, CAST(len(m[i]) AS BIGINT) AS len,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS loc
  FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM w WHERE len(m) > 0))"""


@query(f"""WITH {SPANS}, {TOKENS},
a AS (SELECT tk.* FROM tk ANTI JOIN sp ON tk.doc_id = sp.doc_id AND tk.loc < sp.loc + sp.len AND sp.loc < tk.loc + tk.len),
b AS (SELECT doc_id, loc, len, surface, 'word' AS kind FROM a UNION ALL SELECT doc_id, loc, len, surface, 'number' FROM sp)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loc, len DESC) - 1 AS idx FROM b""")
def token_overlap_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with a digit or comma give way to the numeric spans that they touch; the others stand beside them."""
    docs = T.table(spark, sf_dir, "documents")
    flat = lambda spans: docs.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.loc", "s.len", "s.surface")
    spans = flat(S.numeric_spans(F.col("text")))
    words = flat(S.numeric_spans(F.col("text"), r"[^\x20\x09-\x0D]*[0-9,][^\x20\x09-\x0D]*"))
    both = S.without_overlaps(words, spans, "doc_id").withColumn("kind", F.lit("word")).unionByName(spans.withColumn("kind", F.lit("number")))
    order = Window.partitionBy("doc_id").orderBy("loc", F.desc("len"))
    return both.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))


@query(r"""WITH t AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations),
z AS (SELECT id, 0 AS result_rank, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t UNION ALL SELECT id, 1, regexp_extract_all(text, '[A-Za-z]+') FROM t),
x AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark),
c AS (SELECT id, result_rank, CAST(coalesce(sum(CASE WHEN word IS NULL THEN 0 ELSE length(tok) END), 0) AS BIGINT) AS cover FROM (SELECT id, result_rank, unnest(w) AS tok FROM z) LEFT JOIN x ON tok = word GROUP BY 1, 2),
e AS (SELECT z.id, z.result_rank, coalesce(cover, 0) AS cover FROM z LEFT JOIN c ON z.id = c.id AND z.result_rank = c.result_rank)
SELECT id, CAST(arg_max(result_rank, cover * 10 - result_rank) AS INT) AS result_rank, max(cover) AS cover FROM e GROUP BY id""")
def best_tokenization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two tokenizations of every turn the one whose words in the benchmark's vocabulary are longest in sum."""
    t = T.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("clause_id"), "text")
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    both = t.select("clause_id", F.lit(0).alias("result_rank"), words.alias("w")).unionByName(t.select("clause_id", F.lit(1).alias("result_rank"), F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")))
    known = T.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("surface")).distinct().withColumn("is_convertible", F.lit(True))
    flat = both.select("clause_id", "result_rank", F.explode("w").alias("surface")).join(known, "surface", "left")
    segs = flat.select("clause_id", "result_rank", "surface", F.coalesce("is_convertible", F.lit(False)).alias("is_convertible"), utf16_length(F.col("surface")).alias("len"))
    tokenizations = both.select("clause_id", "result_rank")
    cover = segs.groupBy("clause_id", "result_rank").agg(F.sum(F.when(F.col("is_convertible"), F.col("len")).otherwise(0)).alias("cover"))
    every = tokenizations.join(cover, ["clause_id", "result_rank"], "left").withColumn("cover", F.coalesce("cover", F.lit(0).cast("long")))
    return every.groupBy(F.col("clause_id").alias("id")).agg(F.max_by("result_rank", F.struct("cover", -F.col("result_rank"))).alias("result_rank"), F.max("cover").alias("cover"))


@query(r"SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS preview, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS n FROM documents")
def preview_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of digits shows as one mark: each is a segment whose preview is spliced into its text."""
    segs = F.transform(S.numeric_spans(F.col("text"), "[0-9]+"), lambda s, i: F.struct(i.cast("int").alias("idx"), s["loc"], s["len"], F.lit("#").alias("preview")))
    return T.table(spark, sf_dir, "documents").select("doc_id", "text", segs.alias("segs")).select("doc_id", K.preview_text(F.col("text"), F.col("segs")).alias("preview"), F.size("segs").cast("long").alias("n"))


@query(r"""WITH n AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS m, string_split_regex(text, '[0-9]+') AS g FROM documents)
SELECT doc_id, CAST(i - 1 AS INT) AS idx, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + 2 * (i - 1) AS BIGINT) AS loc, CAST(2 AS BIGINT) AS len
FROM (SELECT doc_id, g, unnest(range(1, len(m) + 1)) AS i FROM n WHERE len(m) > 0)""")
def display_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each run of digits stands once all show as two marks."""
    segs = F.transform(S.numeric_spans(F.col("text"), "[0-9]+"), lambda s, i: F.struct(i.cast("int").alias("idx"), s["loc"], s["len"], F.lit("##").alias("preview")))
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text", segs.alias("segs")).where(F.size("segs") > 0)
    return docs.select("doc_id", F.explode(K.display_places(F.col("text"), F.col("segs"))).alias("p")).select("doc_id", "p.idx", "p.loc", "p.len")


@query(r"""WITH n AS (SELECT doc_id, regexp_extract_all(text, '[0-9,]*[0-9][0-9,]*') AS m FROM documents),
c AS (SELECT doc_id, list_filter(range(0, len(m)), lambda i: length(m[i + 1]) > 4) AS k FROM n WHERE len(m) > 0)
SELECT doc_id, CAST(coalesce(list_min(k), -1) AS INT) AS first_idx,
  CAST(coalesce(list_min(list_filter(k, lambda i: i > list_min(k))), list_min(k), -1) AS INT) AS next_idx,
  CAST(coalesce(list_max(k), -1) AS INT) AS wrapped_back FROM c""")
def segment_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric spans of more than four characters are convertible: the first, the next one, and back round from the first."""
    segs = F.transform(S.numeric_spans(F.col("text")), lambda s, i: F.struct(i.cast("int").alias("idx"), s["loc"], s["len"], (s["len"] > 4).alias("is_convertible")))
    docs = T.table(spark, sf_dir, "documents").select("doc_id", segs.alias("s")).where(F.size("s") > 0).withColumn("first_idx", K.default_selection(F.col("s")))
    first = F.col("first_idx")
    none = F.lit(-1)
    ahead, back = K.moved_selection(F.col("s"), first, 1, False), K.moved_selection(F.col("s"), first, -1, True)
    return docs.select("doc_id", F.coalesce(first, none).alias("first_idx"), F.coalesce(ahead, none).alias("next_idx"), F.coalesce(back, none).alias("wrapped_back"))


@query("""SELECT event_type AS lookup_key, json_extract_string(props, '$.k') AS value, count(*) AS count, arg_max(ts, event_id) AS last_selected_at
FROM events WHERE length(event_type) > 0 AND length(json_extract_string(props, '$.k')) > 0 GROUP BY 1, 2""")
def usage_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.upserted(T.events(spark, sf_dir))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id AS client_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, sid""")
def usage_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes after six quiet hours of a client: events here lie hours apart."""
    return U.debounced(T.events(spark, sf_dir), "client_id", "6 hours")


TTL = """WITH a AS (SELECT event_id, user_id, ts, event_type,
    last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS armed_seq, last_value(CASE WHEN event_type = 'signup' THEN ts END IGNORE NULLS) OVER w AS armed_ts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, row_number() OVER (PARTITION BY user_id, armed_seq ORDER BY event_id) AS nth FROM a WHERE event_type = 'view')
SELECT user_id AS client_id, event_id AS seq, armed_seq FROM v WHERE armed_seq IS NOT NULL AND ts <= armed_ts + INTERVAL 8 HOUR"""


@query(TTL + " AND nth = 1")
def ttl_match_consume_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views within eight hours of a signup; the first view uses the signup up."""
    return U.within_limit(T.events(spark, sf_dir), F.col("slot") == "signup", F.col("slot") == "view", 8 * 3600, True)


@query(TTL)
def ttl_match_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views within eight hours of a signup, each of them."""
    return U.within_limit(T.events(spark, sf_dir), F.col("slot") == "signup", F.col("slot") == "view", 8 * 3600, False)


@query("""WITH e AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'commit' WHEN event_type = 'error' THEN 'cancel' ELSE 'select' END AS kind FROM events),
n AS (SELECT *, first_value(CASE WHEN kind <> 'select' THEN event_id END IGNORE NULLS) OVER w AS commit_seq, first_value(CASE WHEN kind <> 'select' THEN kind END IGNORE NULLS) OVER w AS how
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id AS client_id, commit_seq, event_type AS slot, max(event_id) AS seq, event_type AS lookup_key, json_extract_string(arg_max(props, event_id), '$.k') AS value
FROM n WHERE kind = 'select' AND how = 'commit' GROUP BY 1, 2, 3""")
def commit_flush_cancel_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.events(spark, sf_dir)
    return U.flushed(e, F.col("kind"))


USER_STORE = """
o AS (SELECT -1 AS seq, 'save' AS op, 'u' || p_partkey AS id, p_brand AS reading, p_name AS value, p_type AS comment, CAST(p_partkey AS BIGINT) AS at_ FROM part WHERE p_size = 1
  QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) = 1),
c AS (SELECT p_partkey AS seq, CASE WHEN p_type = 'SMALL' THEN 'delete' ELSE 'save' END AS op, 'n' || p_partkey AS id, p_brand AS reading, p_name AS value, p_type AS comment, CAST(p_partkey AS BIGINT) AS at_ FROM part),
b AS (SELECT * FROM o UNION ALL SELECT * FROM c),
x AS (SELECT *, max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY reading, value) AS gone FROM b)
SELECT arg_min(id, seq) AS id, reading, value, arg_max(comment, seq) AS comment, arg_min(at_, seq) AS created_at, arg_max(at_, seq) AS updated_at
FROM x WHERE op = 'save' AND seq > coalesce(gone, -2) GROUP BY reading, value"""


@query(f"WITH {USER_STORE}")
def userdict_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in order save their entry, small ones delete it; entries of size 1 were there before."""
    p = T.table(spark, sf_dir, "part")
    at = F.col("p_partkey").cast("long")
    base = [F.col("p_brand").alias("reading"), F.col("p_name").alias("value"), F.col("p_type").alias("comment"), at.alias("created_at"), at.alias("updated_at")]
    first = Window.partitionBy("reading", "value").orderBy("created_at")
    old = p.where("p_size = 1").select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("id"), *base).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    new = p.select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("id"), *base, at.alias("seq"), F.when(F.col("p_type") == "SMALL", "delete").otherwise("save").alias("op"))
    return D.applied(old, new)


@query("SELECT p_partkey AS id, p_brand AS reading, p_name AS value FROM part WHERE contains(lower(p_brand), 'red') OR contains(lower(p_name), 'red')")
def userdict_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("reading"), F.col("p_name").alias("value"))
    return D.matching(e, F.lit("  ReD "))


SIZES = f"WITH {RANKED}, n AS (SELECT reading, count(*) AS n FROM r GROUP BY 1), mv AS (SELECT r.*, n, unnest([-10, -1, 1, 7]) AS delta FROM r JOIN n ON r.reading = n.reading)"


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.ranked(spark, sf_dir)
    size = rows.groupBy("reading_k").agg(F.count("*").alias("n"))
    return rows.join(size, "reading_k").select("reading", "rn", "n", F.explode(F.array(*map(F.lit, (-10, -1, 1, 7)))).alias("delta"))


@query(SIZES + """, starts AS (SELECT mv.*, on_key, key_row FROM mv, (VALUES (false, true), (true, true), (false, false), (true, false)) t(on_key, key_row)),
ended AS (
  WITH RECURSIVE w AS (
    SELECT reading, rn, delta, n, on_key, key_row, CAST(rn - 1 AS BIGINT) AS h, on_key AS k, abs(delta) AS left_ FROM starts
    UNION ALL
    SELECT reading, rn, delta, n, on_key, key_row,
      CASE WHEN k THEN CASE WHEN delta > 0 THEN 0 ELSE n - 1 END
        WHEN h + sign(delta) BETWEEN 0 AND n - 1 THEN CAST(h + sign(delta) AS BIGINT) WHEN key_row THEN h WHEN delta > 0 THEN 0 ELSE n - 1 END,
      NOT k AND key_row AND h + sign(delta) NOT BETWEEN 0 AND n - 1, left_ - 1 FROM w WHERE left_ > 0)
  SELECT * FROM w WHERE left_ = 0)
SELECT reading, rn, delta, on_key, key_row, CAST(h AS BIGINT) AS highlight, k AS hangul, CAST(CASE WHEN k THEN (rn - 1) // 9 ELSE h // 9 END AS BIGINT) AS page FROM ended""")
def ring_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves from every candidate and from the key's row, in rings with that row and without; the SQL goes step by step."""
    at = F.col("rn") - 1
    start = F.explode(F.array(*[F.struct(F.lit(a).alias("on_key"), F.lit(b).alias("key_row")) for a in (False, True) for b in (True, False)]))
    moved = P.ring_move(at, F.col("on_key"), F.col("delta"), F.col("n"), P.page_of(F.col("rn")), key_row=F.col("key_row"))
    return _moves(spark, sf_dir).withColumn("s", start).select("*", "s.*").withColumn("m", moved).select("reading", "rn", "delta", "on_key", "key_row", "m.highlight", "m.hangul", "m.page")


@query(f"""WITH {RANKED}, p AS (SELECT reading, count(*) AS n, CASE WHEN count(*) % 4 > 0 THEN max(value) ELSE 'none' END AS preview FROM r GROUP BY 1),
h AS (SELECT p.*, (SELECT CAST(min(rn) - 1 AS BIGINT) FROM r WHERE r.reading = p.reading AND r.value = p.preview) AS place FROM p)
SELECT reading, coalesce(place, -1) AS preview_index, CAST(CASE WHEN n % 3 = 0 THEN n - 1 ELSE coalesce(place, 0) END AS BIGINT) AS highlight, regexp_full_match(reading, '[0-9]+') OR (n % 5 = 0) AS on_key FROM h""")
def panel_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each reading's panel starts: the row kept from before, else the preview's, else the first; numbers, and words where it is preferred, start on the key."""
    r = T.ranked(spark, sf_dir)
    n = F.count("*")
    panels = r.groupBy("reading").agg(n.alias("n"), F.when(n % 4 > 0, F.max("value")).otherwise("none").alias("preview"))
    found = P.with_preview_index(panels, r, "reading")
    kept = F.when(F.col("n") % 3 == 0, F.col("n") - 1)
    on_key = P.start_on_hangul(F.col("reading").rlike(r"^[0-9]+\z"), F.col("n") % 5 == 0)
    return found.select("reading", F.coalesce("preview_index", F.lit(-1).cast("long")).alias("preview_index"), P.start_row(kept, F.col("preview_index"), F.lit(0)).cast("long").alias("highlight"), on_key.alias("on_key"))


@query(SIZES + """, a AS (SELECT *, (n + 8) // 9 AS pages FROM mv), b AS (SELECT *, (((rn - 1) // 9 + delta) % pages + pages) % pages AS page_ FROM a)
SELECT reading, rn, delta, CAST(page_ AS BIGINT) AS page, CAST(least(page_ * 9, n - 1) AS BIGINT) AS highlight FROM b""")
def page_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = P.page_move(P.page_of(F.col("rn")), F.col("delta"), F.col("n"))
    return _moves(spark, sf_dir).withColumn("m", moved).select("reading", "rn", "delta", "m.page", "m.highlight")


@query("SELECT doc_id, md5(nfc_normalize(text)) AS nfc_md5, CAST(length(text) AS BIGINT) AS units FROM documents")
def text_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFC key and UTF-16 length of every text (no text here has characters beyond the first plane)."""
    return T.table(spark, sf_dir, "documents").select("doc_id", F.md5(nfc_key(F.col("text"))).alias("nfc_md5"), utf16_length(F.col("text")).alias("units"))
