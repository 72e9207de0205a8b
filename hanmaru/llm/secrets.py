"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Base spans are the matches of three fixed patterns: assignments, access keys and long hexadecimal runs. The method adds
spans of kind `live`: candidate values (the assigned value, an access key, a hexadecimal run, or any other long token that
mixes letters and digits) that look live and whose hash occurs with few distinct owners and repositories in the whole
corpus. Values that many owners share are examples, fixtures or published identifiers and get no `live` span.

Positions are code points, end exclusive. Patterns have no positions in SQL, so each is run twice, once for the matches
and once for the gaps between them; running sums of both lengths over the matches give the positions.

Fixed cases: null and empty texts have no spans; a null owner or repository counts as one owner or repository of its own;
repeated rows and repeated values within a document don't add owners; of spans that start alike the listed order of kinds
decides; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Fixed patterns: kind -> (pattern, least length of what counts, group that counts). Order breaks ties of start.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")
#: Other candidates of the method: long runs of token characters.
WIDE = r"[A-Za-z0-9_-]{24,}"
#: A live credential belongs to one owner and at most so many of its repositories.
MAX_OWNERS, MAX_REPOS = 1, 2
#: A value with fewer distinct characters, or with one of these words, is a placeholder.
LEAST_DISTINCT = 8
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your|test|xxxx|0123456789|abcdef012"


def matches(text: Column, order: int, pattern: str, value_group: int = 0) -> Column:
    """array<struct<o, i, gap, n, value>> of a pattern's matches in text order: number, characters since the match before,
    characters of the match, and the value that counts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.filter(F.arrays_zip(found.alias("m"), value.alias("v"), gaps.alias("g")), lambda x: x["m"].isNotNull())
    return F.transform(rows, lambda x, i: F.struct(F.lit(order).alias("o"), i.alias("i"), x["g"].alias("gap"), F.length(x["m"]).alias("n"), x["v"].alias("value")))


def scan(docs: DataFrame, owner: str, repo: str, *keep: Column) -> DataFrame:
    """`keep` and (owner, repo, found): matches of the base patterns and of the wide one."""
    none = F.array().cast("array<struct<o:int,i:int,gap:int,n:int,value:string>>")

    def some(test: str, found: Column) -> Column:  # most texts have no match at all: one look settles those
        return F.when(F.col("t").rlike(test), found).otherwise(none)

    t = F.col("t")
    rows = docs.select(*keep, F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"), F.coalesce("text", F.lit("")).alias("t"))
    found = F.concat(
        some(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9+/_.=-]{12}", matches(t, 0, ASSIGN, 2)),
        some(r"AKIA[A-Z0-9]{14}", matches(t, 1, r"AKIA[A-Z0-9]{14,}")),
        some(r"[0-9a-f]{16}", matches(t, 2, r"[0-9a-f]{16,}")),
        some(WIDE, matches(t, 3, WIDE)),
    )
    return rows.withColumn("found", found).drop("t")


def looks_live(value: Column) -> Column:
    """Letters and digits, enough distinct characters, and no placeholder word."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= LEAST_DISTINCT) & ~value.rlike(PLACEHOLDER)


def spans_of(rows: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """(row, spans): spans of the rows that have any, array<struct<s, o, e, kind>> sorted by s and o; rows come from a table, as
    scan gives them, with a number `row` each."""
    each = rows.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("x")).select("row", "owner", "repo", "x.*")
    so_far = Window.partitionBy("row", "o").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(so_far).cast("int")
    each = cut(each.withColumn("e", end).withColumn("s", F.col("e") - F.col("n")).where((F.col("o") > 0) | (F.length("value") >= 12)), "secret_spans")
    cand = each.where(looks_live(F.col("value"))).select("row", "owner", "repo", "s", "e", F.sha2("value", 256).alias("h"))
    null = F.lit("\x00null")
    owned = (
        cand.select("h", F.coalesce("owner", null).alias("owner"), F.coalesce("repo", null).alias("repo"))
        .distinct()
        .groupBy("h")
        .agg(F.count_distinct("owner").alias("owners"), F.count("*").alias("repos"))
        .where((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))
    )
    live = cand.join(owned.select("h"), "h", "left_semi").select("row", "s", F.lit(3).alias("o"), "e")
    both = each.where("o < 3").select("row", "s", "o", "e").unionByName(live)
    kind = F.element_at(F.array(*map(F.lit, (*KINDS, "live"))), F.col("o") + 1)
    return both.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("s", "o", "e", kind.alias("kind")))).alias("spans"))


def find_secrets(docs: DataFrame, owner: str = "source", repo: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(doc_id, base, spans): a row for each document; base and spans are array<struct<s, o, e, kind>>, sorted by s and o.

    owner and repo name the columns that tell whose a document is and what collection of theirs it is from.
    """
    rows = cut(scan(docs, owner, repo, F.col("doc_id")).withColumn("row", F.monotonically_increasing_id()), "secret_matches")
    none = F.array().cast("array<struct<s:int,o:int,e:int,kind:string>>")
    spans = F.coalesce("spans", none)
    found = rows.select("row", "doc_id").join(spans_of(rows, max_owners, max_repos), "row", "left")
    return found.select("doc_id", F.filter(spans, lambda x: x["o"] < 3).alias("base"), spans.alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """text with each stretch that spans cover replaced by the mark; spans come sorted by start."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        gap = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), gap.alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, mark: str = "[SECRET]", owner: str = "source", repo: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """docs with every span replaced by the mark, overlapping spans by one; n_chars follows the text. No row is lost.

    Only rows with a match meet their spans in a shuffle; all others stay where they are.
    """
    rows = cut(scan(docs, owner, repo, F.struct(*docs.columns).alias("doc")).withColumn("row", F.monotonically_increasing_id()), "secret_matches")
    plain = rows.where(F.size("found") == 0).select("doc.*")
    met = rows.where(F.size("found") > 0).select("row", "doc").join(spans_of(rows, max_owners, max_repos), "row", "left")
    text = F.when(F.col("spans").isNull(), F.col("doc.text")).otherwise(masked(F.col("doc.text"), F.col("spans"), mark))
    out = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        length = F.when(F.col("spans").isNull(), F.col("doc.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
        out["n_chars"] = length.alias("n_chars")
    return plain.unionByName(met.select(*[out.get(c, F.col(f"doc.`{c}`")) for c in docs.columns]))


def query(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql_spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """SQL of (doc_id, source, s, o, e, kind, value) of one pattern's matches: gaps and matches add up to places."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, s, {order} AS o, e, '{kind}' AS kind, v AS value FROM (
    SELECT doc_id, source, v, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
      CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT) AS e
    FROM (SELECT doc_id, source, m, g, unnest(vs) AS v, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, source, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS vs, string_split_regex(t, '{p}') AS g
      FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)) WHERE len(m) > 0)) WHERE length(v) >= {least}"""


ORACLE_SQL = (
    "WITH b AS ("
    + " UNION ALL ".join(
        _sql_spans(*x)
        for x in (("assign", 0, ASSIGN, 2, 12), ("access", 1, ACCESS, 0, 18), ("hex", 2, HEX, 0, 16), ("wide", 9, WIDE, 0, 24))
    )
    + f"""),
c AS (SELECT *, coalesce(source, chr(1)) AS owner FROM b
  WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '{PLACEHOLDER}')
    AND len(list_distinct(string_split(value, ''))) >= {LEAST_DISTINCT}),
n AS (SELECT value FROM c GROUP BY value HAVING count(DISTINCT owner) <= {MAX_OWNERS}),
l AS (SELECT DISTINCT doc_id, s, 3 AS o, e, 'live' AS kind FROM c SEMI JOIN n ON c.value = n.value),
a AS (SELECT doc_id, s, o, e, kind FROM b WHERE o < 9 UNION ALL SELECT * FROM l),
j AS (SELECT doc_id,
    string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, o, e) FILTER (WHERE o < 3) AS base,
    string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, o, e) AS spans,
    count(*) FILTER (WHERE o = 0) AS n0, count(*) FILTER (WHERE o = 1) AS n1, count(*) FILTER (WHERE o = 2) AS n2 FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id
"""
)
