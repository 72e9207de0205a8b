"""Queries of sessions, panels and key dispatch over the driver's events, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy as P
from ..sources import versions
from ..streaming import choices, dispatch, keys
from ..streaming import ranges as R
from ..streaming import usage as W
from ..streaming.hangul import FIRST_SYLLABLE, LEADS, TAILS, VOWELS
from ..streaming.hangul import KEYS as TWO_SET
from ..streaming.panel import Panel
from ..streaming.session import lookup_table
from ..streaming.tokens import answered
from . import tables as T
from .queries import ORACLE, query

#: Keys that events stand for, by their number k: escape, return, tab, arrows, space, digits, backspace, a letter, enter.
KEY_OF = [53, 36, 48, 126, 125, 123, 124, 49, 18, 19, 25, 29, 51, 0, 76, 22]
MODIFIERS = [0, P.SHIFT, P.OPTION, P.CONTROL, P.SHIFT | P.COMMAND, 0]


def _number(props: str = "props"):
    return F.get_json_object(props, "$.k").cast("int")


def _pick(values: list[int], at) -> F.Column:
    return F.array(*[F.lit(v).cast("long") for v in values])[at.cast("int")]


def _sql_pick(values: list[int], at: str) -> str:
    return f"({values})[CAST({at} AS INT) + 1]"


K = "CAST(json_extract_string(props, '$.k') AS INT)"
#: What a key means where no panel takes it.
PLAIN = """CASE WHEN code = 51 THEN 'backspace' WHEN code IN (36, 76) THEN 'return' WHEN code = 53 THEN 'escape' WHEN code = 49 THEN 'space'
  WHEN code IN (48, 123, 124, 125, 126) THEN 'leave' ELSE 'text' END"""


@query(f"""WITH RECURSIVE e AS (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, event_type AS opens, {K} AS k, {_sql_pick(KEY_OF, f"{K} % 16")} AS code, event_id % 3 = 0 AS shift FROM events),
s AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS event_id, '' AS action, 'none' AS kind, 0 AS n, 0 AS hl, false AS on_key, 0 AS page, 0 AS segment, CAST(NULL AS INT) AS choice FROM events
  UNION ALL
  SELECT user_id, nth, event_id, action,
    CASE WHEN action = 'signup' THEN 'manual' WHEN action = 'purchase' THEN CASE WHEN n2 = 0 THEN 'none' ELSE 'realtime' END WHEN action = 'error' THEN 'notice'
      WHEN NOT taken OR action = 'dismiss' OR choice2 IS NOT NULL OR action = 'return' THEN 'none' ELSE kind END,
    n2,
    CASE WHEN opened OR action IN ('left', 'right') THEN 0 WHEN NOT taken THEN 0 WHEN action IN ('tab', 'backtab') AND n2 > 0 THEN page2 * 9
      WHEN action = 'down' AND n2 > 0 THEN CASE WHEN on_key THEN 0 WHEN hl + 1 < n2 THEN hl + 1 ELSE hl END
      WHEN action = 'up' AND n2 > 0 THEN CASE WHEN on_key THEN n2 - 1 WHEN hl > 0 THEN hl - 1 ELSE hl END ELSE hl END,
    CASE WHEN opened THEN action = 'signup' AND k % 4 = 0 WHEN NOT taken OR action IN ('left', 'right', 'tab', 'backtab') OR n2 = 0 AND action IN ('up', 'down') THEN false
      WHEN action = 'down' THEN NOT on_key AND hl + 1 >= n2 WHEN action = 'up' THEN NOT on_key AND hl = 0 ELSE on_key END,
    CASE WHEN opened OR NOT taken OR action IN ('left', 'right') THEN 0 WHEN action IN ('tab', 'backtab') AND n2 > 0 THEN page2
      WHEN n2 > 0 AND action = 'down' AND on_key THEN 0 WHEN n2 > 0 AND action = 'up' AND on_key THEN (n2 - 1) // 9
      WHEN n2 > 0 AND action = 'down' AND hl + 1 < n2 THEN (hl + 1) // 9 WHEN n2 > 0 AND action = 'up' AND hl > 0 THEN (hl - 1) // 9 ELSE page END,
    CASE WHEN opened OR NOT taken THEN 0 WHEN action = 'left' THEN (segment + 2) % 3 WHEN action = 'right' THEN (segment + 1) % 3 ELSE segment END,
    choice2
  FROM (
    SELECT *, CASE WHEN opened THEN CASE WHEN action = 'error' THEN 0 ELSE k % 25 END WHEN taken THEN n ELSE 0 END AS n2,
      CASE WHEN n > 0 THEN (page + CASE WHEN action = 'tab' THEN 1 ELSE (n + 8) // 9 - 1 END) % ((n + 8) // 9) ELSE 0 END AS page2,
      CASE WHEN taken AND action = 'return' AND kind <> 'notice' THEN CASE WHEN on_key THEN -1 WHEN n > 0 THEN hl END
        WHEN taken AND action = 'number' THEN CASE WHEN code = 29 THEN -1 WHEN page * 9 + digit < n THEN page * 9 + digit END END AS choice2
    FROM (
      SELECT *, CASE WHEN opened THEN opens WHEN taken THEN own ELSE {PLAIN} END AS action, CASE code WHEN 18 THEN 0 WHEN 19 THEN 1 WHEN 22 THEN 5 WHEN 25 THEN 8 END AS digit
      FROM (
        SELECT *, own IS NOT NULL AND NOT opened AS taken FROM (
          SELECT s.user_id, e.nth, e.event_id, e.opens, e.k, e.code, e.shift, e.opens IN ('signup', 'purchase', 'error') AS opened, s.kind, s.n, s.hl, s.on_key, s.page, s.segment,
            CASE WHEN s.kind = 'none' THEN NULL WHEN e.code = 53 THEN 'dismiss' WHEN s.kind = 'notice' THEN NULL WHEN e.code IN (36, 76) THEN 'return'
              WHEN e.code = 48 THEN CASE WHEN e.shift THEN 'backtab' ELSE 'tab' END WHEN e.code = 126 THEN 'up' WHEN e.code = 125 THEN 'down'
              WHEN s.kind = 'manual' THEN CASE WHEN e.code IN (18, 19, 22, 25, 29) AND NOT e.shift THEN 'number' WHEN e.code = 123 THEN 'backtab' WHEN e.code = 124 THEN 'tab' WHEN e.code = 49 THEN 'dismiss' END
              WHEN e.code IN (123, 124) THEN CASE WHEN e.shift THEN 'boundary' WHEN e.code = 123 THEN 'left' ELSE 'right' END END AS own
          FROM s JOIN e ON e.user_id = s.user_id AND e.nth = s.nth + 1)))))
SELECT CAST(user_id AS VARCHAR) AS client_id, event_id AS seq, action, kind, CAST(CASE WHEN kind = 'none' THEN 0 ELSE n END AS BIGINT) AS n, CAST(CASE WHEN kind = 'none' THEN 0 ELSE hl END AS BIGINT) AS highlight,
  kind <> 'none' AND on_key AS on_key, CAST(CASE WHEN kind = 'none' THEN 0 ELSE page END AS BIGINT) AS page, CAST(CASE WHEN kind = 'none' THEN 0 ELSE segment END AS BIGINT) AS segment, CAST(coalesce(choice, -2) AS BIGINT) AS choice
FROM s WHERE nth > 0""")
def panel_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of all kinds under raw keys: signups open manual candidates, purchases real-time ones, errors a notice, and all
    other events are keys, which the rules of dispatch hand to the panel or let go on. A choice of -2 is none, -1 the text itself."""
    e = T.table(spark, sf_dir, "events")
    keys = e.select(F.col("user_id").cast("string").alias("client_id"), F.col("event_id").alias("seq"), "event_type", _number().alias("k"), (F.col("event_id") % 3 == 0).alias("shift"))

    def step(p: Panel | None, kind: str, k: int, shift: bool) -> tuple[Panel | None, str, int | None]:
        """(panel, action, choice) after an event."""
        values = [str(i) for i in range(k % 25)]
        if kind == "signup":
            return Panel("manual", values, "text", on_key=k % 4 == 0), kind, None
        if kind == "purchase":
            return Panel("realtime", values, "text", segment=0) if values else None, kind, None
        if kind == "error":
            return Panel("notice", message="none"), kind, None
        choice = None
        met = lambda: dispatch.Met(key=KEY_OF[k % 16], modifiers=P.SHIFT if shift else 0, panel=p.kind if p else "none")
        for rule in dispatch.actions(met):
            action, before = rule.action, p
            if p is None:
                continue
            if p.kind == "realtime" and action in ("left", "right"):
                p = Panel("realtime", p.values, p.key, segment=(p.segment + (1 if action == "right" else -1)) % 3)
            elif rule.panel:
                stays, choice = p.take(action, int(rule.value) if action == "number" else None)
                p = before if stays else None
        return p, action, choice

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, p = None, None
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if r.client_id != client:
                    client, p = r.client_id, None
                p, action, choice = step(p, r.event_type, int(r.k), r.shift)
                rows.append((client, r.seq, action, p.kind if p else "none", len(p.values) if p else 0, p.at if p else 0, bool(p and p.on_key), p.page if p else 0, p.segment or 0 if p else 0, -2 if choice is None else choice))
            yield pd.DataFrame(rows, columns=["client_id", "seq", "action", "kind", "n", "highlight", "on_key", "page", "segment", "choice"])

    ordered = keys.repartition("client_id").sortWithinPartitions("client_id", "seq")
    return ordered.mapInPandas(run, "client_id string, seq long, action string, kind string, n long, highlight long, on_key boolean, page long, segment long, choice long")


@query(f"""WITH m AS (
  SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'command' ELSE 'key' END AS source, {_sql_pick(KEY_OF, f"{K} % 16")} AS code, {_sql_pick(MODIFIERS, "event_id % 6")} AS mods,
    CASE WHEN event_id % 9 > 0 THEN 'none' WHEN {K} % 3 = 0 THEN 'newline' WHEN {K} % 3 = 1 THEN 'navigation' ELSE 'other' END AS command,
    CASE event_type WHEN 'signup' THEN 'manual' WHEN 'purchase' THEN 'realtime' WHEN 'error' THEN 'notice' ELSE 'none' END AS panel,
    value > 10 AS clause, {K} % 2 = 0 AS pending, event_id % 5 = 0 AS suppressed, event_id % 7 = 0 AS armed, event_id % 11 = 0 AS moved FROM events),
f AS (SELECT *, (mods // {P.SHIFT}) % 2 = 1 AS shift, mods = {P.OPTION} AS option_only, mods = {P.CONTROL} AS control_only, mods = {P.SHIFT} AS shift_only, (mods // {P.CONTROL}) % 2 = 1 OR (mods // {P.COMMAND}) % 2 = 1 AS away, code IN (36, 76) AS ret FROM m),
p AS (SELECT *, CASE WHEN source = 'command' THEN NULL WHEN ret AND suppressed THEN 'swallow:' WHEN panel = 'none' THEN NULL WHEN code = 53 THEN 'dismiss:' WHEN panel = 'notice' THEN NULL
    WHEN ret THEN 'return:' WHEN code = 48 AND shift THEN 'backtab:' WHEN code = 48 THEN 'tab:' WHEN code = 126 THEN 'up:' WHEN code = 125 THEN 'down:'
    WHEN panel = 'manual' THEN CASE WHEN NOT shift AND code IN (18, 19, 22, 25, 29) THEN 'number:' || CASE code WHEN 18 THEN '0' WHEN 19 THEN '1' WHEN 22 THEN '5' WHEN 25 THEN '8' ELSE '9' END
      WHEN code = 123 THEN 'backtab:' WHEN code = 124 THEN 'tab:' WHEN code = 49 THEN 'dismiss:' END
    WHEN code IN (123, 124) THEN CASE WHEN shift_only AND code = 123 THEN 'boundary:-1' WHEN shift_only THEN 'boundary:1' WHEN code = 123 THEN 'left:' ELSE 'right:' END END AS own FROM f),
c AS (SELECT *, clause AND NOT moved AS still FROM p),
g AS (SELECT *, CASE WHEN control_only AND code = 0 THEN 'toggle:' WHEN ret AND option_only THEN CASE WHEN still THEN 'swallow:' ELSE 'trigger:' END ELSE NULL END AS early,
    CASE WHEN away THEN 'leave:' WHEN code = 51 THEN 'backspace:' WHEN ret THEN 'return:' WHEN code = 53 THEN 'escape:' WHEN code = 49 THEN 'space:'
      WHEN still AND code IN (48, 126) THEN 'swallow:' WHEN still AND code = 125 THEN 'panel:' WHEN still AND code = 123 THEN CASE WHEN shift_only THEN 'boundary:-1' ELSE 'left:' END
      WHEN still AND code = 124 THEN CASE WHEN shift_only THEN 'boundary:1' ELSE 'right:' END WHEN code IN (48, 123, 124, 125, 126) THEN 'leave:' ELSE 'text:' END AS late FROM c)
SELECT event_id, CASE WHEN source = 'command' THEN
    CASE WHEN command = 'newline' AND suppressed THEN 'swallow:' WHEN command = 'newline' AND (armed OR option_only) THEN 'trigger:' WHEN command = 'newline' AND clause THEN 'commit:'
      WHEN command = 'navigation' AND panel = 'manual' THEN 'dismiss:' WHEN command = 'navigation' AND clause THEN 'disarm: swallow:' WHEN command = 'navigation' AND pending THEN 'disarm: leave:' ELSE 'disarm: pass:' END
  WHEN own IS NOT NULL THEN own
  ELSE CASE WHEN panel <> 'none' THEN 'dismiss: ' ELSE '' END || CASE WHEN clause AND moved THEN 'commit: ' ELSE '' END || coalesce(early, 'disarm: ' || late) END AS actions FROM g""")
def key_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actions that every event means as a key or command, with a state it met."""
    e = T.table(spark, sf_dir, "events")
    k, n = _number(), F.col("event_id")
    code = _pick(KEY_OF, k % 16)
    panel = F.when(F.col("event_type") == "signup", "manual").when(F.col("event_type") == "purchase", "realtime").when(F.col("event_type") == "error", "notice").otherwise("none")
    command = F.when(n % 9 > 0, "none").when(k % 3 == 0, "newline").when(k % 3 == 1, "navigation").otherwise("other")
    found = dispatch.actions_of(
        source=F.when(n % 9 == 0, "command").otherwise("key"), key=code.cast("int"), modifiers=_pick(MODIFIERS, n % 6), char=F.when(code == 0, "A").otherwise(""), command=command,
        panel=panel, clause=F.col("value") > 10, pending=k % 2 == 0, suppressed=n % 5 == 0, armed=n % 7 == 0, moved=n % 11 == 0,
    )
    return e.select("event_id", F.array_join(F.transform(found, lambda a: F.concat(a["action"], F.lit(":"), a["value"])), " ").alias("actions"))


def range_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as range events: views begin, clicks mark (in no known place every fifth time), signups insert, purchases clear, errors finish."""
    e = T.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "begin").when(F.col("event_type") == "click", "sync").when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "purchase", "clear").otherwise("finish")
    k = _number().cast("long")
    return e.select(F.col("user_id").alias("client_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(k % 5 > 0, k).alias("loc"), (k % 7).alias("len"), (k % 3).alias("text_len"))


@query(f"""WITH RECURSIVE e AS (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, event_type AS t, CASE WHEN {K} % 5 > 0 THEN {K} END AS l, {K} % 7 AS n, {K} % 3 AS w FROM events),
s AS (
  SELECT DISTINCT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS nth, 'none' AS mode, CAST(NULL AS INT) AS loc, CAST(NULL AS INT) AS len FROM events
  UNION ALL
  SELECT s.user_id, e.event_id, e.nth,
    CASE t WHEN 'view' THEN CASE mode WHEN 'none' THEN 'initial-selection' ELSE mode END WHEN 'click' THEN CASE WHEN l IS NULL THEN 'implicit' ELSE 'client-marked' END
      WHEN 'signup' THEN CASE WHEN l IS NULL THEN 'implicit' ELSE 'initial-selection' END WHEN 'purchase' THEN CASE mode WHEN 'client-marked' THEN 'initial-selection' ELSE mode END ELSE 'none' END,
    CASE t WHEN 'view' THEN CASE mode WHEN 'none' THEN l ELSE loc END WHEN 'click' THEN l WHEN 'signup' THEN l + w WHEN 'purchase' THEN loc END,
    CASE t WHEN 'view' THEN CASE mode WHEN 'none' THEN n ELSE len END WHEN 'click' THEN CASE WHEN l IS NOT NULL THEN n END WHEN 'signup' THEN CASE WHEN l IS NOT NULL THEN 0 END
      WHEN 'purchase' THEN CASE mode WHEN 'client-marked' THEN 0 ELSE len END END
  FROM s JOIN e ON e.user_id = s.user_id AND e.nth = s.nth + 1)
SELECT user_id AS client_id, event_id AS seq, mode, coalesce(loc, -1)::BIGINT AS loc, coalesce(len, -1)::BIGINT AS len FROM s WHERE nth > 0""")
def range_states_at_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range state after every event, by composed maps of blocks of events; the SQL goes event by event."""
    none = F.lit(-1).cast("long")
    found = R.range_states_at(range_events(spark, sf_dir))
    return found.select("client_id", "seq", "mode", F.coalesce("loc", none).alias("loc"), F.coalesce("len", none).alias("len"))


@query(ORACLE["commit_flush_cancel_drop"])
def streamed_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices that commits write out, by a stream that keeps each client's open ones."""
    return choices.run_through(spark, choices.flushed(T.event_stream(spark, sf_dir)), "flushes")


@query(ORACLE["ttl_match_consume_once"])
def streamed_limits_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices.run_through(spark, _limits(spark, sf_dir, True), "limits")


@query(ORACLE["ttl_match_sticky"])
def streamed_limits_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices.run_through(spark, _limits(spark, sf_dir, False), "limits")


def _limits(spark: SparkSession, sf_dir: str, once: bool) -> DataFrame:
    return choices.within_limit(T.event_stream(spark, sf_dir), F.col("slot") == "signup", F.col("slot") == "view", 8 * 3600, once)


@query(ORACLE["usage_upsert"])
def usage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in four micro-batches, one of which runs twice, through the usage table of buckets."""
    import uuid

    path = f"{versions.shared_folder(spark)}/usage-{uuid.uuid4().hex}"
    events = T.events(spark, sf_dir)
    most = (events.agg(F.max("seq")).first()[0] or 0) + 1
    quarter = events.withColumn("batch", F.floor(F.col("seq") * 4 / most))
    for batch in (0, 1, 1, 2, 3):
        W.writer(path)(quarter.where(F.col("batch") == batch), batch)
    return W.latest(spark, path)


#: Letters as syllables: the keys of one consonant and one vowel each, so that no syllable takes the next one's consonant.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
PAIRS = [c + v for v in "kj" for c in "rsefaqtdwczxvg"][:26]
SYLLABLES = "".join(chr(FIRST_SYLLABLE + (LEADS.index(TWO_SET[c]) * len(VOWELS) + VOWELS.index(TWO_SET[v])) * len(TAILS)) for c, v in PAIRS)
#: Letters in a token of the first, second and third tokenization, and the tags that take turns.
SIZES, TAGS = (3, 2, 4), ("nnp", "jks", "nng", "vx")


@query(f"""WITH b AS (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM benchmark),
d AS (SELECT form, count(*) % 5 = 0 AS own FROM (SELECT substr(w, 1, n) AS form FROM b, (VALUES (2), (3)) q(n) WHERE length(w) >= n) GROUP BY form),
c AS (SELECT DISTINCT w FROM b),
t AS (
  SELECT w, rank, i, substr(w, i * size + 1, size) AS form, (['nnp', 'jks', 'nng', 'vx'])[(i + rank) % 4 + 1] AS tag
  FROM (SELECT w, rank, size, unnest(range((length(w) + size - 1) // size)) AS i FROM c, (VALUES (0, 3), (1, 2), (2, 4)) q(rank, size))),
s AS (SELECT t.*, tag <> 'jks' AND d.form IS NOT NULL AS converts, CASE WHEN tag IN ('nnp', 'nng') AND NOT own THEN upper(form) ELSE form END AS shown FROM t LEFT JOIN d USING (form)),
r AS (SELECT w, rank, sum(CASE WHEN converts THEN length(form) ELSE 0 END) AS cover, string_agg(CASE WHEN converts THEN shown ELSE form END, '' ORDER BY i) AS shown FROM s GROUP BY ALL)
SELECT w AS client_id, CAST(2 * length(w) + 1 AS BIGINT) AS seq, translate(shown, '{LETTERS}', '{SYLLABLES}') AS text FROM r QUALIFY row_number() OVER (PARTITION BY w ORDER BY cover DESC, rank) = 1""")
def read_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the benchmark typed key by key, read by a tokenizer at its last key, and committed. The beginnings of all
    its words are known; where their count is a multiple of five, their Hangul is preferred."""
    words = T.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("w"))
    hangul = lambda c: F.translate(c, LETTERS, SYLLABLES)
    forms = words.select(F.explode(F.array(*[F.when(F.length("w") >= n, F.substring("w", 1, n)) for n in (2, 3)])).alias("form")).where("form is not null").groupBy("form").agg(F.count("*").alias("n"))
    known = forms.select(hangul(F.col("form")).alias("reading_k"), F.lit(1).alias("rn"), F.upper("form").alias("value"), F.col("n").alias("usage_count"))
    own = forms.where("n % 5 = 0").select(hangul(F.col("form")).alias("lookup_key"), hangul(F.col("form")).alias("value"), F.col("n").alias("count"))
    lookup = lookup_table(known, usage=own)  # two or three letters: at most 26 ** 2 + 26 ** 3 forms

    clauses = words.distinct()
    pairs = F.create_map(*[F.lit(x) for kv in zip(LETTERS, PAIRS, strict=True) for x in kv])
    letters = F.split("w", "")
    strokes = F.flatten(F.transform(letters, lambda c: F.split(pairs[c], "")))
    row = lambda chars, modifiers, command: F.struct(chars.alias("chars"), F.lit(modifiers).cast("long").alias("modifiers"), F.lit(command).cast("string").alias("command"))
    nothing = F.lit(None).cast("string")
    typed = F.concat(F.array(row(F.lit(P.TOGGLE), P.CONTROL, None)), F.transform(strokes, lambda c: row(c, 0, None)), F.array(row(nothing, 0, "insertNewline:")))
    flat = clauses.select(F.col("w").alias("client_id"), F.posexplode(typed).alias("seq", "k")).select("client_id", F.col("seq").cast("long"), F.col("seq").cast("double").alias("ts"), "k.*", F.when(F.col("k.command").isNotNull(), "command").alias("source"))
    absent = [c.split() for c in keys.KEYS.split(", ") if c.split()[0] not in flat.columns]
    rows = flat.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in absent])

    tags = F.array(*map(F.lit, TAGS))

    def tokens(rank: int, size: int) -> F.Column:
        token = lambda i: F.struct(F.get(tags, (i + rank) % 4).alias("tag"), (i * size).alias("position"), F.least(F.lit(size), F.length("w") - i * size).alias("length"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.length("w") - 1) / size).cast("int")), token)

    last = 2 * F.length("w")
    answers = clauses.select(F.col("w").alias("client_id"), last.cast("long").alias("seq"), last.cast("double").alias("ts"), hangul(F.col("w")).alias("clause"), F.array(*[tokens(r, n) for r, n in enumerate(SIZES)]).alias("tokenizations"))
    done = keys.replay(answered(rows, answers), lookup)
    return done.where("kind = 'insert'").select("client_id", "seq", "text")
