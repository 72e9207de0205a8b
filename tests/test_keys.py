"""Raw keys: dispatch rules, sequences over all kinds of panels, ranges, and sessions as streams with timers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hanmaru.functions import policy as P
from hanmaru.streaming import dispatch as D
from hanmaru.streaming import keys as K
from hanmaru.streaming.numbers import readings
from hanmaru.streaming.panel import Panel
from hanmaru.streaming.session import LOADING, NO_CANDIDATES, NO_TARGET, UNAVAILABLE, Host, Lookup, Session, target

LOOKUP = Lookup({"한자": ["漢字", "漢子"], "한국": ["韓國"], "가": [f"加{i}" for i in range(20)], "나": ["我"]})
LOOKUP.hangul = frozenset({"나"})
CODES = {c: k for k, c in P.ANSI_KEYS.items()}
NAMED = {"return": P.RETURN, "escape": D.ESCAPE, "space": D.SPACE, "tab": D.TAB, "up": D.UP, "down": D.DOWN, "left": P.LEFT, "right": P.RIGHT, "back": D.BACKSPACE}
FIELDS = [c.split()[0] for c in K.KEYS.split(", ")]


def key(name, mods=0, ts=0.0, **more):
    code = NAMED.get(name, CODES.get(name.lower(), 200))
    chars = name if len(name) == 1 else None
    return {"ts": ts, "key_code": code, "modifiers": mods, "chars": chars, **more}


def command(name, **more):
    return {"ts": 0.0, "source": "command", "command": name, **more}


def table(rows, client="c"):
    return pd.DataFrame([{f: None for f in FIELDS} | {"client_id": client, "seq": i} | r for i, r in enumerate(rows)], columns=FIELDS)


def rows_of(state, *events):
    frame = K.stepped(state, table(events), LOOKUP)
    return [(r.kind, r.text, r.value) for r in frame.itertuples(index=False)]


def typed(text):
    return [key(c) for c in text]


def realtime(clause):
    s = K.KeySession(Session(mode="realtime", clause=clause))
    s.session.analyse(LOOKUP)
    return s


def test_manual_panel_chooses_by_number_and_turns_pages():
    s, o = K.KeySession(), {"left_text": "가", "sel_loc": 1, "sel_len": 0}
    assert rows_of(s, key("return", P.OPTION, **o)) == [("panel", "加0", "0")]
    assert s.session.panel.numbered and s.session.panel.manual_source == "가" and s.session.panel.manual_range == (0, 1) and s.session.panel.segment_surface is None
    assert rows_of(s, key("right"), key("right"), key("left"), key("tab", P.SHIFT)) == [("panel", "加9", "1"), ("panel", "加18", "2"), ("panel", "加9", "1"), ("panel", "加0", "0")]
    assert rows_of(s, key("up"), key("up")) == [("panel", "가", "0"), ("panel", "加19", "2")]
    assert rows_of(s, key("3")) == [("panel", "加19", "2")]  # the last page has two rows
    assert rows_of(s, key("2")) == [("insert", "加19", None), ("usage", "가", "加19")] and s.session.panel is None
    rows_of(s, key("return", P.OPTION, ts=9.0, **o))
    assert rows_of(s, key("0", ts=9.0)) == [("insert", "가", None), ("usage", "가", "가")]


def test_manual_panel_closes_and_lets_keys_go_on():
    o = {"left_text": "한자", "sel_loc": 2, "sel_len": 0}
    for name, left in (("space", []), ("escape", []), ("back", [("pass", "51", None)]), ("q", [("mark", "ㅂ", None)])):
        s = K.KeySession()
        assert rows_of(s, key("return", P.OPTION, **o), key(name)) == [("panel", "漢字", "0"), ("panel", "", None), *left]


def test_composed_text_is_committed_before_its_choice():
    s = K.KeySession()
    at = {"sel_loc": 2, "sel_len": 0, "left_text": "나라"}
    marked = {"marked_loc": 2, "marked_len": 1, "left_text": "나라", "sel_loc": 3, "sel_len": 0}
    got = K.stepped(s, table([key("r", **at), key("k", **marked), key("return", P.OPTION, **marked)]), LOOKUP)
    assert s.session.panel.key == "나라가" and s.session.panel.manual_range == (0, 3)
    got = K.stepped(s, table([key("0", ts=3.0, **marked)]), LOOKUP)
    assert [tuple(r)[3:] for r in got.itertuples(index=False)] == [("insert", "가", None, 2, 1), ("insert", "나라가", None, 0, 3), ("usage", "나라가", "나라가", pd.NA, pd.NA)]


@pytest.mark.parametrize("more,message", [({}, NO_TARGET), ({"left_text": "가", "sel_loc": 1, "sel_len": 0, "status": "loading"}, LOADING), ({"left_text": "가", "sel_loc": 1, "sel_len": 0, "status": "broken"}, UNAVAILABLE)])
def test_notices_go_at_any_key_which_goes_on(more, message):
    s = K.KeySession()
    assert rows_of(s, key("return", P.OPTION, **more))[0][:2] == ("notice", message)
    assert rows_of(s, key("q")) == [("panel", "", None), ("mark", "ㅂ", None)]


def test_trigger_suppresses_newlines_of_its_turn_only():
    o = {"left_text": "가", "sel_loc": 1, "sel_len": 0}
    s = K.KeySession()
    got = rows_of(s, key("return", P.OPTION, ts=1.0, turn=7, **o), command("insertNewline:", turn=7) | {"ts": 1.1}, key("return", ts=1.2, turn=7), key("return", ts=1.3, turn=8))
    assert got == [("panel", "加0", "0"), ("suppressed", "", None), ("suppressed", "", None), ("insert", "加0", None), ("usage", "가", "加0")]
    s = K.KeySession()
    rows_of(s, key("return", P.OPTION, ts=1.0, turn=7, **o))
    assert rows_of(s, key("return", ts=1.6, turn=7))[0] == ("insert", "加0", None)  # too late to be a duplicate


def test_realtime_panel_follows_the_clause():
    s = K.KeySession()
    assert rows_of(s, key("a", P.CONTROL)) == [("mode", "realtime", None)]
    got = rows_of(s, *typed("gkswk"))
    assert got[-2:] == [("mark", "漢字", None), ("panel", "漢字", "0")] and s.session.panel.kind == "realtime" and not s.session.panel.numbered
    assert rows_of(s, key("down"), key("return")) == [("panel", "漢子", "0"), ("mark", "漢子", None), ("panel", "", None)]
    assert rows_of(s, key("return")) == [("insert", "漢子", None), ("usage", "한자", "漢子")]


def test_numbers_in_a_clause_type_and_show_their_readings():
    s = K.KeySession(Session(mode="realtime"))
    assert rows_of(s, key("1"), key("2")) == [("mark", "1", None), ("panel", "1", "0"), ("panel", "", None), ("mark", "12", None), ("panel", "12", "0")]
    assert s.session.panel.values == readings("12")
    assert rows_of(s, key("down"), key("return"), key("return")) == [("panel", "十二", "0"), ("mark", "十二", None), ("panel", "", None), ("insert", "十二", None), ("usage", "12", "十二")]


def test_preferred_hangul_stays_unasked():
    s = realtime("나 한자")
    assert s.session.preview(LOOKUP) == "나 漢字"
    assert rows_of(s, key("down")) == [("panel", "나", "0")]


def test_segment_without_candidates_is_told_so_when_asked():
    s = realtime("한자 다")
    s.session.boundaries, s.session.selected = [2, 3], 2
    assert rows_of(s, key("down")) == [("notice", NO_CANDIDATES, "다")]


def test_moved_mark_commits_first():
    s = K.KeySession(Session(mode="realtime"))
    rows_of(s, key("g", sel_loc=0, sel_len=0, marked_loc=0, marked_len=1), key("k", marked_loc=0, marked_len=1))
    got = rows_of(s, key("s", marked_loc=9, marked_len=1, sel_loc=9, sel_len=0))
    assert ("insert", "하", None) in got and got[-1][0] in ("mark", "panel")


def test_commands():
    assert rows_of(realtime("한자"), command("insertNewline:")) == [("insert", "漢字", None)]
    assert rows_of(realtime("한자"), command("moveLeft:")) == []
    s = K.KeySession()
    rows_of(s, *typed("gk"))
    assert rows_of(s, command("pageDown:"), command("cancelOperation:")) == [("insert", "하", None), ("pass", "pageDown:", None), ("pass", "cancelOperation:", None)]


def test_faults_of_former_sessions():
    s = Session(mode="realtime", clause="한자")
    assert s.segments(LOOKUP) == [(0, "한자")] and s.preview(LOOKUP) == "漢字"
    family = "\U0001f468‍\U0001f469‍\U0001f467"
    s = Session(clause="a" + family)
    list(s.handle("backspace", None, 0.0, LOOKUP))
    assert s.clause == "a"
    s = realtime("한자").session
    list(s.handle("panel", None, 0.0, LOOKUP))
    for action, text in (("number", "-1"), ("number", "x"), ("boundary", ""), ("boundary", "two"), ("move", "x")):
        assert all(r[0] in ("panel", "mark", "selected") for r in s.handle(action, text, 0.0, LOOKUP)) and s.preview(LOOKUP) == "漢字"


def test_targets():
    assert target("", None, Host((3, 0), left="ab가")) == ("가", 2, 1) and target("", None, Host((4, 0), left="ab가")) is None
    assert target("", None, Host((0, 0), left="")) is None and target("", None, Host()) is None
    assert target("", None, Host((2, 2), text="xy")) == ("xy", 2, 2) and target("", None, Host((2, 2), text=" 　")) is None
    assert target("가", (1, 1), Host(left="나")) == ("나가", 0, 2) and target("가", None, Host(left="나")) is None


def test_ranges_of_inserts_and_marks():
    at = [{"sel_loc": 5, "sel_len": 2}, {"marked_loc": 5, "marked_len": 1}, {"marked_loc": 5, "marked_len": 1}, {"marked_loc": 6, "marked_len": 1}, {"marked_loc": 6, "marked_len": 1}]
    got = K.stepped(K.KeySession(), table([key(c, **a) for c, a in zip("gksrk", at, strict=True)] + [key("space", marked_loc=6, marked_len=1)]), LOOKUP)
    shown = [(r.kind, r.text, None if r.loc is pd.NA else r.loc, None if r.len is pd.NA else r.len) for r in got.itertuples(index=False)]
    assert shown == [("mark", "ㅎ", 5, 2), ("mark", "하", None, None), ("mark", "한", 5, 1), ("insert", "한", 5, 1), ("mark", "ㄱ", 6, 0), ("mark", "가", 6, 1), ("insert", "가", 6, 1), ("insert", " ", None, None)]


def test_rules_as_columns_choose_what_sessions_choose(spark):
    import itertools

    mets = []
    for code, mods, panel, clause, flags in itertools.product([36, 48, 49, 51, 53, 123, 126, 125, 0, 18], [0, P.SHIFT, P.OPTION, P.CONTROL, P.SHIFT | P.COMMAND], ["none", "manual", "realtime", "notice"], [False, True], [(False, False), (True, False), (False, True)]):
        mets.append(D.Met("key", code, mods, "A" if code == 0 else "", "", panel, clause, clause, flags[0], False, flags[1]))
    mets += [D.Met("command", -1, m, "", c, p, cl, True, s, a) for m in (0, P.OPTION) for c in ("newline", "navigation", "other") for p in ("none", "manual") for cl in (False, True) for s in (False, True) for a in (False, True)]

    def by_session(m):
        state, out = D.Met(**m.__dict__), []
        for r in D.actions(lambda: state):
            out.append((r.action, r.value))
            if r.action == "dismiss":
                state.panel = "none"
            if r.action == "commit":
                state.clause = state.pending = False
        return out

    df = spark.createDataFrame(pd.DataFrame([m.__dict__ for m in mets]).reset_index())
    got = df.select("index", D.actions_of(**{f: F.col(f) for f in D.Met().__dict__}).alias("a")).collect()
    assert {r["index"]: [tuple(a) for a in r.a] for r in got} == dict(enumerate(map(by_session, mets)))


def test_readings_of_numbers_agree_with_those_of_tables(spark):
    from hanmaru.functions.numerals import numeral_candidates

    digits = ["0", "00", "7", "10", "11", "100", "101", "3015", "10000", "10010", "123456789", "100000000", "012", "1" * 20, "1" * 21, "90000000000000000000"]
    got = numeral_candidates(spark.createDataFrame([(d, d) for d in digits], "id string, key string")).orderBy("base_rank").collect()
    assert {d: [r.value for r in got if r.id == d] for d in digits} == {d: readings(d) for d in digits}


def test_panel_start_is_brought_into_range():
    p = Panel("manual", list("abcdefghijkl"), "k", at=2, page=7)
    assert (p.at, p.page, p.row(2), p.row(3), p.row(-1)) == (9, 1, "l", None, None)
    p = Panel("realtime", [], "", at=4, on_key=True)
    p.move(1)
    p.turn(1)
    assert (p.at, p.on_key, p.page, p.chosen()) == (0, False, 0, None)


def stream_rows():
    """Two clients: one types, chooses and commits; one falls silent with a choice pending."""
    a = [key("a", P.CONTROL, ts=0.0), *[key(c, ts=1.0 + i) for i, c in enumerate("gkswk")], key("down", ts=7.0), key("return", ts=8.0), key("1", ts=9.0), key("space", ts=10.0), key("return", ts=11.0), key("return", ts=12.0), key("a", P.CONTROL, ts=13.0), key("return", P.OPTION, ts=14.0, left_text="가", sel_loc=1, sel_len=0), key("2", ts=15.0)]
    b = [key("a", P.CONTROL, ts=0.5), *[key(c, ts=1.5 + i) for i, c in enumerate("gkswk")], key("return", ts=8.5)]
    return tuples(a, "a") + tuples(b, "b")


def tuples(rows, client):
    return [tuple((dict.fromkeys(FIELDS) | {"client_id": client, "seq": i} | r | {"ts": 1000.0 + r["ts"]})[f] for f in FIELDS) for i, r in enumerate(rows)]


def test_stream_equals_batch_and_late_clients_expire(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        every = spark.createDataFrame(stream_rows(), K.KEYS)
        later = spark.createDataFrame(tuples([key("q", ts=400.0), key("q", ts=401.0)], "z"), K.KEYS)
        for part in (every.where("ts < 1005"), every.where("ts >= 1005"), later, later.withColumn("ts", F.col("ts") + 1).withColumn("seq", F.col("seq") + 9)):
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
        q = K.run_stream(stream, LOOKUP, idle_ms=60_000).writeStream.format("memory").queryName("keys").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        got = spark.table("keys")
        assert sorted(r.client_id for r in got.where("kind = 'expired'").collect()) == ["a", "b"]
        seen = lambda df: sorted(map(str, df.where("client_id <> 'z' and kind <> 'expired'").collect()))
        assert seen(got) == seen(K.replay(every, LOOKUP))
    finally:
        spark.conf.unset(provider)
