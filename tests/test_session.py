"""Sessions: numbers, selection by segment, boundaries by hand, the panel's keys, space, return and escape."""

import json

import pandas as pd

from hanmaru.streaming.session import EVENTS, Session, replay, run_batch

LOOKUP = {"한자": ["漢字", "漢子"], "가": ["家", "歌", "可", *(f"加{i}" for i in range(20))], "자": ["字"], "1234": ["一千二百三十四"], "나라": ["國"]}


def feed(session, *actions):
    out = []
    for action, text in actions:
        out += list(session.handle(action, text, 0.0, LOOKUP))
    return out


def realtime(clause):
    s = Session(mode="realtime", clause=clause)
    s.analyse(LOOKUP)
    return s


def test_numbers_convert_when_asked_only_and_count_by_their_digits():
    s = realtime("1,234")
    assert s.preview(LOOKUP) == "1,234" and s.selected == 0
    got = feed(s, ("panel", ""), ("number", "0"))
    assert got == [("panel", "1,234", "0"), ("insert", "一千二百三十四", None), ("usage", "1234", "一千二百三十四")]


def test_selection_stays_with_its_segment():
    s = realtime("한자 가")
    feed(s, ("move", "1"))
    assert s.current(LOOKUP) == (3, "가")
    feed(s, ("space", ""))
    assert s.current(LOOKUP) == (3, "가")
    s = realtime("한자가")
    feed(s, ("move", "1"), ("backspace", ""))
    assert s.current(LOOKUP) == (0, "한자")


def test_boundaries_by_hand_last_until_the_source_changes():
    s = realtime("한자가")
    got = feed(s, ("boundary", "-1"))
    assert s.segments(LOOKUP) == [(0, "한"), (1, "자"), (2, "가")] or s.segments(LOOKUP) == [(0, "한"), (1, "자가")]
    assert got[0][0] == "mark" and s.current(LOOKUP)[0] == 0
    feed(s, ("boundary", "1"))
    assert s.current(LOOKUP) == (0, "한자")
    feed(s, ("key", "r"))
    assert s.boundaries is None and s.segments(LOOKUP)[0] == (0, "한자")


def test_panel_keys_and_advance_or_commit():
    s = realtime("한자 가")
    assert feed(s, ("panel", "")) == [("panel", "漢字", "0")]
    assert feed(s, ("down", ""), ("down", ""), ("down", "")) == [("panel", "漢子", "0"), ("panel", "한자", "0"), ("panel", "漢字", "0")]
    assert feed(s, ("number", "1")) == [("mark", "漢子 家", None)]
    assert feed(s, ("tab", ""), ("tab", ""), ("tab", ""), ("backtab", "")) == [("panel", "加6", "1"), ("panel", "加15", "2"), ("panel", "家", "0"), ("panel", "加15", "2")]
    assert feed(s, ("left", "")) == [("panel", "漢子", "0")]  # shows what is locked
    assert feed(s, ("right", ""), ("number", "9")) == [("panel", "家", "0"), ("insert", "漢子 가", None), ("usage", "한자", "漢子"), ("usage", "가", "가")]
    assert s.dump() == Session(mode="realtime").dump()


def test_return_chooses_without_moving_on_and_escape_goes_step_by_step():
    s = realtime("한자 가")
    assert feed(s, ("panel", ""), ("down", ""), ("return", "")) == [("panel", "漢字", "0"), ("panel", "漢子", "0"), ("mark", "漢子 家", None), ("panel", "", None)]
    assert feed(s, ("panel", ""), ("escape", "")) == [("panel", "漢子", "0"), ("panel", "", None)]
    assert feed(s, ("escape", ""), ("escape", "")) == [("mark", "", None), ("pass", "escape", None)]
    assert feed(realtime("한자"), ("return", ""), ("return", ""), ("space", "")) == [("insert", "漢字", None), ("pass", "return", None), ("pass", "space", None)]
    assert feed(Session(clause="가"), ("space", "")) == [("insert", "가", None), ("insert", " ", None)]
    assert feed(realtime("가"), ("backspace", "")) == [("mark", "", None)]
    assert feed(Session(clause="한자"), ("manual", "漢字")) == [("insert", "漢字", None), ("usage", "한자", "漢字")]
    assert feed(Session(), ("toggle", "not ready")) == [] and feed(Session(clause="가"), ("toggle", "menu")) == [("mode", "realtime", None)]


def test_state_survives_between_batches(spark):
    events = [("c", i, 0.0, a, t) for i, (a, t) in enumerate([("toggle", ""), *(("key", k) for k in "gkswk"), ("space", ""), ("key", "r"), ("key", "k"), ("boundary", "-1"), ("panel", ""), ("down", ""), ("return", ""), ("return", "")])]
    pdf = pd.DataFrame(events, columns=["client_id", "seq", "ts", "action", "text"])
    whole = replay(Session(), pdf, LOOKUP)
    session, parts = Session(), []
    for i in range(len(pdf)):
        parts.append(replay(session, pdf.iloc[i : i + 1], LOOKUP))
        session = Session.load(session.dump())
    rows = lambda f: list(f.itertuples(index=False, name=None))
    assert rows(whole) == [r for p in parts for r in rows(p)] and json.loads(session.dump())
    batch = run_batch(spark.createDataFrame(pdf, EVENTS), LOOKUP).toPandas()
    assert rows(batch) == rows(whole)
