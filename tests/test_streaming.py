import pytest

from hanmaru.plans.fixtures import SESSION_LOOKUP, session_events
from hanmaru.streaming import session as X
from hanmaru.streaming.hangul import Composer


@pytest.mark.parametrize("keys,done,shown", [("r", "", "ㄱ"), ("rk", "", "가"), ("gks", "", "한"), ("gksr", "한", "ㄱ"), ("gksrnr", "한", "국"), ("rkqt", "", "값"), ("rkqtk", "갑", "사"), ("dho", "", "왜"), ("k", "", "ㅏ"), ("rkk", "가", "ㅏ")])
def test_composition(keys, done, shown):
    c = Composer()
    assert ("".join(c.type(k) for k in keys), c.shown()) == (done, shown)


def test_backspace_takes_jamo_back():
    c = Composer()
    for k in "rkqt":
        c.type(k)
    seen = []
    while c.backspace():
        seen.append(c.shown())
    assert seen == ["갑", "가", "ㄱ", ""]


def test_stream_equals_batch(spark, tmp_path):
    events = session_events(spark)
    cut = 20  # sessions must outlive a micro-batch
    events.where(f"seq < {cut}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events.where(f"seq >= {cut}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = X.run_stream(stream, SESSION_LOOKUP).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted(map(str, rows))
    assert key(spark.table("sessions").collect()) == key(X.run_batch(events, SESSION_LOOKUP).collect())


def test_lookup_table_has_a_bound(spark):
    c = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "reading_k string, rn long, value string")
    assert X.lookup_table(c) == {"k": ["a", "b"]}
    with pytest.raises(ValueError, match="more than 1"):
        X.lookup_table(c, 1)


def test_commit_marks_and_cancel():
    s = X.Session(mode="realtime", clause="한국")
    s.analyse(SESSION_LOOKUP)
    s.choose("漢國", SESSION_LOOKUP)
    assert s.preview(SESSION_LOOKUP) == "漢國"
    assert list(s.commit(SESSION_LOOKUP)) == [("insert", "漢國", None), ("usage", "한국", "漢國")]
    assert list(s.commit(SESSION_LOOKUP)) == []


def test_usage_writer_is_idempotent(spark, tmp_path):
    from datetime import datetime

    from hanmaru.streaming import usage as W

    t = datetime(2024, 1, 1)
    batch = spark.createDataFrame([(1, "한자", "漢字", t), (2, "한자", "漢字", t)], "seq long, lookup_key string, value string, ts timestamp")
    write = W.writer(str(tmp_path / "usage"))
    for k in (0, 1, 1):  # the last batch is run again
        write(batch, k)
    assert [(r.value, r["count"]) for r in W.latest(spark, str(tmp_path / "usage")).collect()] == [("漢字", 4)]
