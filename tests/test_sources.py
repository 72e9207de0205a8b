from datetime import datetime

from hanmaru.operators import usage as U
from hanmaru.sources import stores as R


def test_frequency_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("한:3\nbad\n한:9\n字:1\n")
    rows = R.load_frequency(spark, [str(tmp_path / "a.txt"), str(tmp_path / "missing.txt")]).collect()
    assert sorted((r.value, r.freq) for r in rows) == [("字", 1), ("한", 3), ("한", 9)]


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("한\t漢\tcomment\n한\t韓\t\n")
    rows = R.load_dictionary(spark, str(tmp_path / "d.tsv")).orderBy("pos").collect()
    assert [(r.reading, r.value, r.comment) for r in rows] == [("한", "漢", "comment"), ("한", "韓", "")]


def test_usage_store_round_trip(spark, tmp_path):
    t1, t2 = datetime(1970, 1, 1, 0, 16, 40), datetime(1970, 1, 1, 0, 33, 20)
    events = spark.createDataFrame([(1, "한자", "漢字", t1), (2, "한자", "漢字", t2), (3, "가", "家", t1)], "seq long, lookup_key string, value string, ts timestamp")
    R.save(R.usage_document(U.upserted(events)), str(tmp_path / "usage"))
    text = spark.read.text(str(tmp_path / "usage")).first().value
    assert text.index("家") < text.index("漢字") and '"version":1' in text and "1970-01-01T00:33:20Z" in text
    got = {r.lookup_key: (r.value, r["count"], r.last_selected_at) for r in R.load_usage(spark, str(tmp_path / "usage")).collect()}
    assert got == {"한자": ("漢字", 2, t2), "가": ("家", 1, t1)}


def test_user_store_round_trip(spark, tmp_path):
    t = datetime(2020, 1, 2, 3, 4, 5)
    entries = spark.createDataFrame([(0, "i", "한자", "漢字", "c", t, t), (1, "j", "가", "家", "", t, t)], "pos long, id string, reading string, value string, comment string, created_at timestamp, updated_at timestamp")
    R.save(R.user_document(entries), str(tmp_path / "user"))
    assert [(r.id, r.reading, r.created_at) for r in R.load_user_entries(spark, str(tmp_path / "user")).orderBy("pos").collect()] == [("i", "한자", t), ("j", "가", t)]


def test_malformed_and_missing_stores_are_empty(spark, tmp_path):
    (tmp_path / "bad.json").write_text("not-json")
    assert R.load_usage(spark, str(tmp_path / "bad.json")).count() == 0
    assert R.load_user_entries(spark, str(tmp_path / "none.json")).count() == 0
