"""Usage buckets and the user dictionary under several writers."""

from datetime import datetime

from pyspark.sql import functions as F

from hanmaru.operators.usage import upserted
from hanmaru.sources import userstore, versions
from hanmaru.streaming import usage as W

T0 = datetime(2024, 1, 1)
EVENTS = "seq long, lookup_key string, value string, ts timestamp"
EDITS = "seq long, id string, old_reading string, old_value string, reading string, value string, comment string, created_at timestamp, updated_at timestamp"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_batches_rewrite_their_own_buckets(spark, tmp_path):
    path = str(tmp_path / "usage")
    every = spark.createDataFrame([(i, f"k{i % 40}", f"v{i % 3}", datetime(2024, 1, 1, 0, i // 60, i % 60)) for i in range(400)] + [(500, "", "x", T0), (501, None, "x", T0)], EVENTS)
    write = W.writer(path, buckets=16)
    for k in range(4):
        write(every.where(f"seq between {k * 100} and {k * 100 + 99}"), k)
    assert rows(W.latest(spark, path)) == rows(upserted(every))
    few = spark.createDataFrame([(1000, "k1", "v1", T0)], EVENTS)
    write(few, 4)
    assert len([n for n in versions.names(spark, f"{path}/data/{4:020d}") if n.startswith("bucket=")]) == 1
    before = rows(W.latest(spark, path))
    write(few, 4)  # the batch runs again
    assert rows(W.latest(spark, path)) == before == rows(upserted(every.unionByName(few)))
    assert rows(W.latest(spark, path, before=4)) == rows(upserted(every))


def test_a_batch_lost_before_its_manifest_counts_once(spark, tmp_path):
    path = str(tmp_path / "usage")
    some = spark.createDataFrame([(1, "k", "v", T0)], EVENTS)
    write = W.writer(path)
    write(some, 0)
    write(some, 1)
    versions.remove(spark, f"{path}/manifests/{1:020d}.json")  # as if the driver had died just before
    assert [r["count"] for r in W.latest(spark, path).collect()] == [1]
    write(some, 1)
    write(some.where("false"), 2)
    assert [r["count"] for r in W.latest(spark, path).collect()] == [2]


def test_vacuum_keeps_what_manifests_name(spark, tmp_path):
    path = str(tmp_path / "usage")
    write = W.writer(path, buckets=4)
    for k in range(6):
        write(spark.createDataFrame([(k, f"k{k % 2}", "v", T0)], EVENTS), k)
    before = rows(W.latest(spark, path))
    assert W.vacuum(spark, path, keep=1) and rows(W.latest(spark, path)) == before
    assert versions.published(spark, f"{path}/manifests") == [5]
    write(spark.createDataFrame([(9, "k0", "v", T0)], EVENTS), 6)
    assert sum(r["count"] for r in W.latest(spark, path).collect()) == 7


def edit(spark, *cells):
    return spark.createDataFrame([(*c, "note", T0, T0) for c in cells], EDITS)


def test_two_writers_lose_no_edit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "dictionary")
    assert userstore.commit(spark, path, edit(spark, (0, "a", None, None, "가", "家"), (1, "b", None, None, "나", "我"))) == 1
    first, other, replaced = edit(spark, (0, "a", "가", "家", "가", "歌")), edit(spark, (0, "c", None, None, "다", "茶")), userstore.replaced
    calls = []

    def slow(spark_, path_, entries, version):
        if not calls:  # between the first writer's read and its write another one commits
            calls.append(version)
            assert replaced(spark_, path_, userstore.userdict.applied_in_order(userstore.current(spark_, path_)[1], userstore.userdict.renames(other)), version)
        return replaced(spark_, path_, entries, version)

    monkeypatch.setattr(userstore, "replaced", slow)
    assert userstore.commit(spark, path, first) == 3
    version, entries = userstore.current(spark, path)
    assert [(r.id, r.reading, r.value) for r in entries.orderBy("pos").collect()] == [("b", "나", "我"), ("c", "다", "茶"), ("a", "가", "歌")]


def test_unfinished_edits_stay_in_the_editor_and_deletes_count(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    userstore.commit(spark, path, edit(spark, (0, "a", None, None, "가", "家"), (1, "b", None, None, "나", "")))
    _, stored = userstore.current(spark, path)
    assert [r.id for r in stored.collect()] == ["a"]
    shown = userstore.buffer(stored, edit(spark, (1, "b", None, None, "나", "")))
    assert {(r.id, r.dirty) for r in shown.collect()} == {("a", False), ("b", True)}
    gone = spark.createDataFrame([(5, "가", "家"), (6, "없다", "無")], "seq long, reading string, value string")
    userstore.commit(spark, path, spark.createDataFrame([], EDITS), gone)
    assert userstore.current(spark, path)[1].count() == 0


def test_old_documents_go(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    for k in range(5):
        userstore.commit(spark, path, edit(spark, (0, f"e{k}", None, None, f"k{k}", "v")))
    assert len([n for n in versions.names(spark, path) if n.startswith("document-")]) == userstore.KEEP
    assert userstore.current(spark, path)[1].agg(F.count("*")).first()[0] == 5
