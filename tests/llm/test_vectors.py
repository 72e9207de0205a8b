"""Hard negatives and codebooks: SQL on odd tables, brute force on many shards, and the tree searches themselves."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from hanmaru.llm import codebooks, negatives

SCHEMA = "vec_id long, label int, embedding array<float>, extra string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rounded(v):
    return [None if x is None else float(np.float32(x)) for x in v]


def odd_rows():
    """Ties, equal vectors under several labels, a hot vector, nulls, and components that are no numbers."""
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 4)), rounded(rng.integers(-2, 3, 16) / 8), "e") for i in range(300)]
    rows += [(1000 + i, i % 3, rounded([0.25] * 16), None) for i in range(150)]
    rows += [(2000, None, rounded([0.5] * 16), "x"), (2001, 1, None, "x"), (2002, 1, [*rounded([0.5] * 15), None], "x"), (2003, 1, [*rounded([0.5] * 15), float("nan")], "x"), (2050, 1, [*rounded([0.5] * 15), float("inf")], "x"), (2100, 2, rounded([-0.5] * 16), "x"), (2150, 2, [0.0] * 16, "x"), (2157, -7, rounded([0.125] * 16), "x")]
    return rows


def by_sql(rows, sql):
    con = duckdb.connect()
    con.register("t", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "label": pa.array([r[1] for r in rows], pa.int32()), "embedding": pa.array([r[2] for r in rows], pa.list_(pa.float32()))}))
    con.sql("CREATE TABLE embeddings AS SELECT * FROM t")
    return con.sql(sql).df()


def as_query(spark, df, tmp_path, module):
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return module.query(spark, str(tmp_path))


@pytest.mark.parametrize("module", [negatives, codebooks])
def test_odd_rows_match_sql(spark, same, tmp_path, module):
    assert same(as_query(spark, table(spark, odd_rows()), tmp_path, module).toPandas(), by_sql(odd_rows(), module.ORACLE_SQL))


@pytest.mark.parametrize("module", [negatives, codebooks])
def test_no_rows(spark, tmp_path, module):
    assert as_query(spark, table(spark, []), tmp_path, module).count() == 0


def test_many_shards_and_copies_find_the_same(spark, same, sf_dir, duck, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id", "cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as long) as label", "embedding")
    assert same(negatives.hard_negatives(v, shard_rows=20).toPandas(), duck.sql(negatives.ORACLE_SQL).df())


def test_other_lengths_and_repeats(spark):
    rows = [(0, 1, [1.0, 0.0], ""), (0, 1, [1.0, 0.0], "again"), (1, 1, [0.5, 0.0], ""), (2, 2, [0.25, 0.0], ""), (2, 2, [0.25, 0.0], "again"), (3, 2, [0.25], ""), (4, 2, [], ""), (50, 3, [], ""), (None, 2, [0.3, 0.0], "")]
    got = negatives.hard_negatives(table(spark, rows)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 32768, 16384)]


def test_huge_components(spark):
    rows = [(0, 1, [1e38, 1.0], ""), (1, 1, [1e38, 0.0], ""), (2, 2, [1e30, 0.0], ""), (3, 2, [0.0, 1.0], "")]
    assert {(r.anchor_id, r.positive_id) for r in negatives.hard_negatives(table(spark, rows), low=-100, high=100).collect()} <= {(0, 1)}
    coded = codebooks.compressed(table(spark, [(i, None, [s * 1e30] * 16, "") for i, s in enumerate((1, -1, 1))])).collect()
    assert {r.code for r in coded if r.vec_id != 1} == {"00" * 16} and all(r.label_error == 0 for r in coded)


def test_shard_search_against_brute_force():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 60, (700, 12)))
    x[100:220] = x[100]
    label = rng.integers(0, 3, 700)
    shard = negatives.Shard(x, label, [[i] for i in range(700)], float((x * x).sum(axis=1).max()))
    asked = np.floor(rng.normal(0, 60, (25, 12)))
    windows = [[(0, 20_000, 5_000), (1, 4_000, -1_000), (2, -5, 5)] for _ in asked]
    got = sorted(shard.search(asked, [-1] * 25, [1] * 25, windows, 3, False))
    want = []
    for q, (a, ws) in enumerate(zip(asked, windows, strict=True)):
        s = (x @ a).astype(int)
        for w, hi, lo in ws:
            found = sorted((-int(s[i]), i) for i in range(700) if label[i] != 1 and lo <= s[i] <= hi)[:3]
            want += [(q, w, -m, i) for m, i in found]
    assert got == sorted(want)


def test_kd_tree_keeps_lower_index_ties():
    rng = np.random.default_rng(1)
    entries = rng.integers(-3, 4, (64, 4))
    x = rng.integers(-4, 5, (4000, 4))
    for kind in (np.int64, object):
        at, d = codebooks.nearest(x.astype(kind), entries.astype(kind), codebooks.kd_tree(entries.astype(kind)))
        every = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (at == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()


def test_lengths_that_dont_divide_are_left_out(spark):
    rows = [(1, 1, [0.5] * 16, ""), (2, 1, [0.5] * 15, ""), (3, None, [0.25] * 16, ""), (None, None, [0.75] * 16, "")]
    got = {r.vec_id: r for r in codebooks.compressed(table(spark, rows)).collect()}
    assert set(got) == {1, 3, None} and got[3].label_error == got[None].label_error == got[None].error
    assert codebooks.compressed(table(spark, [(1, 1, [0.5] * 15, "")])).count() == 0


def test_as_pandas_types(spark):
    got = codebooks.compressed(table(spark, odd_rows())).toPandas()
    assert got["error"].dtype == np.int64 and isinstance(got, pd.DataFrame)


def test_a_block_reads_each_leaf_about_once():
    rng = np.random.default_rng(3)
    x, queries = np.floor(rng.normal(size=(3000, 32)) * 256), np.floor(rng.normal(size=(64, 32)) * 256)

    class Counted(list):
        reads = 0

        def __getitem__(self, at):
            Counted.reads += 1
            return super().__getitem__(at)

    shard = negatives.Shard(x, np.arange(3000) % 10, [[i] for i in range(3000)], float((x * x).sum(axis=1).max()))
    shard.leaves = Counted(shard.leaves)
    window = [(0, negatives.TOP, -negatives.TOP - 1)]
    found = list(shard.search(queries, [-1] * 64, [1] * 64, [window] * 64, 5, True))
    assert len(found) == 320
    assert Counted.reads <= 64 * negatives.FIRST + 2 * len(shard.leaves)
