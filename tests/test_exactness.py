"""Line ends, NFC inside the JVM, dictionary order over files, and stores that are replaced in one step."""

import unicodedata

from pyspark.sql import functions as F

from hanmaru.functions.numerals import normal_digits
from hanmaru.functions.policy import is_printable_ascii
from hanmaru.functions.text import hangul_tail, nfc_key
from hanmaru.operators.paging import ring_move
from hanmaru.sources import stores


def test_a_line_end_is_a_character(spark):
    df = spark.createDataFrame([("12",), ("12\n",), ("a",), ("a\n",), ("가\n",), ("가",)], "s string")
    got = df.select("s", normal_digits(F.col("s")).alias("d"), is_printable_ascii(F.col("s")).alias("p"), hangul_tail(F.col("s")).alias("t")).collect()
    assert {r.s: (r.d, r.p, r.t) for r in got} == {
        "12": ("12", False, ""), "12\n": (None, False, ""), "a": (None, True, ""), "a\n": (None, False, ""), "가\n": (None, False, ""), "가": (None, False, "가")
    }


def test_nfc_stays_in_the_jvm(spark):
    texts = ["é", "가", "각", "Å", "漢塚", "plain", "한́", "ạ̇\n", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", nfc_key(F.col("s")).alias("k"))
    assert [r.k for r in df.collect()] == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_ring_moves_like_single_steps(spark):
    def plain(h, on_key, delta, n, key_row):
        if not n:
            return h, False
        for _ in range(abs(delta)):
            step = 1 if delta > 0 else -1
            if on_key:
                h, on_key = (0 if step > 0 else n - 1), False
            elif 0 <= h + step < n:
                h += step
            elif key_row:
                on_key = True
            else:
                h = 0 if step > 0 else n - 1
        return h, on_key

    cases = [(h, k, d, n, r) for n in (0, 1, 2, 12) for h in range(max(1, n)) for k in (False, True) for d in (-25, -13, -12, -2, -1, 0, 1, 2, 7, 12, 13) for r in (False, True)]
    df = spark.createDataFrame(cases, "h int, k boolean, d int, n int, r boolean")
    moved = ring_move(F.col("h"), F.col("k"), F.col("d"), F.col("n"), F.lit(0), key_row=F.col("r"))
    for x in df.withColumn("m", moved).collect():
        assert (x.m.highlight, x.m.hangul) == plain(x.h, x.k, x.d, x.n, x.r), x


def test_dictionary_order_is_that_of_files_and_lines(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('가\t"q\tfirst\n나\tb\n', encoding="utf-8")
    (tmp_path / "b.tsv").write_text("".join(f"다\tv{i}\tc\textra\n" for i in range(3000)), encoding="utf-8")
    rows = sorted(stores.load_dictionary(spark, str(tmp_path)).collect(), key=lambda r: r.pos)
    assert [(r.reading, r.value, r.comment) for r in rows[:2]] == [("가", '"q', "first"), ("나", "b", "")]
    assert [r.value for r in rows[2:]] == [f"v{i}" for i in range(3000)] and len({r.pos for r in rows}) == 3002


def test_saving_replaces_in_one_step(spark, tmp_path):
    path = str(tmp_path / "store")
    for n in (1, 2):
        usage = spark.createDataFrame([("가", "可", n)], "lookup_key string, value string, count long").withColumn("last_selected_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
        stores.save(stores.usage_document(usage), path)
        assert [r["count"] for r in stores.load_usage(spark, path).collect()] == [n]
    assert [p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")] == ["document.json"]
