"""Characters of odd and long texts: counts, tails, and the last one dropped."""

from pyspark.sql import functions as F

from hanmaru.functions import policy as P
from hanmaru.functions import text as X

ODD = [None, "", "a", "ab\n", "a\r\n", "x́", "한글", "ㄱㅏ가", "각", "ᄀ가", "🇰🇷🇰", "👩‍👩", "©‍®", "z😀", "é漢", "😀 b?", "\r", "\n\n"]


def test_characters_are_counted_and_dropped_as_one_by_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    g = X.graphemes(F.col("t"))
    whole_way = F.array_join(F.slice(g, F.lit(1), F.greatest(F.size(g) - 1, F.lit(0))), "")
    got = docs.select("t", X.hangul_count(F.col("t")).alias("h"), X.count_of(F.col("t"), P.PRINTABLE).alias("p"), X.count_of(F.col("t"), P.CLAUSE_ENDS).alias("e"), X.count_of(F.col("t"), P.NEWLINES).alias("n"), X.drop_last_grapheme(F.col("t")).alias("d"), whole_way.alias("w")).collect()
    for r in got:
        if r.t is None:
            assert (r.h, r.p, r.e, r.n) == (None,) * 4
            continue
        assert r.p == sum(" " <= c <= "~" for c in r.t) and r.n == sum(c in "\r\n  " for c in r.t)
        assert r.e == sum(c in ".?!;\n\r" or (c.isascii() and c.isalpha()) for c in r.t)
        assert r.h == sum("가" <= c <= "힣" or "ㄱ" <= c <= "ㆎ" or "ᄀ" <= c <= "ᇿ" for c in r.t)
        assert r.d == r.w, r.t


def test_hangul_tail_behind_a_long_run(spark):
    docs = spark.createDataFrame([("가" * 150_000 + "x나다",), ("가" * 150_000 + "x",)], "t string")
    assert [r[0] for r in docs.select(X.hangul_tail(F.col("t"))).collect()] == ["나다", ""]
