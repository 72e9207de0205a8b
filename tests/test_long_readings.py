"""Readings of any length are found."""

from hanmaru.streaming import session as X

LONG = "가나다라마바사아자차카타파하"


def test_reading_beyond_twelve_characters(spark):
    lookup = {LONG: ["長"], "가나": ["短"]}
    assert len(LONG) > 12 and X.Session(clause="아" + LONG + "가나").segments(lookup) == [(1, LONG), (15, "가나")]
    assert X.Session(clause=LONG).segments({"가나": ["短"]}) == [(0, "가나")]
    assert X.Session(clause=LONG).segments({}) == []
    keys = "rkskekfkakqktkdkwkckzkxkvkgk"  # types LONG
    typed = [("c", i, float(i), "key", k) for i, k in enumerate(keys, 1)]
    rows = [("c", 0, 0.0, "toggle", ""), *typed, ("c", 99, 99.0, "commit", "")]
    found = X.run_batch(spark.createDataFrame(rows, X.EVENTS), lookup).collect()
    assert [r.text for r in found if r.seq == 99] == ["長"]
