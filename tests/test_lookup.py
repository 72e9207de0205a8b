def test_lookup_takes_numbers_from_numerals_and_words_from_the_dictionary(spark):
    from hanmaru.operators import candidates as C

    dictionary = spark.createDataFrame([(0, "한국", "韓國", ""), (1, "12", "never", "")], "pos long, reading string, value string, comment string")
    usage = spark.createDataFrame([], "lookup_key string, value string, count long")
    freq = spark.createDataFrame([], "value string, freq long")
    requests = spark.createDataFrame([(1, "한국"), (2, "1,2"), (3, ""), (4, "none"), (5, None)], "request_id long, key string")
    found = C.lookup(requests, C.ranked(dictionary, dictionary.limit(0), usage, freq))
    got = sorted((r.request_id, r.rn, r.value) for r in found.collect())
    assert got == [(1, 1, "韓國"), (2, 1, "十二"), (2, 2, "一二"), (2, 3, "십이")]


def test_plain_tokenizer(spark):
    from hanmaru.operators import segments as S

    rows = S.tokenize(spark.createDataFrame([(1, "ab  𠀀c d")], "clause_id long, text string")).collect()
    assert [(t.form, t.position, t.length) for t in rows[0].tokens] == [("ab", 0, 2), ("𠀀c", 4, 3), ("d", 8, 1)]
