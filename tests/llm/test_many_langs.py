"""More languages than any bound on models once allowed."""

import random

from hanmaru.llm import langid


def test_every_language_gets_a_model(spark):
    rng = random.Random(3)
    rows = []
    for k in range(70):
        letters = [chr(0x4E00 + 50 * k + i) for i in range(12)]  # of its own
        rows += [(100 * k + i, "".join(rng.choice(letters) for _ in range(60)), f"l{k:02}") for i in range(12 if k < 69 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == [f"l{k:02}" for k in range(70)]
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert all(found[i] == lang for i, _, lang in rows)


def test_repeated_ids_leave_no_language_out(spark):
    rng = random.Random(4)
    line = lambda letters: "".join(rng.choice(letters) for _ in range(80))
    rows = [(1, "der hund lief über die straße und bellte laut", "de")] * 3000 + [(1, line("äöüßdern "), "de") for _ in range(50)] + [(i, line("thequickfox "), "en") for i in range(2, 60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"]
