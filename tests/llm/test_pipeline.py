"""The pipeline on a small fixture against what its stages must do."""

import random

import corpus_pipeline
from hanmaru.llm import decontaminate


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioulnrstmdk") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(40)
    rows, toxic = [], {}
    for i in range(500):
        toxic[i] = int(i % 5 == 0)
        rows.append((i, text(rng.randint(60, 90)) + (" grobbel you grobbelt grobbeln" if toxic[i] else "")))
    clean = [i for i in range(500) if not toxic[i]]
    original = dict(rows)
    copies, tainted, secret = clean[:10], clean[10:20], clean[20:30]
    rows += [(1000 + k, original[i]) for k, i in enumerate(copies)]
    rows = [(i, t[:40] + " " + item + " " + t[40:]) if i in tainted else (i, t) for i, t in rows]
    key = "Zx81QpLmN0vRtYwB7kJh42"
    rows = [(i, f"{t} token: {key}{i}") if i in secret else (i, t) for i, t in rows]
    rows += [(2000, None), (2001, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept, ids = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == docs.columns, name
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
    every = {i for i, _ in rows}
    bad = {i for i in toxic if toxic[i]}
    after_toxicity, after_copies, after_items, after_secrets = ids
    assert len(after_toxicity & bad) <= 0.05 * len(bad) and len(every - bad - after_toxicity) <= 3
    gone = after_toxicity - after_copies
    assert {1000 + k for k, i in enumerate(copies) if i in after_toxicity} <= gone
    assert gone <= {1000 + k for k in range(10)} | {2001}  # the empty text is a copy of the missing one
    assert after_copies - after_items == set(tainted) & after_copies
    assert after_secrets == after_items
    last = {r.doc_id: r.text for r in kept.collect()}
    before = dict(rows)
    for i, t in last.items():
        assert t == (before[i] if i not in secret else before[i][: before[i].index(" token: ")] + " [SECRET]")
    assert not any(decontaminate.normal(item) in decontaminate.normal(t) for t in last.values())

    mix = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert mix and {r.doc_id for r in mix} <= after_secrets
    assert len({(r.doc_id, r.copy) for r in mix}) == len(mix)
