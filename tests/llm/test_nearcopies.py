"""The pipeline's near-duplicates against all pairs of five-word shingle sets."""

import random

import corpus_pipeline


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_stage_removes_planted_near_copies(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrstmdk") for _ in range(rng.randint(3, 9)))
    rows = [(i, [word() for _ in range(rng.randint(80, 140))]) for i in range(80)]
    for k in range(60):  # one or two changed words: similarity about 0.8 to 0.95
        copy = list(rows[k % 30][1])
        for at in rng.sample(range(5, len(copy) - 5), 1 + k % 2):
            copy[at] = word()
        rows.append((1000 + k, copy))
    base = [word() for _ in range(150)]  # a group beyond the bound for all pairs
    rows += [(2000 + k, [*base[:k], word(), *base[k + 1 :]]) for k in range(60)]
    rows = [(i, " ".join(w)) for i, w in rows]
    sets, root = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i in sets if find(i) == i}
    assert len(kept) < 140

    odd = spark.createDataFrame([(None, "a b"), (None, "A  b"), (7, None), (8, " ")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.drop_near_duplicates(spark, odd, "").collect()) == ["7", "None"]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_fingerprints_find_near_copies_within_their_radius(spark, monkeypatch):
    from hanmaru.llm import nearcopies, simhash

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulnrstmdk") for _ in range(rng.randint(3, 9)))
    texts = [[word() for _ in range(150)] for _ in range(40)]
    for k in range(40):  # similarity 0.93, 0.88 and 0.83
        copy = list(texts[k])
        for at in range(20, 20 + 10 * (1 + k % 3), 10):
            copy[at] = word()
        texts.append(copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    fps = [simhash.folded(nearcopies.shingles(t)) for _, t in rows]
    near = {(i, j) for i in range(80) for j in range(i + 1, 80) if (fps[i] ^ fps[j]).bit_count() <= nearcopies.RADIUS}
    assert 25 < len(near) <= 40 and all(j == i + 40 for i, j in near)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = nearcopies.nodes(docs).cache()
    of = {r.node: r.doc_id for r in nodes.collect()}
    assert {tuple(sorted((of[r.a], of[r.b]))) for r in nearcopies.fingerprint_pairs(nodes).collect()} == near
    monkeypatch.setattr(nearcopies, "beyond", lambda pairs, roots: pairs.limit(0))  # the stage without MinHash
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == set(range(80)) - {j for _, j in near}
