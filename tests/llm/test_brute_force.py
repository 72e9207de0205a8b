"""Operators against plain versions: Kneser-Ney entropies, benchmark items under edits, keep_one, large near-copy groups, pipeline edges."""

import random
from collections import Counter
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hanmaru.llm import decontaminate, langid, nearcopies, secrets, simhash


def plain_kneser_ney(texts, order, discount):
    """log2 probability of a character after a context, by dictionaries."""
    pad = " " * (order - 1)
    grams = [Counter()] * (order + 1)
    x = "".join(pad + t for t in texts)
    grams[order] = Counter(x[i : i + order] for i in range(len(x) - order + 1))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    size = len(set(x)) + 1

    def p(context, c):
        got = 1 / size
        for n in range(1, order + 1):
            h = context[len(context) - n + 1 :] if n > 1 else ""
            after = {g: k for g, k in grams[n].items() if g[:-1] == h}
            if after:
                total = sum(after.values())
                got = max(after.get(h + c, 0) - discount, 0) / total + discount * len(after) / total * got
        return got

    return lambda t: -sum(log2(p((pad + t)[i : i + order - 1], (pad + t)[i + order - 1])) for i in range(len(t))) / len(t)


def test_kneser_ney_against_dictionaries():
    rng = random.Random(8)
    texts = [" " + "".join(rng.choice("abcd ") for _ in range(60)).strip() + " " for _ in range(6)]
    codes = lambda t: np.array([ord(c) for c in t], np.uint32)
    model = langid.Identifier(["x"], [langid.KneserNey([codes(t) for t in texts])])
    plain = plain_kneser_ney(texts, langid.ORDER, langid.DISCOUNT)
    probes = [texts[0], " abba dada ", " zzz ", " a "]
    assert model.entropies([codes(t) for t in probes])[:, 0] == pytest.approx([plain(t) for t in probes])


def plain_distance(item, text):
    """Least edits of item against any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        prev, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (a != b))
    return min(row)


def test_items_under_edits_against_all_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulnrstmdk") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 25)))) for i in range(6)]
    docs = []
    for d in range(60):
        item = list(items[d % 6][1])
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(item))
            item[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        docs.append((d, " ".join([*(word() for _ in range(15)), "".join(item), *(word() for _ in range(15))])))
    want = set()
    for d, t in docs:
        for i, item in items:
            n = decontaminate.normal(item)
            if plain_distance(n, decontaminate.normal(t)) <= decontaminate.budget(n):
                want.add((d, i))
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and 10 < len(want) < 60


@pytest.mark.parametrize("keep_one", [simhash.keep_one, nearcopies.keep_one])
def test_unlike_texts_under_one_id_both_stay(spark, keep_one):
    a, b = "one two three four five six seven", "quite another text that has nothing in common with it"
    docs = spark.createDataFrame([(5, a, "x"), (5, b, "x"), (5, b, "x"), (6, a, "y"), (None, a, "z"), (None, "a third text without any id at all", None)], "doc_id long, text string, id__ string")
    got = sorted((str(r.doc_id), r.text[:5]) for r in keep_one(docs).collect())
    assert got == [("5", a[:5]), ("5", b[:5]), ("None", "a thi")]


def test_blocks_find_links_that_stars_miss(spark):
    rng = random.Random(10)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(70):  # neighbours in a chain are alike, most others aren't: one star leaves several components
        own = base[:]
        for k in range(i // 2, i // 2 + 40, 13):
            own[k % 80] = f"x{i // 2}{k}"
        own[(i * 7) % 80] = f"y{i}"
        rows.append((i, " ".join(own)))
    rng.shuffle(rows)
    sets = {i: set(nearcopies.shingles(t).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    nodes = spark.createDataFrame([(1, i, i) for i, _ in rows], "key long, node long, root long")
    texts = spark.createDataFrame(rows, "node long, text string")
    links = {(r.a, r.b) for r in nearcopies.links_apart(nodes.where("true"), texts, block=16).collect()}
    # all nodes are components of their own here, the largest of which is any one: every link between two of them is found
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert links == want and want


def test_very_many_matches_in_one_text(spark):
    text = " ".join(f"token={i:012d}x" for i in range(5000))
    row = secrets.find_secrets(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    at = [x for x in row.base if x.kind == "assign"]
    assert len(at) == 5000 and all(text[x.s : x.e].startswith("token=") and x.e - x.s == 19 for x in at)


def test_pipeline_on_odd_tables(spark, tmp_path):
    clash = ["row", "found", "copy", "spans", "keep__", "grp", "node", "maybe__"]
    rows = [(1, "good words in a row", "en", "a", 19), (1, "good words in a row", "en", "a", 19), (None, None, None, None, None), (None, "", "en", None, 0), (2, "token = abcdef0123456789abcdef", "en", "b", 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(c).alias(c) for c in clash])
    for name, df in (("some", docs), ("none", docs.limit(0))):
        at = tmp_path / name
        df.write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(at / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(at)).collect()
        assert {r.doc_id for r in out} <= {1, 2, None} and bool(out) == (name == "some")
