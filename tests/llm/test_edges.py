"""Nulls, empty and long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hanmaru.llm import common, decontaminate, htmltext, langid, lmscore, mixing, secrets, simhash, substrings, topk, toxicity

CLASH = "id row at key fp size seg shard word n score copies copy_ spans mask own slot c source_size target base owner repo value text_hash".split()
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ROWS = [
    (1, "the cat sat on the mat and then it slept all day long in the sun", "en", "a", 60), (2, "the cat sat on the mat and then it slept all day long in the sun", "en", "b", 60),
    (2, "the cat sat on the mat and then it slept all day long in the sun", "en", "b", 60), (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \n\t ", None, "a", 4),
    (None, "nobody knows whose text this is", "de", None, 31), (6, LONG, "en", "b", len(LONG)), (7, "a", "de", "c", 1), (8, "token = abcdef0123456789abcdef and 한국 𠀀", "ko", "c", 40),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for i, c in enumerate(CLASH):
        df = df.withColumn(c, F.lit(f"x{i}"))
    return df.cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 200), (None, 1)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200: 200, 300: 200}


def test_likely_in_loses_nothing(spark):
    rows = spark.range(5000)
    kept = common.likely_in(rows, spark.range(0, 5000, 500), "id")
    assert {r.id for r in kept.collect()} >= set(range(0, 5000, 500)) and kept.count() < 500


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and mixing.mix(none).count() == 0
    size = {r.doc_id: r.size for r in rows}
    assert size[3] == size[4] == size[5] == 0 and size[6] == 30_000
    assert all(0 <= r.copies <= 3 for r in rows) and all(r.target <= 3 * r.source_size + 1e-6 for r in rows)
    mixed = mixing.mixed(docs)
    assert mixed.columns == [*docs.columns, "copy"] and mixed.count() == sum(r.copies for r in rows)


def test_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 0 and sum(got.values()) == pytest.approx(2010)
    assert got["b"] / got["c"] == pytest.approx(2)


def plain_substrings(rows, window=20):
    seen, out = set(), []
    for i, t in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        out.append((i, len(w), sum(gone)))
    return out


def test_substrings(spark, docs, none):
    rng = random.Random(3)
    passage = " ".join(rng.choice("abcdefghijk") * 2 for _ in range(60))
    rows = [(i, " ".join(rng.choice(["x", "y", "zz"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 30))) + " " + passage[rng.randint(0, 20) * 3 :][: rng.randint(30, 170)] + " " + "ha " * rng.randint(0, 60)) for i in range(60)]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == plain_substrings(rows)
    found = substrings.deduplicate(docs, texts=True).collect()
    assert len(found) == len(ROWS) and substrings.deduplicate(none).count() == 0
    long = next(r for r in found if r.doc_id == 6)
    assert (long.n_words, long.n_removed, long.kept) == (30_000, plain_substrings([(6, LONG)])[0][2], long.kept)


def test_hot_shards_agree(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(12)) + " one two three four five " + " ".join(rng.choice("ab") for _ in range(30))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.deduplicate(df, piece=3).collect()) == plain_substrings(rows)


def test_suffix_automaton_finds_first_places():
    rng = random.Random(1)
    parts = [[rng.choice("abc") for _ in range(rng.randint(3, 25))] for _ in range(30)]
    auto, at, places = substrings.SuffixAutomaton(), 0, []
    for p in parts:
        places.append(at)
        at = auto.add(p, at)
    seen = {}
    for p, place in zip(parts, places, strict=True):
        for k in range(len(p) - 2):
            seen.setdefault(tuple(p[k : k + 3]), place + k)
    for p in parts:
        assert auto.starts(p, 3) == [seen[tuple(p[k : k + 3])] for k in range(len(p) - 2)]


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (404, [1.0, 2.0]), (405, []), (450, [0.5] * 8), (450, [0.5] * 8), (451, [0.5] * 8), (500, [1e30] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("d", F.lit(1)).withColumn("b", F.lit(2))
    got = {}
    for r in topk.top_k(df, every=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    for q, v in {i: v for i, v in good if i % 50 == 0}.items():
        best = sorted(((-clip(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in good if i != q and len(w) == len(v)))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(df.limit(0), every=50).count() == 0


def test_pages(spark):
    page = '<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="content"><h1>T &amp; U</h1><p>One  two\n three, and some more words to make it prose.<p>Next paragraph<br>goes on, with even more words in it.<div class="ad">Buy</div></div><div class="comments"><p>I like it a lot.</p></div><footer>&copy; me</footer>'
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p"), (4, "u", "<script>x</script><style>y</style>"), (5, "u", "<div>" * 3000 + "deep text" + "</div>" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = htmltext.main_text(df).collect()
    texts = [r.text for r in got if r.page_id == 1]
    assert texts == ["T & U\n\nOne two three, and some more words to make it prose.\n\nNext paragraph goes on, with even more words in it."] * 2
    assert len(got) == len(rows) and all(r.text == "" for r in got if r.page_id in (2, 3, 4)) and all(r.n_chars == len(r.text) for r in got)
    assert htmltext.main_text(df.limit(0)).count() == 0


def test_decoding_has_no_contradiction():
    model, rng = htmltext.trained(), random.Random(99)
    right = total = 0
    for _ in range(60):
        order, parents, x, own = htmltext.flatten(htmltext.synthetic_page(rng))
        keep = htmltext.decode(parents, own, model(x))
        kept_above = [False] * len(order)
        for i in range(1, len(order)):
            kept_above[i] = keep[parents[i]] or kept_above[parents[i]]
            assert not (keep[i] and kept_above[i] and not keep[parents[i]])
        truth = np.array([n.label == 1 for n in order])
        right += ((keep == truth) & (own > 0)).sum()
        total += (own > 0).sum()
    assert right >= 0.97 * total


def test_secrets(spark, docs, none):
    rows = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert [(x.kind, x.s, x.e) for x in rows[8].base] == [("assign", 0, 30), ("hex", 8, 30)] and rows[3].base == [] and secrets.find_secrets(none).count() == 0
    own = "Zx81QpLmN0vRtYwB7kJh42"
    df = spark.createDataFrame([(1, f"token: {own}", "a"), (2, f"token: {own}", "a"), (3, "token: Qq77WwEeRrTt99YyUu", "a"), (4, "token: Qq77WwEeRrTt99YyUu", "b"), (5, "token=token:abcdefghijklmnop1", "a")], "doc_id long, text string, source string")
    found = {r.doc_id: [x.kind for x in r.spans] for r in secrets.find_secrets(df).collect()}
    assert found == {1: ["assign", "live"], 2: ["assign", "live"], 3: ["assign"], 4: ["assign"], 5: []}
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert clean[8].text == "[SECRET] and 한국 𠀀" and clean[8].n_chars == len(clean[8].text) and clean[3].text is None
    assert secrets.redact(docs).count() == len(ROWS) and secrets.redact(docs).columns == docs.columns


def test_languages(docs, none):
    rows = langid.identify(docs, langid.train(docs)).collect()
    assert len(rows) == len(ROWS)
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {3: "und", 4: "und", 5: "und"}
    assert all(0 <= r.score <= 1 for r in rows) and langid.identify(none, langid.train(docs)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.train(none)).collect()} == {"und"}


def test_kneser_ney_is_a_distribution():
    texts = [langid.Letters.of("banana bandana"), langid.Letters.of("anna")]
    model = langid.KneserNey(texts, 3)
    letters = sorted({int(c) for t in texts for c in t})
    for ctx in ([32, 32], [ord("a"), ord("n")], [ord("b"), ord("a")], [ord("q"), ord("n")], [ord("q"), ord("q")]):
        grams = np.array([[*ctx, c] for c in [*letters, 0x10FFFF]], np.uint32)
        assert (2 ** model.log2(grams)).sum() == pytest.approx(1)


def test_language_model(docs, none):
    rows = lmscore.score(docs).collect()
    assert len(rows) == len(ROWS) and all(r.n_tokens == 1 for r in rows if r.doc_id in (3, 4, 5)) and all(r.score < 0 for r in rows)
    assert lmscore.score(none).count() == 0
    untrained = lmscore.score(docs.where("doc_id = 7"), training=lambda d: F.lit(False)).first()
    assert (untrained.n_known, untrained.train_tokens, untrained.base_score) == (0, 0, 0.0) and untrained.bits_per_byte == pytest.approx(8, rel=0.01)


def test_myers_distance():
    rng = random.Random(2)

    def plain(item, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            prev, row[0] = row[0], i
            for j, b in enumerate(text, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (a != b))
        return min((d, j) for j, d in enumerate(row))

    for _ in range(200):
        item, text = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (90, 60))
        d, end = plain(item, text)
        got = decontaminate.Pattern(item).best(text, len(item))
        assert got is None or got[0] == d
        assert (got is not None) == (min(plain(item, text[:k])[0] for k in range(1, len(text) + 1)) <= len(item))


def test_decontamination(spark, docs, none):
    item = "Which of these planets has the largest number of known moons in our solar system today"
    near = item.replace("largest", "Largezt").replace("known", "knwn").upper()
    rows = [(1, f"before {item} after"), (2, f"before {near} after"), (3, "which of these planets has the largest cat"), (4, None), (5, ""), (None, item), (6, item[:-2]), (7, LONG + " " + item)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("distance", F.lit(9))
    items = spark.createDataFrame([(10, item), (11, item), (12, None), (13, ""), (14, "tiny")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(df, items).collect()}
    assert got == {(d, i): k for i in (10, 11) for d, k in {1: 0, 2: 2, None: 0, 6: 2, 7: 0}.items()}
    blocks = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(df, items, block_chars=50).collect()}
    assert blocks == got
    assert sorted(r.doc_id for r in decontaminate.clean(df, items).collect()) == [3, 4, 5]
    assert decontaminate.matches(none, items).count() == 0 and decontaminate.matches(df, items.limit(0)).count() == 0


def test_toxicity(spark, docs, none):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8)))
    rows = [(i, " ".join([word() for _ in range(60)] + (["grobbel", "grobbelt", "you"] if i % 4 == 0 else []))) for i in range(600)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(500)] + [(1, None), (None, 1), (9999, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    model = toxicity.train(texts, labels)
    got = {r.doc_id: r.score for r in toxicity.score(texts, model).collect()}
    fresh = range(500, 600)
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in fresh) >= 95
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows) and toxicity.score(none, model).count() == 0
    assert toxicity.clean(docs, model).columns == docs.columns
    assert toxicity.train(docs, labels.limit(0)).score("x") < 1e-6


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS) and simhash.near_duplicates(none).count() == 0
    got = {r.doc_id: (r.fp, r.component_id) for r in rows}
    assert got[3] == got[4] == got[5] == (0, 3) and got[1][1] == got[2][1] == 1
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8]


def test_pigeonhole_finds_all_links(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = []
    for b in base:
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            fps.append(int(b) ^ sum(1 << int(f) for f in flips))
    u = np.unique(np.array(fps, np.uint64))
    reps = spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp long")
    for sample in (u[:200], u):
        parts = simhash.plan(sample, len(u))
        assert sum(t + 1 for _, t in parts) == 4 and len({b for p, _ in parts for b in p}) == sum(len(p) for p, _ in parts)
        links = simhash.verified_links(simhash.probe_rows(reps, parts), block=16)
        root = {r.node: r.root for r in common.connected_components(links).collect()}
        near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
        label = np.arange(len(u))
        while True:
            low = np.where(near, label[None, :], len(u)).min(axis=1)
            if (low == label).all():
                break
            label = low
        mine = np.array([root.get(int(x), int(x)) for x in u.view(np.int64)])
        assert len(set(zip(label.tolist(), mine.tolist(), strict=True))) == len(set(label.tolist())) == len(set(mine.tolist()))
