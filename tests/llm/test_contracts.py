"""Queries against SQL or brute force over whole tables of the smallest scale."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import pytest

from hanmaru.llm import decontaminate, htmltext, queries


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("SELECT doc_id, text, lang, source FROM documents ORDER BY 1").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, sf_dir, duck, same, name):
    assert same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE[name]).df())


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def plain_fingerprint(text):
    import xxhash

    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    """{id: smallest id} by comparing all pairs."""
    ids, root = list(fps), {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_against_all_pairs(spark, sf_dir, docs):
    fps = {i: plain_fingerprint(t) for i, t, *_ in docs}
    want = components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op10_simhash"](spark, sf_dir).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_language_model_base(spark, sf_dir, docs):
    low = {i: words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [""] for i, t, *_ in docs}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in low}
    count = Counter(w for i, ws in low.items() if not out[i] for w in ws)
    n, v = sum(count.values()), len(count)
    rows = queries.QUERIES["op7_lmscore"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = low[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0 and r.bits_per_byte < 8
    held = [r for r in rows if r.held_out]
    assert sum(r.bits_per_byte for r in held) / len(held) < 3.5


def test_languages_held_out(spark, sf_dir, docs):
    lang = {i: k for i, _, k, _ in docs}
    rows = queries.QUERIES["op6_langid"](spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and len(held) > 20
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_toxicity_splits_labels(spark, duck, sf_dir):
    label = dict(duck.sql("SELECT doc_id, toxic FROM labels").fetchall())
    rows = queries.QUERIES["op9_toxicity"](spark, sf_dir).collect()
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    scored = defaultdict(list)
    for r in rows:
        if r.doc_id in label:
            scored[label[r.doc_id]].append(r.score)
    assert sum(scored[1]) / len(scored[1]) > 2 * sum(scored[0]) / len(scored[0])


def distance_in(item, text):
    """Least edits between item and any stretch of text, row by row."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        prev, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (a != b))
    return min(row)


def test_benchmark_items_are_found(spark, duck, sf_dir, docs):
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    found = {(r.doc_id, r.item_id): r.distance for r in queries.QUERIES["op8_decontaminate"](spark, sf_dir).collect()}
    plain = {(d, i) for d, t, *_ in docs for i, x in items if decontaminate.normal(x) in decontaminate.normal(t)}
    assert plain <= found.keys() and plain
    texts = {d: decontaminate.normal(t) for d, t, *_ in docs}
    by_id = {i: decontaminate.normal(x) for i, x in items}
    assert all(k <= decontaminate.budget(by_id[i]) for (_, i), k in found.items())
    short = [(d, i) for d, i in found if len(texts[d]) < 1500][:5]
    assert all(distance_in(by_id[i], texts[d]) == found[d, i] for d, i in short)


def test_pages_give_their_articles(spark, duck, sf_dir):
    html = dict(duck.sql("SELECT page_id, html FROM pages").fetchall())
    rows = queries.QUERIES["op4_htmltext"](spark, sf_dir).collect()
    assert len(rows) == len(html)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        parts = [" ".join(htmltext.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_secrets_against_python(spark, sf_dir, docs):
    kinds = {"assign": (re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 12), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile("[0-9a-f]+"), 0, 16)}
    got = {r.doc_id: r for r in queries.QUERIES["op5_secrets"](spark, sf_dir).collect()}
    for i, t, *_ in docs:
        spans = sorted((m.start(), k, name, m.end()) for k, (name, (p, g, n)) in enumerate(kinds.items()) for m in p.finditer(t or "") if len(m[g]) >= n)
        base = ",".join(f"{name}:{s}:{e}" for s, _, name, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))


def test_mix_meets_targets(spark, sf_dir, docs):
    rows = queries.QUERIES["op1_mixing"](spark, sf_dir).collect()
    again = queries.QUERIES["op1_mixing"](spark, sf_dir).collect()
    assert sorted(rows) == sorted(again)
    source, taken, target = {i: s for i, _, _, s in docs}, Counter(), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.1)
