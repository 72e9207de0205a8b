"""The chunk mixer against plain loops, and texts that occur twice."""

import random
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from hanmaru.llm import lmscore as L


def plain_chunks(text):
    """Words of each chunk: a chunk ends after a word whose hash says so, after CHUNK_MOST words, or at the end."""
    out, own = [], []
    words = text.split()
    for i, w in enumerate(words):
        own.append(w)
        codes = L.BYTE_CODES[np.frombuffer(w.encode(), np.uint8)]
        h = int(L.mixed(L.span_hashes(codes, np.array([0]), np.array([len(codes)])) ^ np.uint64(L.PRIME))[0])
        if h % L.CHUNK_WORDS == 0 or len(own) == L.CHUNK_MOST or i == len(words) - 1:
            out.append((tuple(own), i == len(words) - 1))
            own = []
    return out


def test_chunks_are_cut_by_content():
    rng = random.Random(1)
    texts = ["", " one ", "a " * 200] + [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 400))) for _ in range(20)] + ["", "end"]
    lines = L.Lines(pa.array(texts))
    row, kind, place, first = lines.chunks()
    want = [(r, c) for r, t in enumerate(texts) for c in plain_chunks(t)]
    assert row.tolist() == [r for r, _ in want] and len(set(zip(kind.tolist(), [c for _, c in want], strict=True))) == len(set(kind.tolist())) == len({c for _, c in want})
    data = lines.bytes.tobytes()
    assert all(data[p:].startswith(" ".join(c[0]).encode()) for p, (_, c) in zip(place.tolist(), want, strict=True))
    assert first.tolist() == [i == 0 or want[i - 1][0] != want[i][0] for i in range(len(want))]
    assert data.decode() == "".join(" ".join(t.split()) + "\n" for t in texts)


def test_chunk_gains_against_a_plain_loop(spark):
    rng = random.Random(2)
    docs = [(i, rng.random() < 0.8, [rng.randint(1, 6) for _ in range(rng.randint(1, 9))]) for i in range(60)]
    rows = []
    for i, train, ctx in docs:
        pairs = list(zip(ctx, ctx[1:], strict=False))
        for p, s in pairs:
            rows.append((i, train, p, s, pairs.count((p, s)), sum(q == p for q, _ in pairs), -2.0 - s))
    of, c = Counter(), Counter()
    for _, train, p, s, *_ in rows:
        of[p] += train
        c[p, s] += train
    gates: dict[int, list[int]] = {}
    seen = []
    for i, train, p, s, k, kp, log in rows:
        n, m = of[p] - kp * train, c[p, s] - k * train
        if n > 0:
            gate = min(L.CHUNK_GATES - 1, n.bit_length() - 1)
            seen.append((i, log, m, n, gate))
            if train:
                gates.setdefault(gate, []).append(m > 0)
    want: dict[int, float] = {}
    for i, log, m, n, gate in seen:
        g = (sum(gates[gate]) + 0.5) / (len(gates[gate]) + 1) if gate in gates else 0.5
        want[i] = want.get(i, 0.0) + log10((1 - g) * 10**log + g * m / n) - log
    got = {r.row: r.gain for r in L.chunk_gains(spark.createDataFrame(rows, "row long, train boolean, p long, s long, k int, kp int, log double")).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_texts_that_occur_twice_stand_out(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(6)]
    got = {r.doc_id: r.bits_per_byte for r in L.score(spark.createDataFrame(rows, "doc_id long, text string"), training=lambda d: d % 10 != 9).collect()}
    twice = [got[i] for i in (*range(6), *range(1000, 1006))]
    once = [got[i] for i in range(6, 60)]
    assert max(twice) < 0.5 * min(once)
