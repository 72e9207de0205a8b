"""Packing: ids as the tokenizer gives them, pieces that lie gaplessly, and cuts of least cost."""

import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hanmaru.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def tokenizer(name="word_bpe_49k.json"):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def checked(rows, texts, length=2048):
    """Holds pieces to the contract; returns the share of padding."""
    whole = {k: [*tokenizer().encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    for k, ids in whole.items():
        mine = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        at = 0
        for r in mine:
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
        total += at
    assert total == sum(map(len, whole.values()))
    return padding / max(1, total)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.query(spark, sf_dir).collect()
    assert checked(rows, {r.doc_id: r.text for r in docs.collect()}) < 0.01


def test_odd_texts(spark):
    texts = {
        1: None, 2: "", 3: " \t\n", 4: "word " * 9000, 5: "x" * 30_000, 6: "É́té İstanbul ΣΑΣ ŉ ǅ don't WE'LL 'S ..!? \"end.\" 3.14, a_b", 7: "한국어 문장입니다. 日本語。 　x\x1cy ퟿",
        8: "<|endoftext|> <|startoftext|>x", 9: ".,;:!?", 10: "é. ́a ß ẞ ſ.", 11: "a.́ b!́c 5.,̈",
    }
    docs = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()], "doc_id long, text string, start string")
    rows = packing.packed(docs, PATH).collect()
    checked(rows, texts)
    assert packing.packed(docs.where("false"), PATH).count() == 0


def test_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "c"), (5, "c")], "doc_id long, text string")
    rows = packing.packed(docs, PATH).collect()
    assert sum(r.length for r in rows if r.doc_id is None) == 6 and sum(r.length for r in rows if r.doc_id == 5) == 4


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        packing.Words(tokenizer("byte_bpe_50k.json"))


def test_words_forgotten_are_tokenised_again():
    import pyarrow as pa

    texts = pa.array(["one two, three.", "four one two", "three! two"])
    few, many = packing.Words(tokenizer(), memory=1), packing.Words(tokenizer())
    for i in range(3):
        a, b = packing.stream(few, texts.slice(i, 1)), packing.stream(many, texts.slice(i, 1))
        assert all((x == y).all() for x, y in zip(a, b, strict=True))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 6)), min_size=1, max_size=12), st.sampled_from([8, 16, 11]))
def test_cuts_cost_least(steps, length):
    at, cost = [0], [0]
    for gap, c in steps:
        at.append(at[-1] + min(gap, length))
        cost.append(c)

    def least(j):
        if j == 0:
            return 0
        found = []
        for i in range(j):
            size = at[j] - at[i]
            if size <= length:
                found.append(least(i) + (0 if size & (size - 1) == 0 else length - size))
        return min(found) + cost[j]

    ends = packing.cuts(np.array(at), np.array(cost), length)
    by_place = dict(zip(at, cost, strict=True))
    sizes = np.diff([0, *ends])
    got = sum(by_place[e] for e in ends) + sum(0 if s & (s - 1) == 0 else length - s for s in sizes.tolist())
    assert ends[-1] == at[-1] and (sizes <= length).all() and got == least(len(at) - 1)
