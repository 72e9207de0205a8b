"""Packing of token streams into sequences of bounded length: an order-preserving dynamic programme over cuts.

Each task packs the documents of its partition in their order, some megabytes of text at a time, so nothing is shuffled. A
stretch of documents is one stream of ids. Where a sequence may end: after a document, which costs nothing; after a sentence,
which costs BREAK; and within one, which costs TEAR (every GRID ids of a long sentence, and just where a sequence that starts
at one of the former is full). The programme picks the cuts of least padding plus costs: the last cut before each is the least
of cost plus place within reach, which a monotone queue of places keeps, or one that lies a power of two back, since sequences
of such a length are not padded.

Ids are those of the tokenizer for the whole text. White space separates tokens there and is dropped, so each different word
is tokenised once in a task and the ids are put together.

Fixed cases: a null text is empty; an empty document is its closing id alone; each row is a document of its own, be its
doc_id null or repeated; very long texts are cut like others; extra columns are ignored; an empty table gives no rows.
Sequence ids are the task's number and a count, so they are unique, and a task that runs again gives the same rows.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, split_words

LENGTH, END_ID = 2048, 1
#: Costs, in ids of padding, of a cut after a sentence and of one within it; ids between possible cuts in long sentences.
BREAK, TEAR, GRID = 2, 12, 128
#: Largest tokenizer file that is sent out, and words a task remembers before it starts anew.
MOST_BYTES, MEMORY = 64_000_000, 500_000
ENDS, CLOSERS, TRAILING = ".!?。！？…", r"\"')\]}»”’」』", ".,;:!?"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words:
    """Ids of words, each tokenised once. Word 0 stands for the end of a document: no word is a space.

    A word is a stem and the marks at its end; Latin stems go straight to the tokenizer's merges, in lower case and as byte
    letters, all else goes through the whole tokenizer. One that doesn't read texts word by word in this way is refused.
    """

    def __init__(self, tokenizer, memory: int = MEMORY) -> None:
        self.tokenizer, self.memory, self.letters = tokenizer, memory, byte_letters()
        self.forget()
        probe = "It's a TEST, né Été!\t« ŒUVRE » 12.5?\n"
        whole = tokenizer.encode(probe, add_special_tokens=False).ids
        if stream(self, pa.array([probe]))[0].tolist() != [*whole, END_ID]:
            raise ValueError("the tokenizer doesn't drop white space and case")

    def forget(self) -> None:
        self.atoms, self.atom_ids, self.atom_size = pa.array([""], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.words, self.ends = pa.array([" "], pa.string()), np.zeros(1, bool)
        self.flat, self.size = np.array([END_ID], np.uint32), np.ones(1, np.int64)

    def encoded(self, strings: list[str]) -> list[list[int]]:
        merges, letters, out, hard = self.tokenizer.model.tokenize, self.letters, [], []
        for i, s in enumerate(strings):
            if s.isalpha() and max(s) < "\u0250":
                plain = unicodedata.normalize("NFC", s).lower() if not s.isascii() else s
                if plain.isalpha():
                    out.append([t.id for t in merges(plain if s.isascii() else plain.encode().decode("latin-1").translate(letters))])
                    continue
            hard.append(i)
            out.append([])
        for i, e in zip(hard, self.tokenizer.encode_batch_fast([strings[i] for i in hard], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def numbers(self, vocabulary: pa.Array) -> np.ndarray:
        """The numbers of different words; those not met before are tokenised."""
        import pyarrow.compute as pc

        if len(self.words) > self.memory:
            self.forget()
        fresh = vocabulary.filter(pc.is_null(pc.index_in(vocabulary, value_set=self.words)))
        if len(fresh):
            # a letter or digit never shares a token with a mark behind it
            stem = pc.utf8_rtrim(fresh, characters=TRAILING)
            parted = pc.match_substring_regex(stem, r"[\pL\pN]\z")
            stem = pc.ascii_lower(pc.if_else(parted, stem, fresh))
            tail = pc.if_else(parted, pc.replace_substring_regex(fresh, f"(?s)^.*?([{TRAILING}]*)\\z", "\\1"), "")
            both = pa.concat_arrays([stem, tail]).dictionary_encode()
            new = both.dictionary.filter(pc.is_null(pc.index_in(both.dictionary, value_set=self.atoms)))
            if len(new):
                lists = self.encoded(new.to_pylist())
                self.atoms = pa.concat_arrays([self.atoms, new])
                self.atom_size = np.concatenate((self.atom_size, np.fromiter(map(len, lists), np.int64, len(lists))))
                self.atom_ids = np.concatenate((self.atom_ids, np.fromiter(chain.from_iterable(lists), np.uint32)))
            two = pc.index_in(both.dictionary, value_set=self.atoms).to_numpy(zero_copy_only=False)[both.indices.to_numpy()].reshape(2, -1).T.ravel()
            self.flat = np.concatenate((self.flat, spread(self.atom_ids, self.atom_size, two)))
            self.size = np.concatenate((self.size, self.atom_size[two].reshape(-1, 2).sum(axis=1)))
            self.ends = np.concatenate((self.ends, pc.match_substring_regex(fresh, f"[{ENDS}][{CLOSERS}]*\\z").to_numpy(zero_copy_only=False)))
            self.words = pa.concat_arrays([self.words, fresh])
        return pc.index_in(vocabulary, value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64)


def spread(flat: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The stretches of flat, of the given sizes, that picks names, one after the other."""
    n = sizes[picks]
    to = np.cumsum(n)
    start = (np.cumsum(sizes) - sizes)[picks]
    return flat[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(start - (to - n), n)]


def stream(words: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all documents with their closing ids, where each document ends, where each sentence ends)."""
    plain, per_text = split_words(texts)
    coded = plain.dictionary_encode()
    of = words.numbers(coded.dictionary.cast(pa.string()))
    picks = np.insert(of[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64), np.cumsum(per_text), 0)
    word_end = np.cumsum(words.size[picks])
    doc_end = word_end[np.cumsum(per_text) + np.arange(len(texts))]
    return spread(words.flat, words.size, picks), doc_end, word_end[words.ends[picks]]


def ascending(*parts: np.ndarray) -> np.ndarray:
    """All numbers in order, each once."""
    x = np.sort(np.concatenate(parts))
    return x[np.append(True, x[1:] != x[:-1])]


def places(total: int, doc_end: np.ndarray, sentence: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(where a sequence may end, ascending from 0, what that costs)."""
    base = ascending(np.zeros(1, np.int64), doc_end, sentence)
    wide = np.flatnonzero(np.diff(base) > GRID)
    more = [np.arange(a + GRID, z, GRID) for a, z in zip(base[wide].tolist(), base[wide + 1].tolist(), strict=True)]
    soft = ascending(base, *more)
    at = ascending(soft, soft + length)
    at = at[at <= total]
    cost = np.full(len(at), TEAR, np.int64)
    cost[np.searchsorted(at, sentence)] = BREAK
    cost[np.searchsorted(at, doc_end)] = 0
    return at, cost


def powers_back(at: np.ndarray, length: int = LENGTH) -> tuple[list[int], list[int]]:
    """Pairs of places a power of two below `length` apart: (where those of each place begin, the earlier place)."""
    late, early = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range((length - 1).bit_length()):
        i = np.searchsorted(at, at - (1 << k))
        met = np.flatnonzero(at[i] == at - (1 << k))
        late.append(met)
        early.append(i[met])
    both, order = np.concatenate(late), np.argsort(np.concatenate(late), kind="stable")
    return np.searchsorted(both[order], np.arange(len(at) + 1)).tolist(), np.concatenate(early)[order].tolist()


def cuts(places: np.ndarray, costs: np.ndarray, length: int = LENGTH) -> list[int]:
    """The ends of sequences among the places, the first (0) left out, of least padding plus cost."""
    begin, early = powers_back(places, length)
    at, cost = places.tolist(), costs.tolist()
    best, back = [0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])  # places within reach; cost plus place rises from the front on
    level = [at[0]]
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0]] < p - length:
            queue.popleft()
        i = queue[0]
        least = level[i] + length - p
        for k in early[begin[j] : begin[j + 1]]:
            if best[k] < least:
                least, i = best[k], k
        best[j], back[j] = least + cost[j], i
        own = best[j] + p
        while queue and level[queue[-1]] > own:
            queue.pop()
        queue.append(j)
        level.append(own)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def pieces(ids: np.ndarray, doc_end: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """[document, start, length, crc32, doc_tokens, sequence, offset] of the pieces that sequences make of documents."""
    doc_start, seq_start = np.concatenate(([0], doc_end[:-1])), np.concatenate(([0], ends[:-1]))
    start = np.union1d(doc_start, seq_start)
    end = np.append(start[1:], len(ids))
    doc, seq = np.searchsorted(doc_start, start, "right") - 1, np.searchsorted(seq_start, start, "right") - 1
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(start))
    return [doc, start - doc_start[doc], end - start, crc, (doc_end - doc_start)[doc], seq, start - seq_start[seq]]


def packed(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """The pieces of all documents: PIECES. The file of the tokenizer, whose size is checked, goes out with the job."""
    if os.path.getsize(tokenizer_path) > MOST_BYTES:
        raise ValueError(f"{tokenizer_path} is larger than {MOST_BYTES} bytes")
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        words, count, task = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            for b in slices(batch, 1):
                words = words or Words(Tokenizer.from_str(sent.value))
                ids, doc_end, sentence = stream(words, b.column(1))
                at, cost = places(len(ids), doc_end, sentence, length)
                ends = np.array(cuts(at, cost, length))
                doc, *numbers, seq, offset = pieces(ids, doc_end, ends)
                columns = [b.column(0).take(pa.array(doc)), *map(pa.array, numbers), pa.array((task << 32) + count + seq), pa.array(offset)]
                count += len(ends)
                yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in columns], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
