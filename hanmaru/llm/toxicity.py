"""Toxicity by weak supervision.

Many weak voters look at a text: lexicon voters, each a word stem that labelled rows associate with toxicity, a seed lexicon,
and pattern voters (shouting, exclamation, symbol noise, address in the second person). A generative label model estimates
by expectation maximisation how often each voter is right in either class and how strongly voters correlate given the
class; correlated voters share their say. It sees labelled and unlabelled texts alike: the label that a row carries is one
more voter, which abstains on unlabelled texts and whose accuracy is estimated as any other's. A linear classifier is then
trained on the posterior labels of the labelled ones (unlabelled ones count UNLABELLED_COST), and it alone scores texts.

Only lexicon, label model and classifier are fitted on a sample: at most MAX_LABELLED labelled rows and MAX_UNLABELLED
unlabelled ones, in order of a hash of doc_id; scoring reads every whole text. Model and lexicon are of fixed size, so what
is sent to executors doesn't grow.

Fixed cases: null and empty texts score the classifier's value for no words; labels that are null, or whose documents are
missing, teach nothing; a document labelled more than once counts as toxic if any label says so; of rows that repeat a
sampled doc_id the one of the least text hash teaches; repeated documents score alike; without labelled rows of both classes every score is the share of toxic rows (0 if there is none); extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bounds of the samples that the model is fitted on.
MAX_LABELLED, MAX_UNLABELLED = 6000, 3000
STEM_LENGTHS = (4, 5, 6, 7, 8)
MAX_VOTERS, MAX_STEMS = 96, 3000
#: Where the estimate of the labels' accuracy starts, and a prior of so many rows that holds it there.
GOLD_ACCURACY, GOLD_ROWS = 0.95, 500
#: What an unlabelled row counts beside a labelled one: in the label model's rates, and in the classifier's loss.
UNLABELLED_SAY, UNLABELLED_COST = 0.1, 0.0
#: Seed lexicon: general insults of a few languages.
SEEDS = frozenset(
    "asshole bastard bitch clown cretin disgusting dumb fool idiot imbecile jerk loser moron pathetic scum stupid trash vermin worthless "
    "abschaum arschloch dumm dummkopf idioten trottel versager widerlich wertlos connard crétin débile imbécile ordure pathétique salaud "
    "stupide asqueroso basura estúpido idiota imbécil inútil payaso patético".split()
)
ADDRESS = frozenset("you your du dein tu toi vous eres".split())
WORD = re.compile(r"[^\W\d_]+")


def count_words(text: str) -> Counter[str]:
    """Words in lower case, letters only: found token by token, as most tokens recur."""
    out: Counter[str] = Counter()
    for token, c in Counter(text.lower().split()).items():
        for w in [token] if token.isalpha() else WORD.findall(token):
            out[w] += c
    return out


def pattern_values(text: str, n: int, addressed: int) -> list[float]:
    """Values of the pattern voters: shares of capitals, exclamation marks and symbols, and of second-person words."""
    size = max(1, len(text))
    caps = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / size
    noise = sum(map(text.count, "#$%&*@")) / size
    return [caps, text.count("!") / max(1, n), noise, addressed / max(1, n)]


def stems(word: str) -> list[str]:
    """The word's beginnings, marked with a dash, and the word itself."""
    return [word[:k] + "-" for k in STEM_LENGTHS if len(word) > k] + [word]


@dataclass
class Model:
    """A linear classifier over shares and presence of stems, and pattern values."""

    index: dict[str, int] = field(default_factory=dict)
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))
    present: np.ndarray = field(default_factory=lambda: np.zeros(0))
    patterns: np.ndarray = field(default_factory=lambda: np.zeros(4))
    bias: float = 0.0
    known: dict[str, tuple[int, int, tuple[int, ...]]] = field(default_factory=dict)

    def learn(self, token: str) -> tuple[int, int, tuple[int, ...]]:
        """(words, words of address, stems of the model) of a token; kept, as tokens recur."""
        words = WORD.findall(token)
        own = (len(words), sum(w in ADDRESS for w in words), tuple(self.index[s] for w in words for s in stems(w) if s in self.index))
        if len(self.known) < 300_000:
            self.known[token] = own
        return own

    def score(self, text: str | None) -> float:
        text = text or ""
        n = addressed = 0
        got: dict[int, int] = {}
        for token, c in Counter(text.lower().split()).items():
            words, you, ids = self.known.get(token) or self.learn(token)
            n += words * c
            addressed += you * c
            for i in ids:
                got[i] = got.get(i, 0) + c
        z = self.bias + float(np.dot(self.patterns, pattern_values(text, n, addressed)))
        for i, c in got.items():
            z += self.present[i] + self.share[i] * min(1.0, 10.0 * c / n)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def scaled(count, n):
    """Share of the words, times ten, at most 1."""
    return np.minimum(1.0, 10.0 * count / np.maximum(1, n))


def label_model(votes: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row, each voter's weight and accuracy (where it votes), from votes (rows x voters: -1, 0 for none, 1).

    The last voter is the row's label; labelled rows give the first rates, then all rows do. Expectation maximisation over class-conditional vote rates, the labels' among them; voters that correlate given
    the class share one say: each counts 1 / (1 + sum of its correlations).
    """
    rows, m = votes.shape
    gold = votes[:, -1]
    labelled = gold != 0
    yes = (votes[:, :-1] > 0).sum(axis=1)
    guess = np.where(yes > np.quantile(yes, 0.8), 0.7, 0.1)  # only where there are no labels at all
    post = np.where(gold == 1, GOLD_ACCURACY, np.where(gold == -1, 1 - GOLD_ACCURACY, guess))
    # the first rates come from labelled rows; from then on every row counts
    counts = labelled.astype(float) if labelled.any() else np.ones(rows)
    seen = [(votes == v).astype(float) for v in (-1, 0, 1)]
    weight = np.ones(m)
    for _ in range(rounds):
        prior = float(np.clip((post * counts).sum() / counts.sum(), 1e-3, 1 - 1e-3))
        ll = np.zeros((rows, 2))
        resid = np.zeros((rows, m))
        right_share = np.zeros(m)
        for y, p in ((0, (1 - post) * counts), (1, post * counts)):
            rates = np.stack([(s * p[:, None]).sum(axis=0) + 1.0 for s in seen])
            rates /= rates.sum(axis=0)
            said = (gold == (1 if y else -1)).astype(float) * p
            right = (said.sum() + GOLD_ROWS * GOLD_ACCURACY) / ((labelled * p).sum() + GOLD_ROWS)
            rates[:, -1] = (1 - right, 1.0, right) if y else (right, 1.0, 1 - right)  # whether a row is labelled says nothing
            ll[:, y] = (seen[0] * np.log(rates[0]) + seen[2] * np.log(rates[2])) @ weight  # who abstains says nothing
            resid += p[:, None] * (votes - (rates[2] - rates[0]))
            right_share += (prior if y else 1 - prior) * rates[2 * y] / (rates[0] + rates[2])
        dev = resid / (np.sqrt((resid**2).mean(axis=0)) + 1e-9)
        cor = np.abs(dev.T @ dev) / rows
        counts = np.where(labelled, 1.0, UNLABELLED_SAY) if labelled.any() else np.ones(rows)
        np.fill_diagonal(cor, 0)
        cor[:, -1] = cor[-1, :] = 0
        weight = 1 / (1 + np.where(cor > 0.1, cor, 0).sum(axis=0))
        z = np.log(prior / (1 - prior)) + ll[:, 1] - ll[:, 0]
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post, weight, right_share


@dataclass
class Sample:
    """Rows with labels (0, 1, or -1 for none) in flat arrays: entry k says that row[k] has stem[k] count[k] times."""

    labels: np.ndarray
    words: np.ndarray
    patterns: np.ndarray
    row: np.ndarray
    stem: np.ndarray
    count: np.ndarray

    def part(self, keep: np.ndarray) -> Sample:
        """The rows that keep marks."""
        at = keep[self.row]
        place = np.cumsum(keep) - 1
        return Sample(self.labels[keep], self.words[keep], self.patterns[keep], place[self.row[at]], self.stem[at], self.count[at])


def fit(data: Sample, chosen: list[str], voters: int) -> Model:
    """Model over the chosen stems, the first `voters` of which vote as a lexicon."""
    labels, size, rows = data.labels, len(chosen), len(data.labels)
    given = labels >= 0
    share = float(labels[given].mean()) if given.any() else 0.0
    if not 0 < share < 1:
        return Model(bias=30.0 if share else -30.0)
    r, f = data.row, data.stem
    x = scaled(data.count.astype(float), data.words[r])
    pats = data.patterns

    votes = []
    for k in range(voters):  # each lexicon voter's cut is the share that parts the labels best
        at = f == k
        val = np.zeros(rows)
        val[r[at]] = x[at]
        if not (val > 0).any():
            continue
        cuts = np.unique(np.quantile(val[val > 0], (0, 0.25, 0.5, 0.75)))
        own = val[given]
        best = max(cuts, key=lambda c: labels[given][own >= c].sum() / (1 + (own >= c).sum()) * np.sqrt((own >= c).sum()))
        votes.append(np.where(val >= best, 1, 0))
    seeds = np.array([s in SEEDS for s in chosen])
    votes.append(np.where(np.bincount(r, weights=seeds[f], minlength=rows) > 0, 1, 0))
    for j, cut in enumerate((0.3, 0.2, 0.1, 0.02)):
        votes.append(np.where(pats[:, j] >= cut, 1, 0))
    votes.append(np.where(given, np.where(labels > 0, 1, -1), 0))
    post, _, _ = label_model(np.stack(votes, axis=1).astype(np.int8))

    # toxic rows are few: each counts so much more that both classes matter
    cost = (1 + post * (1 - share) / share) * np.where(given, 1.0, UNLABELLED_COST)
    # full-batch Adam on the logistic loss against the posterior, with a small ridge
    w = np.zeros(2 * size + 4 + 1)
    w[-1] = np.log(share / (1 - share))
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    ridge = np.where(np.arange(len(w) - 1) < 2 * size, 2e-5, 2e-2)
    for t in range(1, 251):
        z = w[-1] + pats @ w[2 * size : -1] + np.bincount(r, weights=w[f] * x + w[size + f], minlength=rows)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - post) * cost
        e = err[r]
        g = np.concatenate([np.bincount(f, weights=e * x, minlength=size), np.bincount(f, weights=e, minlength=size), pats.T @ err, [err.sum()]]) / rows
        g[:-1] += ridge * w[:-1]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return Model({s: i for i, s in enumerate(chosen)}, w[:size].copy(), w[size : 2 * size].copy(), w[2 * size : -1].copy(), float(w[-1]))


def logits(model: Model, data: Sample) -> np.ndarray:
    x = scaled(data.count.astype(float), data.words[data.row])
    add = model.share[data.stem] * x + model.present[data.stem]
    return model.bias + data.patterns @ model.patterns + np.bincount(data.row, weights=add, minlength=len(data.labels))


def fit_calibrated(data: Sample, chosen: list[str], voters: int, folds: int = 2) -> Model:
    """fit, with scores shifted so that one half is the cut that parts the labels best when each fold is scored by a model
    of the others (F, precision counting twice)."""
    model = fit(data, chosen, voters)
    y, given = data.labels, data.labels >= 0
    if given.sum() < 200 or not 0 < y[given].mean() < 1:
        return model
    z, fold = np.zeros(len(y)), np.arange(len(y)) % folds
    for k in range(folds):
        part = data.part(fold != k)
        if not 0 < part.labels[part.labels >= 0].mean() < 1:
            return model
        z[fold == k] = logits(fit(part, chosen, voters), data.part(fold == k))
    y, z = y[given], z[given]
    order = np.argsort(-z, kind="stable")
    best = int((1.25 * np.cumsum(y[order]) / (np.arange(1, len(y) + 1) + 0.25 * max(1, y.sum()))).argmax())
    model.bias -= float(z[order][best : best + 2].mean())
    return model


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def unlabelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(id_, y, text): at most `most` documents without any label, held-out ids left out, in order of a hash of doc_id; y is -1.

    A bound on the hash, from the share wanted, comes before the join and the sort.
    """
    slim = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("id_"), "text")
    n = max(1, slim.count())
    few = slim.where(F.pmod(F.xxhash64("id_", F.lit("unlabelled")), F.lit(1 << 30)) <= min(1.0, 4.0 * most / n) * (1 << 30))
    rest = few.join(labels.select(F.col("doc_id").cast("long").alias("id_")).distinct(), "id_", "left_anti")
    one = rest.groupBy("id_").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return cut(one.orderBy(F.xxhash64("id_", F.lit("unlabelled")), "id_").limit(most).select("id_", F.lit(-1).alias("y"), "text"), "unlabelled")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fits the classifier on labelled rows that are not held out, and on unlabelled ones."""
    some = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("id_"))
        .agg((F.max("toxic") > 0).cast("int").alias("y"))
        .orderBy(F.xxhash64("id_"), "id_")
        .limit(max_labelled)
    )
    slim = docs.select(F.col("doc_id").cast("long").alias("id_"), "text")
    # one row for each id: rows that repeat it must not all come to the driver
    texts = cut(slim.join(F.broadcast(some), "id_").groupBy("id_", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")

    def stem_counts(words: Counter[str]) -> Counter[str]:
        got: Counter[str] = Counter()
        for w, c in words.items():
            for x in stems(w):
                got[x] += c
        return got

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_, toxic = Counter(), Counter()
        for b in batches:
            for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = stem_counts(count_words(t or "")).keys()
                docs_.update(own)
                if y:
                    toxic.update(own)
        names = list(docs_)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(docs_.values()), pa.int64()), pa.array([toxic[s] for s in names], pa.int64())], names=["s", "n", "k"])

    size = dict(texts.groupBy("y").count().collect())
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return Model(bias=30.0 if pos else -30.0)
    a, b = F.col("k") + 0.5, F.col("n") - F.col("k") + 0.5
    z = (F.log(a / (F.lit(pos + 1.5) - a)) - F.log(b / (F.lit(neg + 1.5) - b))) / F.sqrt(1 / a + 1 / b)
    ranked = texts.mapInArrow(count, "s string, n long, k long").groupBy("s").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where("n >= 5").withColumn("z", z)
    ranked = cut(ranked, "stems")
    top = ranked.where("z > 0.5").orderBy(F.desc("z"), "s").limit(MAX_STEMS).select("s", "z").collect()
    low = ranked.orderBy("z", "s").limit(MAX_STEMS // 4).select("s").collect()
    chosen = list(dict.fromkeys([x.s for x in top] + [x.s for x in low]))
    voters = min(MAX_VOTERS, sum(x.z > 2 for x in top))
    index = {s: i for i, s in enumerate(chosen)}

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for i, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = count_words(t or "")
                n = sum(words.values())
                got = [(index[s], c) for s, c in stem_counts(words).items() if s in index]
                p = pattern_values(t or "", n, sum(words[w] for w in ADDRESS))
                for c, v in zip(cols, (i, y, n, [g[0] for g in got], [g[1] for g in got], p), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id_", "y", "n", "f", "c", "p"])

    table = texts.unionByName(unlabelled(docs, labels, max_unlabelled)).mapInArrow(take, "id_ long, y int, n int, f array<int>, c array<int>, p array<double>").toArrow().sort_by("id_").combine_chunks()

    def flat(name: str, kind: type) -> np.ndarray:
        return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)

    lengths = np.diff(table["f"].combine_chunks().offsets.to_numpy())
    sample = Sample(
        table["y"].to_numpy().astype(float), np.maximum(1, table["n"].to_numpy().astype(float)), flat("p", float).reshape(-1, 4),
        np.repeat(np.arange(len(lengths)), lengths), flat("f", np.int64), flat("c", np.int64),
    )
    return fit_calibrated(sample, chosen, voters)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (doc_id if not given) and score double."""
    kept = docs.select(*(keep or ["doc_id"]), F.col("text").alias("text__"))
    schema = kept.drop("text__").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array([model.score(t.as_py()) for t in b.column(b.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], s], names=[*b.schema.names[:-1], "score"])

    return kept.mapInArrow(run, schema)


def clean(docs: DataFrame, model: Model, cut_off: float = 0.5) -> DataFrame:
    """docs without those that score cut_off or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            yield b.filter(pa.array([model.score(t.as_py()) < cut_off for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
