"""The label model finds planted accuracies and correlations; odd rows of the samples."""

import numpy as np
from pyspark.sql import functions as F

from hanmaru.llm import toxicity as T


def test_label_model_finds_planted_accuracies():
    rng = np.random.default_rng(5)
    n, truth = 6000, np.random.default_rng(6).random(6000) < 0.3
    planted = np.array([0.9, 0.8, 0.75, 0.7, 0.85, 0.65])
    votes = np.where(rng.random((n, 6)) < planted, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[rng.random((n, 6)) < 0.2] = 0
    gold = np.where(rng.random(n) < 0.95, np.where(truth, 1, -1), np.where(truth, -1, 1))
    gold[rng.random(n) < 0.7] = 0  # most rows carry no label
    post, weight, right = T.label_model(np.column_stack((votes, gold)).astype(np.int8))
    assert np.abs(right[:6] - planted).max() < 0.06 and abs(right[6] - 0.95) < 0.04
    odds = np.log(0.3 / 0.7) + np.column_stack((votes, gold)) @ np.log(np.append(planted, 0.95) / (1 - np.append(planted, 0.95)))
    assert ((post > 0.5) == truth).mean() > ((odds > 0) == truth).mean() - 0.005  # as good as knowing the planted values
    twice = np.column_stack((votes, votes[:, 5], votes[:, 5], gold)).astype(np.int8)
    _, shared, _ = T.label_model(twice)
    assert max(shared[5:8]) < 0.5 < min(shared[:5])  # a voter that speaks three times has one say


def test_a_labelled_id_on_many_rows_teaches_once(spark):
    rows = [(i, f"plain words number {i}") for i in range(300)] + [(i, f"grobbel grobbeln words {i}") for i in range(300, 400)] + [(399, f"many {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(0, 400, 2)], "doc_id long, toxic int")
    found = {r.doc_id: r.predicted for r in T.score(docs, T.train(docs, labels)).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).collect()}
    assert sum(found[i] for i in range(300, 399)) > 90 and sum(found[i] for i in range(300)) < 10


def test_equal_texts_score_alike(spark):
    docs = spark.createDataFrame([(i, "same text here") for i in range(10)] + [(None, "same text here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, None)], "doc_id long, toxic int")
    assert len({r.score for r in T.score(docs, T.train(docs, labels)).collect()}) == 1
