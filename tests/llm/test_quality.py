import random

import numpy as np
from pyspark.sql import functions as F

from tenura.llm import quality
from tenura.llm.common import held_out


def corpus(spark, n=400):
    rng = random.Random(4)
    words = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}" for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(2, 60))]
        good = rng.random() < 0.7
        if not good:
            text = [text[0]] * (len(text) + 3) if i % 2 else [w.upper() + "!!" for w in text]
        docs.append((i, " ".join(text)))
        labels.append((i, int(good)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int"),
    )


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"), 4)).collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_ratios_by_hand():
    rows = [np.array([0, 1]), np.array([1]), np.array([2])]
    ratios = quality.log_count_ratios(rows, np.array([True, True, False]), 3)
    assert np.allclose(ratios, np.log([(2 / 6) / (1 / 4), (3 / 6) / (1 / 4), (1 / 6) / (2 / 4)]))


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(60)]
    values, signs = rng.normal(0, 1, 30), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    w, b = quality.dual_coordinate_descent(rows, values, signs, np.full(60, 0.5), 400)
    x = np.zeros((60, 31))
    for i, at in enumerate(rows):
        x[i, at] = values[at] / np.sqrt(quality.SOFT + (values[at] ** 2).sum())
    x[:, 30] = 1

    def loss(v):
        return v @ v / 2 + 0.5 * np.maximum(0, 1 - signs * (x @ v)).sum()

    best = loss(np.append(w, b))
    assert all(loss(np.append(w, b) + rng.normal(0, 0.02, 31)) >= best - 1e-4 for _ in range(300))


def test_odd_rows(spark, odd_docs, no_docs):
    docs, labels = corpus(spark, 120)
    model = quality.fit(docs, labels)
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert quality.score(no_docs, model).count() == 0


def test_labels_of_one_class_or_none(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 5), (5, 1)], "doc_id long, quality int")
    for labels in (none, odd):
        scores = {r.score for r in quality.score(odd_docs, quality.fit(odd_docs, labels)).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1


def test_one_id_on_most_rows_does_not_fill_the_sample(spark, monkeypatch):
    docs, labels = corpus(spark, 200)
    many = docs.unionByName(spark.range(3000).selectExpr("0L AS doc_id", "concat('text ', id) AS text"))
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows, positive: seen.append((len(rows), positive)))
    quality.fit(many, labels, rows_per_class=40)
    n, positive = seen[0]
    assert n <= 80 and positive.sum() <= 40 and (~positive).sum() <= 40 and n > 50
