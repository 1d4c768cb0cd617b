import random

import numpy as np
from pyspark.sql import functions as F

from tenura.llm import language
from tenura.llm.common import held_out
from tenura.llm.ngrams import BLOCK, counted, distinct

WORDS = {
    "en": "the and of to with that this from there which would about could other".split(),
    "fr": "le la les des une dans pour avec être cette nous vous très où".split(),
    "de": "der die das und nicht über für eine auch wird nach können schön".split(),
}


def corpus(spark, n=600):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 40))).capitalize(), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_ngrams_count_every_one_once():
    data = bytes(np.random.default_rng(0).integers(97, 123, BLOCK + 1000, dtype=np.uint8))
    at, n = counted(data, range(2, 5), 16)
    assert n.sum() == sum(len(data) - k + 1 for k in (2, 3, 4))
    assert set(at) == set(distinct(data, range(2, 5), 16))
    half = counted(data[: BLOCK // 2], range(2, 5), 16)[1].sum()
    assert half == sum(BLOCK // 2 - k + 1 for k in (2, 3, 4))
    assert len(counted(b"", range(2, 5), 16)[0]) == 0


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    model = language.fit(docs, rows_per_language=150)
    got = language.predict(docs, model).join(docs, "doc_id").where(held_out(F.col("doc_id"), 4))
    rows = got.collect()
    assert len(rows) > 100
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.02


def test_odd_rows(spark, odd_docs, no_docs):
    model = language.fit(corpus(spark, 200), rows_per_language=50)
    rows = {(r.doc_id, r.lang_pred, r.rejected) for r in language.predict(odd_docs, model).collect()}
    assert {r[0] for r in rows if r[1] == "und"} == {2, None, 3, 4, 8}
    assert all(r[2] for r in rows if r[1] == "und")
    assert language.predict(no_docs, model).count() == 0
    kept = language.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert not {2, 3, 4, 8} & {r.doc_id for r in kept.collect()}


def test_numerals_and_signs_are_no_letters(spark):
    texts = ["½ ²③", "Ⅷ ㊿ 12", "٣٤ _ __", "a½", "ª"]
    model = language.fit(corpus(spark, 100), rows_per_language=30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0)] * 3
    assert "und" not in {got[3][0], got[4][0]}


def test_the_sample_is_bounded(spark, monkeypatch):
    """One id and one text on most rows do not bring more rows to the driver than asked for."""
    seen = []
    monkeypatch.setattr(language, "_sgd", lambda bags, classes, n, dim, epochs, rate, seed: (
        seen.append(np.bincount(classes, minlength=n)), np.zeros((1 << language.BITS, n)), np.zeros(n))[1:])
    rows = [(1, "the same text over and over", "en")] * 3000 + [(i, "der andere text", "de") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language.fit(docs, rows_per_language=100)
    assert (seen[0] <= 100).all() and seen[0][1] >= 70


def test_nothing_to_learn_from(odd_docs, no_docs):
    model = language.fit(no_docs)
    assert {r.lang_pred for r in language.predict(odd_docs, model).collect()} == {"und"}


def test_the_texts_decide_not_lang_or_id(spark):
    docs = corpus(spark, 200)
    model = language.fit(docs, rows_per_language=60)
    other = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    a = sorted((r.doc_id, r.lang_pred, r.score) for r in language.predict(docs, model).collect())
    b = sorted((r.doc_id - 10_000, r.lang_pred, r.score) for r in language.predict(other, model).collect())
    assert a == b
