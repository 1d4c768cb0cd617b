import random

from pyspark.sql import functions as F

from tenura.llm import secrets
from tenura.llm.common import row_key


def texts_and_secrets():
    rng = random.Random(6)
    words = "the quick configuration of services and deployment pipelines under review with several numbers".split()
    texts, expected = [], []
    for i in range(300):
        text = [rng.choice(words) for _ in range(30)]
        own = set()
        kind = i % 6
        if kind == 0:
            own = {"AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))}
            text[10:10] = list(own)
        elif kind == 1:
            value = "".join(rng.choices("0123456789abcdef", k=40))
            own, text[10:10] = {value}, ["token", "=", f'"{value}"']
        elif kind == 2:
            value = "".join(rng.choices("0123456789abcdef", k=18))
            own, text[10:10] = {value}, [f"password={value}"]
        elif kind == 3:
            text[10:10] = ["".join(rng.choices("0123456789", k=16)), "10.20.30.40", "2024-01-01"]
        elif kind == 4:
            text[10:10] = ["configurationServices2", "deployment-pipelines-review1"]
        texts.append(" ".join(text))
        expected.append(own)
    return texts, expected


def test_decisions_on_known_formats(make_docs):
    texts, expected = texts_and_secrets()
    docs = make_docs(texts)
    scanned = secrets.scan(docs).cache()
    got = {r.doc_id: set(r.secrets) for r in secrets.summary(scanned).collect()}
    assert got == dict(enumerate(expected))
    assert scanned.where("candidate is not null and not is_secret").count() > 50
    clean = {r.doc_id: r.text for r in secrets.redact(docs, scanned).collect()}
    for i, own in enumerate(expected):
        assert all(s not in clean[i] for s in own)
        assert clean[i].count(secrets.PLACEHOLDER) == len(own)
        if not own:
            assert clean[i] == texts[i]


def test_labelled_findings_decide(spark, make_docs):
    texts, _ = texts_and_secrets()
    docs = make_docs(texts)
    found = secrets.candidates(docs).where("candidate is not null")
    numbers = found.withColumn("label", F.col("candidate").rlike("^[0-9-]+$").cast("int"))
    scanned = secrets.scan(docs, findings=numbers).where("is_secret")
    assert {bool(r.candidate.replace("-", "").isdigit()) for r in scanned.collect()} == {True}


def test_odd_rows(odd_docs, no_docs):
    scanned = secrets.scan(odd_docs)
    rows = secrets.summary(scanned).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.n_secrets == 0 and r.secrets == [] for r in rows)
    same = secrets.redact(odd_docs, scanned)
    assert same.columns == odd_docs.columns
    assert sorted(map(str, same.collect())) == sorted(map(str, odd_docs.collect()))
    assert secrets.scan(no_docs).count() == 0
    assert secrets.scan(odd_docs.drop("source"), path=None).count() >= len(rows)


def with_keys(docs, found):
    """Findings (doc_id, candidate, is_secret) with the keys of the documents."""
    keys = docs.select(F.col("doc_id"), row_key(docs).alias("key"))
    return found.join(keys, "doc_id")


def test_overlapping_and_repeated_secrets(spark, make_docs):
    docs = make_docs(["a abcdef123456 b abcdef1234567890 c abcdef123456"])
    found = spark.createDataFrame(
        [(0, "abcdef123456", True), (0, "abcdef1234567890", True)], "doc_id long, candidate string, is_secret boolean"
    )
    assert secrets.redact(docs, with_keys(docs, found)).first().text == "a [SECRET] b [SECRET] c [SECRET]"


def test_secrets_of_one_text_leave_others_alone(spark):
    value = "0123456789abcdef0123"
    rows = [(i, t) for i in (1, None) for t in (f"token={value}", f"the lock file says {value} here")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = docs.where("text LIKE 'token=%'").select(
        row_key(docs).alias("key"), F.lit(value).alias("candidate"), F.lit(True).alias("is_secret")
    )
    texts = [r.text for r in secrets.redact(docs, scanned).collect()]
    assert sorted(texts) == ["the lock file says " + value + " here"] * 60 + ["token=[SECRET]"] * 60


def test_values_that_hint_words_are_set_to(make_docs):
    texts = {
        'password = "Tr0ub4dor&3" and more': {"Tr0ub4dor&3"},
        "then password=hunter2 was sent": {"hunter2"},
        "passwd: 'p4$$w.rd!' in the file": {"p4$$w.rd!"},
        "token=0123456789abcdef0123456789abcdef01234567": {"0123456789abcdef0123456789abcdef01234567"},
        "the password is set, access: public": set(),
        "in chapter 12: password handling of version1": set(),
    }
    got = secrets.candidates(make_docs(list(texts)), path=None).where("candidate is not null").collect()
    found = {t: {r.candidate for r in got if r.doc_id == i} for i, t in enumerate(texts)}
    assert found == texts


def test_short_secrets_are_redacted(make_docs):
    texts, _ = texts_and_secrets()
    more = ['login password = "Tr0ub4dor&3" here', "then api_key=x9!k2#q7 was sent"]
    docs = make_docs(texts + more)
    clean = {r.doc_id: r.text for r in secrets.redact(docs, secrets.scan(docs)).collect()}
    assert clean[len(texts)] == 'login password = "[SECRET]" here'
    assert clean[len(texts) + 1] == "then api_key=[SECRET] was sent"


def test_dictionary_is_a_share_of_the_corpus(make_docs):
    docs = make_docs(["common words here " * 6, "rare once", "seven " * 7 + "four " * 4])
    assert {r.word for r in secrets.dictionary(docs).collect()} == {"common", "words", "here", "seven"}
    assert {r.word for r in secrets.dictionary(docs, share=5).collect()} == {"seven"}


def test_no_python_in_the_plan(make_docs):
    plan = secrets.summary(secrets.scan(make_docs(texts_and_secrets()[0])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
