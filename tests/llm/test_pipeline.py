"""The whole pipeline over planted documents, against a chain of brute-force stages."""

import random

import pytest
from tests.llm.test_simhash import fingerprint_by_hand, roots_by_hand

import corpus_pipeline
from tenura.llm import sentencepiece

WORDS = {
    "en": "the and of to with that this from there which would about could other people water between".split(),
    "fr": "le la les des une dans pour avec être cette nous vous très où leur fait comme entre".split(),
}
TOKEN = "0f3a9c5be17d4286a0c3f5d7e9b1a2c4d6e8f0a1"


def planted():
    """Documents and benchmark items; copies, near copies, passages, secrets and texts without letters among them."""
    rng = random.Random(11)
    prose = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "a", "s", "ly"]) for _ in range(n))
    items = [(f"i{k}", " ".join(f"item{k}word{j}" for j in range(12 if k else 4))) for k in range(3)]
    docs = [(i, prose("en" if i % 2 else "fr", rng.randrange(60, 120)), "en" if i % 2 else "fr") for i in range(160)]
    base = docs[7][1].split()
    docs.append((200, docs[3][1], "en"))  # a copy
    near = next(
        text
        for k in range(len(base))
        if 0 < (fingerprint_by_hand(text := " ".join([*base[:k], "zzz", *base[k + 1 :]])) ^ fingerprint_by_hand(docs[7][1])).bit_count() <= 3
    )
    docs.append((201, near, "en"))
    for k, (_, passage) in enumerate(items):
        docs.append((210 + k, f"{prose('en', 20)} {passage.upper()}, {prose('en', 20)}", "en"))
    docs.append((220, " ".join(items[1][1].split()[:9]) + " " + prose("en", 40), "en"))  # nine words are no window
    docs.append((230, f"{prose('en', 30)} token = \"{TOKEN}\" {prose('en', 30)}", "en"))
    docs.append((231, f"{prose('fr', 30)} password={TOKEN[::-1]} {prose('fr', 30)}", "fr"))
    docs += [(240, "12345 !!! ½ ###", None), (241, "", None), (242, None, None), (None, prose("fr", 50), "fr")]
    return docs, items


def chain(docs, items):
    """(id, text) of what is left, by plain loops."""
    left = [(i, t) for i, t, _ in docs if t and any(c.isalpha() for c in t)]
    prints = [fingerprint_by_hand(t) for _, t in left]
    close = [(a, b) for a in range(len(left)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    # the smallest id of a group stays, a missing one first
    order = sorted(range(len(left)), key=lambda k: (left[k][0] is not None, left[k][0] or 0))
    place = {k: n for n, k in enumerate(order)}
    roots = roots_by_hand(range(len(left)), [(place[a], place[b]) for a, b in close])
    left = [left[k] for k in order if roots[place[k]] == place[k]]
    words = lambda t: "".join(c.lower() if c.isalnum() or not c.isascii() else " " for c in t).split()
    windows = set()
    for _, t in items:
        w = words(t)
        windows |= {tuple(w[s : s + 10]) for s in range(max(len(w) - 9, 1))}
    hit = lambda w: any(tuple(w[s : s + len(x)]) == x for x in windows for s in range(len(w) - len(x) + 1))
    left = [(i, t) for i, t in left if not hit(words(t))]
    return [(i, t.replace(TOKEN, "[SECRET]").replace(TOKEN[::-1], "[SECRET]")) for i, t in left]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, items = planted()
    path = str(tmp_path_factory.mktemp("planted"))
    rows = [(i, t, lang, f"src/{n % 3}.txt", len(t or ""), "?") for n, (i, t, lang) in enumerate(docs)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    spark.createDataFrame(rows, schema).coalesce(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_against_a_chain_by_hand(spark, folder):
    docs, items = planted()
    pieces = sentencepiece.read_model()
    found = sentencepiece.decode(corpus_pipeline.run(spark, folder), pieces).collect()
    key = lambda row: (row[0] is not None, row[0] or 0)
    expected = sorted(chain(docs, items), key=key)
    assert sorted(((r.doc_id, r.text) for r in found), key=key) == expected
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in found)
    left = {i for i, _ in expected}
    assert {200, 201, 210, 211, 212, 240, 241, 242}.isdisjoint(left) and {3, 7, 220, 230, 231, None} <= left
    assert sum("[SECRET]" in r.text for r in found) == 2


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
