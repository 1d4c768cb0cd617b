import random
import re

import pytest

from tenura.llm import decontaminate


def words_by_hand(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def by_hand(texts, items, size=10):
    windows = {}
    for item, text in items:
        w = words_by_hand(text)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for text in texts:
        w = words_by_hand(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        out.append((len(w), len(hit), sorted(found), bool(hit)))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    words = ["the", "of", "Is", "é", "Ünder"] + [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 9, 10, 11, 40])))) for i in range(30)]
    items += [(30, items[4][1]), (31, None), (32, ""), (33, " ,.! "), (None, "only here is this one, once: " + items[5][1])]
    texts = []
    for _ in range(80):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.6:
            w = words_by_hand(rng.choice(items)[1])
            a = rng.randrange(0, max(len(w) - 5, 1))
            at = rng.randrange(0, len(text) + 1)
            text[at:at] = [x.upper() if x.isascii() else x for x in w[a : a + rng.randrange(1, 45)]]
        texts.append(rng.choice([" ", ", ", "\n-"]).join(text))
    return texts + [None, "", "...", texts[0], texts[0]], items


def test_against_brute_force(spark, make_docs, case):
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    for shingle in (1, 3, 4):
        got = decontaminate.contamination(make_docs(texts), bench, shingle=shingle).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in got] == by_hand(texts, items)
    assert sum(r.contaminated for r in got) > 20


def test_windows_in_several_blocks(spark, make_docs, case, monkeypatch):
    monkeypatch.setattr(decontaminate, "WINDOWS_AT_ONCE", 100)
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(make_docs(texts), bench).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in got] == by_hand(texts, items)


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([("a", "FOX jumps over"), (None, "delta ALPHA")], "item_id string, text string")
    rows = decontaminate.contamination(odd_docs, bench).collect()
    assert len(rows) == odd_docs.count()
    by = {(r.doc_id, r.n_words): (r.n_hit, r["items"]) for r in rows}
    assert by[(1, 9)] == (3, ["a"]) and by[(6, 60_000)] == (29_998, [""])
    assert by[(2, 0)] == (0, []) and by[(5, 1)] == (0, [])
    assert decontaminate.contamination(no_docs, bench).count() == 0
    empty = decontaminate.contamination(odd_docs, bench.where("false")).collect()
    assert len(empty) == len(rows) and not any(r.contaminated for r in empty)
    kept = decontaminate.without_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == len(rows) - 3


def test_no_python_in_the_plan(spark, make_docs, case):
    bench = spark.createDataFrame(case[1], "item_id long, text string")
    plan = decontaminate.contamination(make_docs(case[0]), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
