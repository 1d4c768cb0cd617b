import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tenura.llm import phrases


def by_hand(rows, longest=3, least=10, share=50, top=2000):
    """lang, rank, phrase, a, l, r, n, score from rows of (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], a)
        found = []
        for p, a in candidates.items():
            if around[p] and 100 * around[p] >= share * a:
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def invented(seed, documents=60, words=400):
    """Texts over a few words in three languages, with phrases that recur and sentence ends."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "ß", "Xy", " odd", "a\x1cb", "\x85"]
    fixed = ["new york city", "New York", "more or less than that", "a b a b a"]
    rows = []
    for i in range(documents):
        parts = []
        for _ in range(words // 4):
            parts.append(fixed[rng.integers(len(fixed))] if rng.random() < 0.2 else vocabulary[int(rng.integers(6) ** 2)])
            parts.append([" ", "\t", ". ", "\n", "  "][int(min(rng.integers(40), 4))])
        rows.append(("".join(parts), ["en", "de", None][i % 3]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string")


@pytest.mark.parametrize("longest", [2, 3, 4])
@pytest.mark.parametrize("budget", [50, 700, 2_000_000])
def test_against_counting_by_hand(spark, monkeypatch, longest, budget):
    monkeypatch.setattr(phrases, "CHUNK_TOKENS", 900)
    monkeypatch.setattr(phrases, "GROUPS_PER_BUCKET", 5)
    rows = invented(longest)
    got = phrases.collocations(frame(spark, rows), longest=longest, least=5, budget=budget, top=40)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, longest, least=5, top=40)


def test_extended_prefixes_are_shared_by_groups(spark):
    rows = [(f"the w{i % 7} of w{i % 5} the w{i % 3}", "en") for i in range(600)]
    docs = frame(spark, rows)
    numbered = phrases._numbered(
        docs.selectExpr("0 AS none", "named_struct('lang', lang, 'text', text) AS row")
    )
    dictionary = numbered.selectExpr("chunk", "posexplode(words) AS (place, word)", "n").selectExpr(
        "chunk", "place", "word", "n[place] AS n"
    )
    vocabulary = {r.word: r for r in phrases._vocabulary(dictionary, 10, 300).collect()}
    assert vocabulary[b"en\nthe"].parts >= 4
    assert all(r.parts == 1 for r in vocabulary.values() if r.f <= 300)
    got = phrases.collocations(docs, budget=300)
    assert sorted(map(tuple, got.collect())) == by_hand(rows)


def test_subtree_totals():
    rows = [(1, 2, 3), (1, 2, 0), (1, 2, 3), (1, 4, 0), (5, 6, 7)]
    columns = [np.array(c) for c in zip(*rows, strict=True)]
    nodes = {depth: dict(zip(map(tuple, p.tolist()), f.tolist(), strict=True)) for depth, p, f in
             phrases.subtree(columns, np.array([1, 2, 3, 4, 5]))}
    assert nodes == {2: {(1, 2): 6, (1, 4): 4, (5, 6): 5}, 3: {(1, 2, 3): 4, (5, 6, 7): 5}}


def test_rows_of_large_numbers_in_order():
    big = 1 << 40
    columns = [np.array([big, 1, big]), np.array([big, 2, big]), np.array([3, big, 3])]
    rows, n = phrases._distinct(columns, np.array([1, 2, 3]))
    assert [c.tolist() for c in rows] == [[1, big], [2, big], [big, 3]] and n.tolist() == [2, 4]


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 300_000_000_000_017, 400_000_000_000_003, 390_000_000_000_001
    phrases_ = spark.createDataFrame([([1], l), ([2], r)], "ids array<long>, f long")
    candidates = spark.createDataFrame([([1, 2], a)], "ids array<long>, a long")
    (row,) = phrases._scored(candidates, phrases_).collect()
    assert (row.l, row.r, row.score) == (l, r, 1_000_000 * a * a // (l * r))


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    got = sorted(map(tuple, phrases.collocations(odd_docs, least=2).collect()))
    assert got == by_hand([(r.text, r.lang) for r in odd_docs.collect()], least=2)
    assert phrases.collocations(no_docs).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(no_docs, longest=1)
