import hashlib
import os
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tenura.llm import periodic_runs
from tenura.llm.queries import QUERIES

DATA = os.environ.get("TENURA_TEST_DATA", "/root/testdata/sf0.001")


def by_hand(words, least=6, times=4):
    """start, length, period of all runs, by start, then period."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def together(sequences, least, times):
    sizes = np.array([len(s) for s in sequences], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    words = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int64)
    for a, s in zip(starts, sequences, strict=True):
        words[a : a + len(s)] = s
    words[np.concatenate([[0], starts + sizes])] = 100 + np.arange(len(sizes) + 1)
    out = [[] for _ in sequences]
    for begin, end, q in zip(*periodic_runs.runs_of(words, starts, sizes, least, times), strict=True):
        d = int(np.searchsorted(starts, begin, side="right")) - 1
        out[d].append((int(begin - starts[d]), int(end - begin), int(q)))
    return out


@pytest.mark.parametrize("root", [2, 3, 8])
@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 300])
@pytest.mark.parametrize("letters", [1, 2, 5])
def test_common_extensions(root, n, letters):
    rng = np.random.default_rng(n)
    words = rng.integers(0, letters, n)
    common = periodic_runs.CommonExtensions(words, root)
    i, j = rng.integers(0, n, 500), rng.integers(0, n, 500)
    i, j = i[i != j], j[i != j]

    def compared(a, b):
        t = 0
        while max(a, b) + t < n and words[a + t] == words[b + t]:
            t += 1
        return t

    assert common(i, j).tolist() == [compared(a, b) for a, b in zip(i, j, strict=True)]


def test_cover_has_every_difference():
    common = periodic_runs.CommonExtensions(np.zeros(10, np.int64))
    inside = set(common.cover.tolist())
    assert len(inside) < common.v // 4
    assert all((x + d) % common.v in inside for d, x in enumerate(common.first.tolist()))


@pytest.mark.parametrize("least, times", [(6, 4), (6, 2), (2, 2), (3, 3), (20, 2)])
def test_runs_of_random_sequences(least, times):
    rng = np.random.default_rng(least * times)
    for _ in range(30):
        sequences = []
        for _ in range(rng.integers(1, 12)):
            n, letters = int(rng.integers(0, 200)), int(rng.integers(1, 5))
            own = rng.integers(0, letters, n).tolist()
            if rng.random() < 0.6 and n > 4:
                a = int(rng.integers(0, n))
                p = 1 + int(rng.integers(0, max(1, (n - a) // 3)))
                own = [own[x] if x < a else own[a + (x - a) % p] for x in range(n)]
            sequences.append(own)
        assert together(sequences, least, times) == [by_hand(s, least, times) for s in sequences]


def test_grid_meets_blocks_of_any_size(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    own = [1, 2, 3] * 9 + [4] * 8 + [5, 6, 7, 8, 9] * 5
    assert together([own, [], own[::-1]], 6, 4) == [by_hand(own), [], by_hand(own[::-1])]


def test_texts(spark, odd_docs):
    rows = periodic_runs.find_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    expected = []
    for doc_id, text in texts:
        words = (text or "").encode().split()
        runs = [(0, 60_000, 4)] if doc_id == 6 else by_hand(words)
        expected.append((doc_id or -1, len(words), runs, b" ".join(collapsed(words, runs)).decode()))
    assert sorted((r.doc_id or -1, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows) == sorted(expected)


def test_empty_table_and_wrong_parameters(spark, no_docs):
    assert periodic_runs.find_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(no_docs, times=1)


def test_documents_beyond_a_batch(spark, make_docs, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 50)
    texts = [f"a{i} " + f"b{i} c " * (i % 9) for i in range(60)]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.find_runs(make_docs(texts)).collect()}
    assert got == {i: by_hand(t.split()) for i, t in enumerate(texts)}


def planted_by_hand(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected_row(doc_id, text):
    words = planted_by_hand(doc_id, text)
    runs = by_hand(words)
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    return (
        len(runs),
        *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
    )


def test_query_against_brute_force(spark):
    got = QUERIES["op12_periodic_runs"](spark, DATA).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(got) == len(docs)
    with_runs = 0
    for r in got:
        with_runs += r.n_runs > 0
        assert tuple(r)[1:] == expected_row(r.doc_id, docs[r.doc_id]), r.doc_id
    assert with_runs > 5
