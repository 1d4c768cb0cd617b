import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.llm import bloom_lm, chunks
from tenura.llm.common import held_out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(4000)]
    out = []
    for _ in range(150):
        a = rng.randrange(len(words) - 60)
        out.append(" ".join(words[a : a + rng.randrange(1, 60)]).upper())
    return out + [None, "", " \t "]


def exact(texts, first=0):
    tokens = [(t or "").encode().lower().split() + [b""] for t in texts]
    held = [zlib.crc32(str(first + i).encode()) % 7 == 2 for i in range(len(texts))]
    counts = collections.Counter(t for own, h in zip(tokens, held, strict=True) if not h for t in own)
    pairs = collections.Counter(
        p for own, h in zip(tokens, held, strict=True) if not h for p in zip([b"", *own], own, strict=False)
    )
    return tokens, held, counts, pairs


def check(rows, texts):
    tokens, held, counts, _ = exact(texts)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(own), n)
        assert r.n_known == sum(t in counts for t in own)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own))
        assert r.score < 0


def test_against_exact_counts(make_docs, texts):
    rows = bloom_lm.score(make_docs(texts)).collect()
    check(rows, texts)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_several_chunks_and_filter_parts(make_docs, texts, monkeypatch):
    whole = {r.doc_id: r for r in bloom_lm.score(make_docs(texts)).collect()}
    monkeypatch.setattr(bloom_lm, "FILTER_BYTES", 64)
    parts = bloom_lm.score(make_docs(texts)).collect()
    check(parts, texts)
    assert all(r.score == pytest.approx(whole[r.doc_id].score) for r in parts)


def test_filter_returns_quantised_counts():
    rng = np.random.default_rng(0)
    hashes = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2))
    counts = rng.zipf(1.5, len(hashes)).clip(2, 10**6)
    codes = bloom_lm.quantise(counts)
    assert (codes == np.floor(np.log2(counts)) + 1).all()
    where = bloom_lm._slice_of(hashes, 8).astype(int)
    data, starts, sizes, at = [], np.zeros(8, int), np.zeros(8, int), 0
    for s in range(8):
        own = where == s
        n = int(codes[own].sum()) * bloom_lm.BITS_PER_ENTRY
        data.append(np.frombuffer(bloom_lm.slice_filter(hashes[own], codes[own], n), np.uint8))
        starts[s], sizes[s] = at, n
        at += len(data[-1]) * 8
    counts_ = bloom_lm.BloomCounts(8, 1, 0, starts, sizes, np.concatenate(data))
    found = counts_.codes(hashes)
    assert (found >= codes).all() and (found == codes).mean() > 0.98  # never too small, seldom too large
    others = hashes + np.uint64(1)
    assert (counts_.codes(others) > 0).mean() < 0.02


def test_weights_are_a_mixture():
    logs = bloom_lm.fit_weights(np.zeros(0, int), np.zeros(0), 1000.0)
    assert len(logs) == bloom_lm.LEVELS**3 and (logs <= 0).all()
    # pairs that repeat get weight, pairs that never do get none
    repeat = bloom_lm.cell_of(np.array([8]), np.array([6]), np.array([6]))
    never = bloom_lm.cell_of(np.array([8]), np.array([0]), np.array([6]))
    high = bloom_lm.fit_weights(repeat, np.array([1000.0]), 1e5)
    low = bloom_lm.fit_weights(never, np.array([1000.0]), 1e5)
    assert high[repeat] > low[repeat] and high[never] < low[never]


def test_packed_numbers():
    for kind in ("<i4", "<i8", "<u8"):
        x = np.random.default_rng(1).integers(0, 2**31 - 1, 1000).astype(kind)
        assert (chunks.unpack(chunks.pack(x), kind) == x).all()
    assert len(chunks.unpack(chunks.pack(np.zeros(0, "<i4")), "<i4")) == 0


def test_odd_rows(odd_docs, no_docs):
    rows = bloom_lm.score(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert {r.n_tokens for r in rows if r.doc_id == 6} == {60_001}
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert bloom_lm.score(no_docs).count() == 0
    nothing = bloom_lm.score(odd_docs.where("doc_id IS NULL")).collect()
    assert [(r.train_tokens, r.base_score, r.score) for r in nothing] == [(0, 0.0, 0.0)] * 2


def test_every_training_pair_is_entered(make_docs, texts):
    rows = make_docs(texts).select("doc_id", (~held_out(F.col("doc_id"), 7)).alias("learns"), "text")
    made = bloom_lm._pair_counts(bloom_lm._numbered(rows, "bigint"), 8).collect()
    got = collections.Counter(c for r in made for c in np.frombuffer(r.codes, np.uint8).tolist())
    _, _, _, pairs = exact(texts)
    assert got == collections.Counter(bloom_lm.quantise(np.array(list(pairs.values()))).tolist())
    assert got[1] > 0


def test_a_pair_seen_once_counts_but_not_for_itself():
    once = bloom_lm.cell_of(np.array([3]), np.array([1]), np.array([3]))
    never = bloom_lm.cell_of(np.array([3]), np.array([0]), np.array([3]))
    logs = bloom_lm.fit_weights(once, np.array([1000.0]), 1e5)
    assert logs[once] > logs[never]
    assert (logs == bloom_lm.fit_weights(never, np.array([1000.0]), 1e5)).all()  # left out, it is unseen
