import numpy as np
import pytest

from tenura.llm import ann


def table(spark, vectors, ids=None):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def exact(vectors, ids, every, k=10):
    x = np.array(vectors, np.float32).astype(np.float64)
    out = {}
    for q in [i for i, v in enumerate(ids) if v % every == 0]:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:k]
        out[ids[q]] = [(ids[i], d[i]) for i in order]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(3000, 16))
    got = {}
    for r in ann.nearest(table(spark, vectors), every=50).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(vectors, list(range(3000)), 50)
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    x = vectors.astype(np.float32).astype(np.float64)
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        assert all(s == pytest.approx(np.sqrt(((x[v] - x[q]) ** 2).sum()), abs=1e-12) for _, v, s in found)


def test_exact_when_all_cells_are_probed_also_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(ann, "ROWS_AT_ONCE", 40)
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.normal(size=(200, 6)), np.tile(rng.normal(size=6), (150, 1))])
    ids = list(range(350))
    rows = ann.nearest(table(spark, vectors), every=10, share=1.0).collect()
    want = exact(vectors, ids, 10)
    got = {q: [r.vec_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in want}
    assert got == {q: [v for v, _ in found] for q, found in want.items()}


def test_vectors_of_several_lengths_and_of_one_component(spark):
    rng = np.random.default_rng(4)
    ids, vectors = list(range(600)), []
    for i in ids:
        vectors.append(rng.normal(size=(1, 5, 8)[i // 10 % 3]).astype(np.float32))
    rows = ann.nearest(table(spark, vectors, ids), every=10, share=1.0).collect()
    got = {q: [r.vec_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in ids[::10]}
    for length in (1, 5, 8):
        own = [i for i in ids if len(vectors[i]) == length]
        want = exact([vectors[i] for i in own], own, 10)
        assert {q: got[q] for q in want} == {q: [v for v, _ in found] for q, found in want.items()}


def test_recall_at_the_default_share_on_the_given_vectors(spark):
    """Measured against brute force on all given rows, whose vectors are close to uniform."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted(((r.vec_id, r.embedding) for r in given.collect()), key=lambda r: r[0])
    ids, vectors = [r[0] for r in rows], [r[1] for r in rows]
    want = exact(vectors, ids, 100)
    hits = {(r.query_id, r.vec_id) for r in ann.nearest(given).collect()}
    assert len(hits & {(q, v) for q, found in want.items() for v, _ in found}) >= 0.95 * 10 * len(want)


def test_cells_come_by_growing_distance():
    rng = np.random.default_rng(2)
    index = ann.MultiIndex(rng.normal(size=(5, 3)), rng.normal(size=(7, 3)), np.ones((5, 7), np.int64))
    v = rng.normal(size=6)
    one, two = ((index.first - v[:3]) ** 2).sum(axis=1), ((index.second - v[3:]) ** 2).sum(axis=1)
    sums = np.add.outer(one, two)
    for wanted in (1, 4, 20, 35):
        taken = index.probe(v, wanted)
        assert taken.sum() == wanted and sums[taken].max() <= np.sort(sums.ravel())[wanted - 1]


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0, 3.0, 4.0], "a"),
        (1, [1.0, 2.0, 3.0, 5.0], "a"),
        (1, [1.0, 2.0, 3.0, 5.0], "a"),
        (2, None, "a"),
        (3, [], "a"),
        (4, [0.0] * 4, "a"),
        (5, [1.0, None, 0.0, 0.0], "a"),
        (6, [1.0, nan, 0.0, 0.0], "a"),
        (7, [1.0, inf, 0.0, 0.0], "a"),
        (100, [1.0, 2.0], "a"),
        (201, [1.0, 3.0], "a"),
        (300, [7.0], "a"),
        (301, [7.5], "a"),
        (302, [-7.0], "a"),
        (None, [1.0, 2.0, 3.0, 4.0], "a"),
        (200, [1.0, 2.0, 3.0, 4.0], "a"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df).collect() if r.vec_id is not None)
    assert [g[0] for g in got] == [0, 0, 0, 100, 200, 200, 200, 300, 300]
    assert {(q, v, s) for q, _, v, s in got} == {
        *{(0, 200, 0.0), (0, 1, 1.0), (200, 0, 0.0), (200, 1, 1.0)},
        *{(100, 201, 1.0), (300, 301, 0.5), (300, 302, 14.0)},
    }
    assert ann.nearest(df.where("false")).count() == 0
