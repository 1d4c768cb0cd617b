import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tenura.llm import graph, simhash


def fingerprint_by_hand(text, n=3):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def roots_by_hand(nodes, linked):
    parent = {v: v for v in nodes}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in nodes}


def test_fingerprints_follow_their_definition(odd_docs):
    got = simhash.fingerprints(odd_docs).withColumn("text", F.lit(None)).collect()
    expected = sorted(fingerprint_by_hand(r.text) for r in odd_docs.collect())
    assert sorted(r.fp % 2**64 for r in got) == expected


def test_shingle_hash_is_the_engines(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c", 42)


def test_links_are_exactly_the_close_pairs(spark):
    rng = np.random.default_rng(1)
    prints = [int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64)]
    for base in prints[:20]:
        for _ in range(6):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            prints.append(base ^ sum(1 << int(b) for b in flips))
    prints = sorted({p if p < 2**63 else p - 2**64 for p in prints} | {0, 7, -1})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for distance, segments in ((3, 2), (3, 4), (2, 2), (0, 2)):
        got = {tuple(sorted((r.a, r.b))) for r in simhash.hamming_links(df, distance, segments).collect()}
        assert got == {
            (a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if bin((a ^ b) % 2**64).count("1") <= distance
        }


def test_components_reach_along_chains(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    nodes = {v for e in edges for v in e if e[0] != e[1]}
    assert {r.node: r.root for r in got.collect()} == roots_by_hand(nodes, [e for e in edges if e[0] != e[1]])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_against_brute_force(make_docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            copy[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [texts[0]] * 20 + ["", " ", None]
    got = simhash.simhash_components(make_docs(texts, 10)).toPandas().set_index("doc_id")
    prints = [fingerprint_by_hand(t) for t in texts]
    links = [
        (i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3
    ]
    roots = roots_by_hand(range(len(texts)), links)
    assert {i: got.component_id[i + 10] - 10 for i in roots} == roots
    assert [got.fingerprint[i + 10] for i in roots] == [f"{p:016x}" for p in prints]


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.simhash_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    empty = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.component_id for r in empty} == {2} and len(empty) == 4
    assert simhash.simhash_components(no_docs).count() == 0


def test_one_row_of_each_component_stays(odd_docs, make_docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "1", "None", "None", "5", "6", "7", "8"])
    many = simhash.one_of_each(make_docs(["same words here again"] * 50 + ["quite different words in here"]))
    assert sorted(r.doc_id for r in many.collect()) == [0, 50]
