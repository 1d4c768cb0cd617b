"""Approximate nearest neighbours with an inverted multi-index over vector halves."""

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.llm.common import by_batch, hashed_sample
from tenura.session import store

QUERIES_AT_ONCE = 2048  # of a block of queries, against
ROWS_AT_ONCE = 8192  # of a block of index rows


@dataclass
class MultiIndex:
    """Centroids of the two halves, and how many rows each pair of centroids has."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return _nearest(vectors[:, :cut], self.first), _nearest(vectors[:, cut:], self.second)

    def probe(self, vector: np.ndarray, wanted: int) -> np.ndarray:
        """Pairs of centroids by growing summed distance until their rows are ``wanted`` many: a flag per pair.

        A heap holds the pairs next to those already taken in the order of
        both halves' distances, so only as many sums are made as needed.
        """
        cut = self.first.shape[1]
        one = ((self.first - vector[:cut]) ** 2).sum(axis=1)
        two = ((self.second - vector[cut:]) ** 2).sum(axis=1)
        order1, order2 = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        one, two = one[order1].tolist(), two[order2].tolist()
        taken = np.zeros(self.counts.shape, bool)
        heap, seen, rows = [(one[0] + two[0], 0, 0)], {(0, 0)}, 0
        while heap and rows < wanted:
            _, i, j = heapq.heappop(heap)
            a, b = order1[i], order2[j]
            taken[a, b] = True
            rows += int(self.counts[a, b])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(one) and y < len(two) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (one[x] + two[y], x, y))
        return taken


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * points @ centroids.T).argmin(axis=1)


def k_means(points: np.ndarray, k: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """At most ``k`` centroids; empty clusters restart at a random point."""
    if not points.shape[1]:  # the second half of vectors with one component
        return np.zeros((1, 0))
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centroids = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = _nearest(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=len(centroids))
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
        for empty in np.flatnonzero(sizes == 0):
            centroids[empty] = points[rng.integers(len(points))]
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """row, id, x (array of doubles) of rows whose vector is not null, zero, or with null or non-finite components.

    Vectors of different lengths are kept; they have no distance from each other.
    """
    x = F.col("x")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        vectors.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(vec_id).alias("id"),
            F.col(embedding).cast("array<double>").alias("x"),
        )
        .where(x.isNotNull() & (F.size(x) > 0))
        .where(~bad & F.exists(x, lambda v: v != 0))
    )


def nearest(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    share: float = 0.65,
    centroids: int = 64,
    sample: int = 10_000,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows found for each row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score: the Euclidean distance in
    double precision; nearest first, ties to the smaller id. Every other row
    of the same length is a candidate, copies of the query too. Vectors of each
    length have an index of their own: centroids are fitted on at most
    ``sample`` rows, drawn by a hash of the id, and every row is indexed. A
    query traverses cells until they hold ``share`` of the rows, and more than
    ``k``. Rows without a usable vector take no part (see ``usable``), repeated
    rows are candidates each; an empty table gives no rows.
    """
    rows = store(usable(vectors, vec_id, embedding))
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for length in sorted(r[0] for r in rows.select(F.size("x")).distinct().collect()):
        own = rows.where(F.size("x") == length)
        found = found.unionByName(_search_length(own, every, k, share, centroids, sample))
    return found


def _search_length(rows: DataFrame, every: int, k: int, share: float, centroids: int, sample: int) -> DataFrame:
    """``nearest`` for rows whose vectors have one length."""
    spark = rows.sparkSession
    total = rows.count()
    kind = rows.schema["id"].dataType.simpleString()
    drawn = hashed_sample(rows, sample, total, "row", "id", "x").select("x").toArrow()
    points = _matrix(drawn["x"].combine_chunks())
    cut = max(1, points.shape[1] // 2)
    many = max(1, min(centroids, len(points) // 8))
    index = MultiIndex(k_means(points[:, :cut], many), k_means(points[:, cut:], many), np.zeros(0))
    bare = spark.sparkContext.broadcast(index)

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, two = bare.value.cells(_matrix(batch.column(2)))
        cells = [pa.array(c.astype(np.int32)) for c in (one, two)]
        return pa.RecordBatch.from_arrays([*batch.columns, *cells], ["row", "id", "x", "one", "two"])

    indexed = store(
        rows.mapInArrow(by_batch(assign), f"row long, id {kind}, x array<double>, one int, two int")
    )
    counts = np.zeros((len(index.first), len(index.second)), np.int64)
    for r in indexed.groupBy("one", "two").count().collect():  # centroids squared at most
        counts[r["one"], r["two"]] = r["count"]
    full = spark.sparkContext.broadcast(MultiIndex(index.first, index.second, counts))
    wanted = min(total, max(k + 1, int(share * total)))

    # index rows of a first centroid lie in blocks, however many it has; queries come in blocks too
    salts = np.maximum(1, -(-counts.sum(axis=1) // ROWS_AT_ONCE))
    queries = indexed.where(F.col("id") % every == 0)
    blocks = max(1, -(-queries.count() // QUERIES_AT_ONCE))

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = _matrix(batch.column(2))
        out = {c: [] for c in ("one", "salt", "at", "cells")}
        for i, v in enumerate(vectors):
            taken = full.value.probe(v, wanted)
            for one in np.flatnonzero(taken.any(axis=1)):
                bits = np.packbits(taken[one], bitorder="little").tobytes()
                for salt in range(salts[one]):
                    for c, value in zip(out, (one, salt, i, bits), strict=True):
                        out[c].append(value)
        at = pa.array(out["at"], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(out["one"], pa.int32()),
                pa.array(out["salt"], pa.int32()),
                *(batch.column(i).take(at) for i in (3, 0, 1, 2)),
                pa.array(out["cells"], pa.binary()),
            ],
            ["one", "salt", "block", "query_row", "query_id", "q", "cells"],
        )

    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    probes = queries.select("row", "id", "x", block).mapInArrow(
        by_batch(probe),
        f"one int, salt int, block int, query_row long, query_id {kind}, q array<double>, cells binary",
    )
    of_one = F.element_at(F.array(*[F.lit(int(s)) for s in salts]), F.col("one") + 1)
    entries = indexed.select(
        "one",
        F.pmod(F.xxhash64("row"), of_one).cast("int").alias("salt"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "row",
        "id",
        "x",
        "two",
    )

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "vec_id", "score"]
        types = [pa.int64(), asked.schema.field("query_id").type, held.schema.field("id").type, pa.float64()]
        if not asked.num_rows or not held.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        q, x = (_matrix(t[c].combine_chunks()) for t, c in ((asked, "q"), (held, "x")))
        rows, two = held["row"].to_numpy(), held["two"].to_numpy()
        ids, query_rows = held["id"].to_numpy(zero_copy_only=False), asked["query_row"].to_numpy()
        squares = (x**2).sum(axis=1)
        found = [[], [], []]
        for a in range(0, len(q), 256):
            part = q[a : a + 256]
            rough = squares + (part**2).sum(axis=1)[:, None] - 2 * part @ x.T
            slack = 1e-9 * (squares.max() + (part**2).sum(axis=1).max())
            for i in range(len(part)):
                probed = np.unpackbits(np.frombuffer(asked["cells"][a + i].as_py(), np.uint8), bitorder="little")
                mine = np.flatnonzero((probed[two] == 1) & (rows != query_rows[a + i]))
                if not len(mine):
                    continue
                near = rough[i, mine]
                if len(mine) > k:
                    mine = mine[near <= np.partition(near, k - 1)[k - 1] + slack]
                exact = np.sqrt(((x[mine] - part[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[mine], exact))[:k]
                found[0].append(np.full(len(best), a + i))
                found[1].append(mine[best])
                found[2].append(exact[best])
        at, of, score = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)
        at, of = pa.array(at, pa.int64()), pa.array(of, pa.int64())
        return pa.table(
            [asked["query_row"].take(at), asked["query_id"].take(at), held["id"].take(of), pa.array(score, pa.float64())],
            names,
        )

    key = ["one", "salt", "block"]
    best = (
        probes.groupBy(*key)
        .cogroup(entries.groupBy(*key))
        .applyInArrow(search, f"query_row long, query_id {kind}, vec_id {kind}, score double")
    )
    order = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(
            F.col("query_id").cast("long").alias("query_id"),
            "rank",
            F.col("vec_id").cast("long").alias("vec_id"),
            "score",
        )
    )
