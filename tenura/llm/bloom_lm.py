"""Language model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.llm.chunks import chunks, pack, pack_by_chunk, unpack, unpack_places
from tenura.llm.common import by_batch, held_out
from tenura.session import store

END = b""  # one end after the words of a text; no word is empty
LEVELS = 48  # counts are quantised to 1 + floor(log2(count)), below this
HASHES = 6
BITS_PER_ENTRY = 12
FILTER_BYTES = 96 << 20  # broadcast at a time; larger filters take several passes
PAIRS_PER_SLICE = 500_000


def tokens(text: str | None) -> list[bytes]:
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def quantise(counts: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + floor(log2(count))."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def typical(codes: np.ndarray) -> np.ndarray:
    """The mean of the counts that share a code."""
    return np.where(codes > 0, (3.0 * 2.0 ** (np.maximum(codes, 1) - 1) - 1) / 2, 0.0)


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pair_hashes(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token the hash of it and the token before it, and that token's place; an end is before the first."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[:1] = ids[-1:]  # the last token is an end
    return _mix(hashes[before] * np.uint64(0x9E3779B97F4A7C15) + hashes[ids]), before


def _slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)


@dataclass
class BloomCounts:
    """Filters of consecutive slices of the hash range, one behind the other.

    A pair with code j was entered j times, once per level; its code is found
    by probing level after level until one is missing. A slice without bits
    has no pairs, or belongs to another part of the whole filter.
    """

    slices: int
    parts: int
    part: int
    starts: np.ndarray  # first bit of each slice
    sizes: np.ndarray  # bits of each slice
    bits: np.ndarray

    def owns(self, hashes: np.ndarray) -> np.ndarray:
        """Which pairs this part of the whole filter answers for."""
        return _slice_of(hashes, self.slices).astype(np.int64) * self.parts // self.slices == self.part

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        where = _slice_of(hashes, self.slices).astype(np.int64)
        found = np.zeros(len(hashes), np.int64)
        alive = np.flatnonzero(self.sizes[where] > 0)
        level = 1
        while len(alive) and level < LEVELS:
            for k in range(HASHES):
                at = where[alive]
                bit = self.starts[at] + _bit(hashes[alive], level, k, self.sizes[at])
                alive = alive[(self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
            found[alive] = level
            level += 1
        return found


def _bit(hashes: np.ndarray, level: int, k: int, sizes: np.ndarray) -> np.ndarray:
    one = _mix(hashes + np.uint64(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
    two = (one >> np.uint64(32)) | np.uint64(1)
    return ((one + np.uint64(k) * two * np.uint64(0x2545F4914F6CDD1D)) % sizes.astype(np.uint64)).astype(np.int64)


def slice_filter(hashes: np.ndarray, codes: np.ndarray, n_bits: int) -> bytes:
    bits = np.zeros(n_bits, bool)
    sizes = np.full(len(hashes), n_bits)
    for level in range(1, int(codes.max(initial=0)) + 1):
        entered = codes >= level
        for k in range(HASHES):
            bits[_bit(hashes[entered], level, k, sizes[entered])] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _numbered(docs: DataFrame, kind: str) -> DataFrame:
    """A row per chunk: its documents' ids, which learn, their numbers of tokens, and the tokens as places in words.

    ``n`` counts each word's training tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, tokens):
            learns = c.rows["learns"].to_numpy()
            n = np.bincount(c.ids[np.repeat(learns, c.lengths)], minlength=len(c.words))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c.number], pa.int64()),
                    pa.array([c.rows["doc_id"].to_pylist()], pa.list_(c.rows.schema.field("doc_id").type)),
                    pa.array([learns.tolist()], pa.list_(pa.bool_())),
                    pa.array([pack(c.lengths.astype("<i4"))], pa.binary()),
                    pa.array([pack(c.ids.astype("<i4"))], pa.binary()),
                    pa.array([c.words], pa.list_(pa.binary())),
                    pa.array([n], pa.list_(pa.int64())),
                ],
                ["chunk", "doc_ids", "learns", "lengths", "ids", "words", "n"],
            )

    return docs.mapInArrow(
        run,
        f"chunk long, doc_ids array<{kind}>, learns array<boolean>, lengths binary, ids binary, "
        "words array<binary>, n array<long>",
    )


def _pair_counts(numbered: DataFrame, slices: int) -> DataFrame:
    """slice, steps (between sorted hashes), codes, entries: all pairs of training tokens.

    Pairs are counted within a chunk before the shuffle, which moves packed
    arrays by slice of the hash range; a slice holds a bounded share of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i in ((batch, i) for batch in batches for i in range(batch.num_rows)):
            ids, learns, lengths, words = (batch.column(c)[i].as_py() for c in range(4))
            learns = np.repeat(np.array(learns, bool), unpack(lengths, "<i4"))
            hashes, _ = pair_hashes(unpack(ids, "<i4"), word_hashes(words))
            pairs, n = np.unique(hashes[learns], return_counts=True)
            where = _slice_of(pairs, slices).astype(np.int64)
            cuts = np.flatnonzero(np.diff(where, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(pairs)), strict=False):  # none without training tokens
                # sorted hashes: small differences, many zero bytes
                steps = np.diff(pairs[a:b], prepend=np.uint64(0)).astype("<u8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(where[a])], pa.int64()),
                        pa.array([pack(steps)], pa.binary()),
                        pa.array([pack(n[a:b].astype("<u4"))], pa.binary()),
                    ],
                    ["slice", "steps", "n"],
                )

    def combine(table: pa.Table) -> pa.Table:
        pairs = np.concatenate([np.cumsum(unpack(x, "<u8"), dtype=np.uint64) for x in table["steps"].to_pylist()])
        n = np.concatenate([unpack(x, "<u4") for x in table["n"].to_pylist()]).astype(np.int64)
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order]
        firsts = np.flatnonzero(np.diff(pairs, prepend=pairs[:1] ^ np.uint64(1)))
        total = np.add.reduceat(n, firsts)
        codes = quantise(total)
        steps = np.diff(pairs[firsts], prepend=np.uint64(0)).astype("<u8")
        return pa.table(
            {
                "slice": table["slice"][:1],
                "steps": pa.array([pack(steps)], pa.binary()),
                "codes": pa.array([codes.astype(np.uint8).tobytes()], pa.binary()),
                "entries": pa.array([int(codes.sum())], pa.int64()),
            }
        )

    parts = numbered.select("ids", "learns", "lengths", "words").mapInArrow(
        count, "slice long, steps binary, n binary"
    )
    return parts.groupBy("slice").applyInArrow(combine, "slice long, steps binary, codes binary, entries long")


def _filters(pairs: DataFrame, slices: int) -> Iterator[BloomCounts]:
    """The filter in parts of at most about ``FILTER_BYTES`` (a slice at least), one after the other."""

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        made = [
            slice_filter(
                np.cumsum(unpack(s, "<u8"), dtype=np.uint64),
                np.frombuffer(c, np.uint8).astype(np.int64),
                e * BITS_PER_ENTRY,
            )
            for s, c, e in zip(*columns, strict=True)
        ]
        return pa.RecordBatch.from_arrays([batch.column(3), pa.array(made, pa.binary())], ["slice", "bits"])

    size = (pairs.agg(F.sum("entries")).first()[0] or 0) * BITS_PER_ENTRY // 8
    n_parts = max(1, -(-int(size) // FILTER_BYTES))
    for part in range(n_parts):
        own = pairs.where((F.col("entries") > 0) & (F.floor(F.col("slice") * n_parts / slices) == part))
        rows = own.select("steps", "codes", "entries", "slice").mapInArrow(
            by_batch(build), "slice long, bits binary"
        ).toArrow()
        starts, sizes = np.zeros(slices, np.int64), np.zeros(slices, np.int64)
        data, at = [], 0
        entries = {r["slice"]: r["entries"] for r in own.select("slice", "entries").collect()}
        for s, bits in zip(rows["slice"].to_pylist(), rows["bits"], strict=True):
            data.append(np.frombuffer(bits.as_buffer(), np.uint8))
            starts[s], sizes[s] = at, entries[s] * BITS_PER_ENTRY
            at += len(data[-1]) * 8
        yield BloomCounts(slices, n_parts, part, starts, sizes, np.concatenate(data) if data else np.zeros(1, np.uint8))


def cell_of(context, pair, word):
    return (context * LEVELS + pair) * LEVELS + word


def fit_weights(cells: np.ndarray, n: np.ndarray, denominator: float, rounds: int = 40) -> np.ndarray:
    """Log10 probability of every cell (codes of the context, the pair and the word).

    The pair's relative frequency and the word's smoothed one are mixed with a
    weight per code of the context. Weights are estimated by expectation
    maximisation on the training tokens, each left out of its own counts.
    """
    context, rest = np.divmod(np.arange(LEVELS**3), LEVELS**2)
    pair, word = np.divmod(rest, LEVELS)
    base = np.minimum((typical(word) + 1) / denominator, 1.0)
    many = np.maximum(typical(context), 1.0)
    relative = np.minimum(np.where(pair > 0, typical(pair), 0.0) / many, 1.0)
    weight = np.full(LEVELS, 0.3)
    if len(cells):
        left = np.where(pair > 0, typical(pair) - 1, 0.0)  # nothing is left of a pair seen once
        others = np.minimum(left / np.maximum(many - 1, 1.0), 1.0)[cells]
        own = np.maximum(typical(word), 1.0)[cells] / denominator
        for _ in range(rounds):
            w = weight[context[cells]]
            share = w * others / np.maximum(w * others + (1 - w) * own, 1e-300)
            hit = np.bincount(context[cells], weights=n * share, minlength=LEVELS)
            # a few tokens' worth of prior keeps weights of rare contexts inside (0, 1)
            all_ = np.bincount(context[cells], weights=n, minlength=LEVELS)
            weight = (hit + 0.5) / (all_ + 5)
    mixed = weight[context] * relative + (1 - weight[context]) * base
    mixed[context == 0] = base[context == 0]
    return np.log10(mixed)


def _look_up(numbered: DataFrame, kind: str, counts: DataFrame, part: BloomCounts, denominator: float) -> DataFrame:
    """Per document: unigram figures (from the first part) and how many tokens fall in which cell."""
    shared = numbered.sparkSession.sparkContext.broadcast(part)  # at most about FILTER_BYTES

    def look_up(numbers: pa.Table, answers: pa.Table) -> pa.Table:
        ids = unpack(numbers["ids"][0].as_py(), "<i4")
        lengths = unpack(numbers["lengths"][0].as_py(), "<i4").astype(np.int64)
        hashes = word_hashes(numbers["words"][0].as_py())
        (c,) = unpack_places(answers, {"c": "<i8"}, len(hashes))
        starts = np.cumsum(lengths) - lengths
        of_pair, before = pair_hashes(ids, hashes)
        own = shared.value.owns(of_pair)
        pairs, place = np.unique(of_pair[own], return_inverse=True)
        word = quantise(c)
        cell = cell_of(word[before[own]], shared.value.codes(pairs)[place], word[ids[own]])
        doc = np.repeat(np.arange(len(lengths)), lengths)[own]
        both, n = np.unique(doc * LEVELS**3 + cell, return_counts=True)
        cuts = np.searchsorted(both // LEVELS**3, np.arange(len(lengths) + 1)).astype(np.int32)
        first = shared.value.part == 0
        known = np.add.reduceat((c[ids] > 0).astype(np.int64), starts)
        logs = np.log10((c + 1) / denominator)
        return pa.table(
            {
                "chunk": pa.array(np.full(len(lengths), numbers["chunk"][0].as_py())),
                "at": pa.array(np.arange(len(lengths))),
                "doc_id": pa.array(numbers["doc_ids"][0].as_py(), numbers.schema.field("doc_ids").type.value_type),
                "learns": pa.array(numbers["learns"][0].as_py(), pa.bool_()),
                "n_tokens": pa.array(lengths * first),
                "n_known": pa.array(known * first),
                "base_score": pa.array(np.add.reduceat(logs[ids], starts) * first),
                "cell": pa.ListArray.from_arrays(cuts, pa.array((both % LEVELS**3).astype(np.int32))),
                "n": pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int32))),
            }
        )

    return (
        numbered.drop("n")
        .groupBy("chunk")
        .cogroup(counts.groupBy("chunk"))
        .applyInArrow(
            look_up,
            f"chunk long, at long, doc_id {kind}, learns boolean, n_tokens long, n_known long, "
            "base_score double, cell array<int>, n array<int>",
        )
    )


def _sum_logs(cells: DataFrame, logs: np.ndarray) -> DataFrame:
    """``cells`` with the sum of its tokens' log probabilities instead of the cells."""
    shared = cells.sparkSession.sparkContext.broadcast(logs)
    kept = ["chunk", "at", "doc_id", "learns", "n_tokens", "n_known", "base_score"]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell, n = batch.column(len(kept)), batch.column(len(kept) + 1)
        cuts = cell.offsets.to_numpy()
        sums = np.cumsum(shared.value[cell.flatten().to_numpy()] * n.flatten().to_numpy())
        sums = np.concatenate([[0.0], sums])[cuts - cuts[0]]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(len(kept))), pa.array(np.diff(sums))], [*kept, "score"]
        )

    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join([*(f"{c} {types[c]}" for c in kept), "score double"])
    return cells.select(*kept, "cell", "n").mapInArrow(by_batch(make), schema)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7) -> DataFrame:
    """Log10 probabilities of every row's whole text under models of the rows that are not held out.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens
    that training has), train_tokens, base_score (unigrams, one added) and
    score (the pair model). A null text is empty: one end. Without training
    rows both models give every token the same probability.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (~held_out(F.col(doc_id), folds)).alias("learns"),
        F.col(text).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()

    # exact counts of every chunk's words; a word has at most one row per chunk
    same = Window.partitionBy("word")
    numbered = store(_numbered(rows, kind))
    places = numbered.select("chunk", "n", F.posexplode("words").alias("place", "word"))
    counted = places.select("chunk", "place", F.get("n", F.col("place")).alias("n"), "word").select(
        "chunk",
        "place",
        "n",
        F.sum("n").over(same).alias("c"),
        (F.row_number().over(same.orderBy("chunk", "place")) == 1).alias("first"),
    )
    known = F.when(F.col("first") & (F.col("c") > 0), F.lit(1)).otherwise(0).cast("long")
    counts = store(pack_by_chunk(counted.withColumn("types", known), {"c": "<i8"}, ("n", "types")))
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    denominator = float(total + types + 1)

    slices = max(8, total // PAIRS_PER_SLICE)
    pairs = store(_pair_counts(numbered, slices))
    looked_up = None
    for part in _filters(pairs, slices):
        found = _look_up(numbered, kind, counts, part, denominator)
        looked_up = found if looked_up is None else looked_up.unionByName(found)
    cells = store(looked_up)

    seen = (
        cells.where("learns")
        .select(F.explode(F.arrays_zip("cell", "n")).alias("x"))
        .groupBy("x.cell")
        .agg(F.sum("x.n").alias("n"))
        .toArrow()
    )  # one row per combination of three codes at most
    logs = fit_weights(seen["cell"].to_numpy(), seen["n"].to_numpy().astype(np.float64), denominator)
    return (
        _sum_logs(cells, logs)
        .groupBy("chunk", "at")
        .agg(
            F.first("doc_id", ignorenulls=True).alias("doc_id"),
            (~F.first("learns")).alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"),
            F.sum("base_score").alias("base_score"),
            F.sum("score").alias("score"),
        )
        .drop("chunk", "at")
        .withColumn("train_tokens", F.lit(total).cast("long"))
    )
