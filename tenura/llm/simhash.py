"""Near duplicates by SimHash fingerprints, linked through a multi-index of Hamming balls."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import by_batch, free_name, join_counted, row_key
from tenura.llm.graph import components
from tenura.session import store

BITS = 64
HOT_SHARE = 1000  # a key on a thousandth of all rows, of which there are as many at most, is handled apart

# Byte value -> its eight bits as counters in the eight bytes of a word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint8).copy().view(np.uint64).ravel()


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the highest bit down."""
    counts = np.zeros(BITS, np.int64)
    data = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(data), 255):  # a lane counts to 255
        lanes = _LANES[data[at : at + 255]].sum(axis=0, dtype=np.uint64)
        counts += lanes.view(np.uint8).reshape(BITS)
    return counts


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    whole = b" ".join(tokens)
    starts = np.zeros(len(tokens), np.int64)
    np.cumsum([len(t) + 1 for t in tokens[:-1]], out=starts[1:])
    ends = np.append(starts[1:] - 1, len(whole))
    size = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), ends[size - 1 :].tolist(), strict=False)
    return np.fromiter((digest(whole[a:b], 42) for a, b in spans), np.uint64, len(tokens) - size + 1)


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits, each set if more than half of the shingles' hashes have it."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    return int.from_bytes(np.packbits(_bit_counts(hashes) * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
        prints = pa.array(np.array(values, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "fp"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(by_batch(make), f"doc_id {kind}, fp long")


def hamming_links(prints: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """Pairs of different fingerprints at most ``distance`` bits apart: a, b.

    Of two such fingerprints at least one of the ``segments`` equal parts
    differs in at most distance // segments bits. So each fingerprint looks up,
    in a table of all parts, every value in a ball of that radius around its
    own parts, and the whole distance is verified in the join. Of the two ways
    to find a pair only the one is taken where the lowest flipped bit is set.
    """
    width = BITS // segments
    radius = distance // segments
    flips = [0] + [
        sum(1 << i for i in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)
    ]
    low = (1 << width) - 1
    parts = prints.select(
        "fp",
        F.posexplode(
            F.array(
                *[
                    F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit(low).cast("long"))
                    for k in range(segments)
                ]
            )
        ).alias("part", "value"),
    )
    probes = (
        parts.withColumn("flip", F.explode(F.lit(flips).cast("array<long>")))
        .where((F.col("flip") == 0) | (F.col("value").bitwiseAND(F.col("flip")).bitwiseAND(-F.col("flip")) != 0))
        .select(F.col("fp").alias("a"), "part", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), "flip")
    )
    return (
        probes.alias("p")
        .join(parts.alias("t"), ["part", "value"])
        .where(
            ((F.col("p.flip") != 0) | (F.col("p.a") < F.col("t.fp")))
            & (F.bit_count(F.col("p.a").bitwiseXOR(F.col("t.fp"))) <= distance)
        )
        .select("a", F.col("t.fp").alias("b"))
    )


def simhash_components(
    docs: DataFrame, words: int = 3, distance: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Fingerprint and component of every row: doc_id, fingerprint, component_id.

    component_id is the smallest doc_id that links reach. Copies share a
    fingerprint and are linked once, as one node. A null or empty text, or one
    of white space only, has fingerprint zero and is linked like any other; a
    row without an id takes part and never names a component that has an id.
    """
    rows = store(fingerprints(docs, words, doc_id, text))
    distinct = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(hamming_links(distinct.select("fp"), distance))
    linked = store(
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
            "root", F.coalesce("root", "fp")
        )
    )
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = store(linked.join(ids, "root").select("fp", "n", "component_id"))
    return join_counted(rows, named, "fp", "n").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, words: int = 3, distance: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one row of each component: of the smallest doc_id, and of the smallest hash among its texts.

    A row without an id comes before those with one, as NULL sorts first. Null,
    empty and blank texts are one component; repeated rows leave one. All
    columns stay as they are, whatever they are called.
    """
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, row_key(docs, doc_id, text))
    found = store(simhash_components(keyed, words, distance, key, text))
    kept = store(
        found.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n"))
    )
    # equal rows share a key: where they are many they are broadcast and combined before the shuffle
    hot = F.col("n") * HOT_SHARE >= F.lit(max(found.count(), HOT_SHARE))
    hot_keys = F.broadcast(kept.where(hot).limit(HOT_SHARE).select(key))
    usual = keyed.join(hot_keys, key, "left_anti").join(kept.where(~hot), key, "left_semi").dropDuplicates([key])
    repeated = keyed.join(hot_keys, key, "left_semi").dropDuplicates([key])
    return usual.unionByName(repeated).drop(key)
