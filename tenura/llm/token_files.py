"""Token ids of a corpus in binary blocks: patched frame of reference, with an index of block starts.

A file table holds segments in ascending order of document id. A segment is
one binary value: a header, the word at which every block starts, and blocks
of ``BLOCK`` ids. A block stores its smallest id, the differences to it packed
at the width that a percentile of them needs, and the rest of each larger
difference in a list of exceptions (places, high parts). The segments lie in
Parquet files, so that Spark writes them whole or not at all and a lost
executor costs a repeated task.
"""

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 128  # ids, as 32 rows of 4 lanes
MAGIC = 0x524F4650  # the bytes PFOR
HEADER = 3  # words before the block starts: magic, ids, blocks
PERCENTILE = 90  # of a block's differences fit the packed width
SEGMENT = 1 << 18  # ids; a segment ends with the document that reaches this
BYTES_PER_TASK = 64 << 20  # of text, for each task that writes
KNOWN_UNITS = 1_000_000  # encoded units that a worker remembers at a time

# A blank before a letter always begins a new unit of the tokenizers' usual split pattern,
# whatever stands before it; only letters that every Unicode version has are taken.
_LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
_UNIT = re.compile(f" {_LETTER}")


def _pack_rows(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) differences below 2**width as (blocks, 4 * width) words."""
    v = values.reshape(-1, 32, 4)
    out = np.zeros((len(v), width, 4), np.uint32)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        out[:, word] |= v[:, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= v[:, i] >> np.uint32(32 - shift)
    return out.reshape(len(v), -1)


def _unpack_rows(words: np.ndarray, width: int) -> np.ndarray:
    v = words.reshape(-1, width, 4)
    mask = np.uint32((1 << width) - 1)
    out = np.empty((len(v), 32, 4), np.uint32)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        out[:, i] = v[:, word] >> np.uint32(shift)
        if shift + width > 32:
            out[:, i] |= v[:, word + 1] << np.uint32(32 - shift)
    return (out & mask).reshape(len(v), BLOCK)


def encode_segment(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Ids (0 to 2**32 - 1) as one segment. The last block is filled up with its smallest id."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    values = np.asarray(ids).astype(np.uint32)
    filled = np.empty(blocks * BLOCK, np.uint32)
    filled[:n] = values
    if blocks:
        filled[n:] = values[(blocks - 1) * BLOCK :].min()
    filled = filled.reshape(blocks, BLOCK)
    base = filled.min(axis=1, initial=0xFFFFFFFF)
    rest = filled - base[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    rank = max(0, -(-int(BLOCK * percentile) // 100) - 1)
    width = np.sort(bits, axis=1)[:, rank] if blocks else np.zeros(0, np.int64)
    outlier = bits > width[:, None]
    exceptions = outlier.sum(axis=1)
    size = 2 + 4 * width + -(-exceptions // 4) + exceptions
    starts = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint32)
    body[starts] = base
    body[starts + 1] = (width | exceptions << 8).astype(np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        low = rest[own] & np.uint32((1 << w) - 1)
        body[starts[own][:, None] + 2 + np.arange(4 * w)] = _pack_rows(low, w)
    block, place = np.nonzero(outlier)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    lists = starts + 2 + 4 * width
    body.view(np.uint8)[lists[block] * 4 + nth] = place
    body[(lists + -(-exceptions // 4))[block] + nth] = rest[block, place] >> width[block].astype(np.uint32)
    header = np.array([MAGIC, n, blocks], np.uint32)
    return np.concatenate([header, starts.astype(np.uint32), body]).astype("<u4").tobytes()


def segment_size(data: bytes) -> int:
    """The number of ids in a segment."""
    magic, n, _ = np.frombuffer(data, "<u4", HEADER)
    if magic != MAGIC:
        raise ValueError("this is no segment of token ids")
    return int(n)


def decode_segment(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from place ``first`` to before ``last`` (the end); only their blocks are unpacked."""
    n = segment_size(data)
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    words = np.frombuffer(data, "<u4").astype(np.uint32, copy=False)
    blocks = int(words[2])
    a, b = first // BLOCK, -(-last // BLOCK)
    starts = words[HEADER + a : HEADER + b].astype(np.int64) + HEADER + blocks
    width = (words[starts + 1] & np.uint32(0xFF)).astype(np.int64)
    exceptions = (words[starts + 1] >> np.uint32(8)).astype(np.int64)
    rest = np.zeros((b - a, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        rest[own] = _unpack_rows(words[starts[own][:, None] + 2 + np.arange(4 * w)], w)
    block = np.repeat(np.arange(b - a), exceptions)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    lists = starts + 2 + 4 * width
    place = words.view(np.uint8)[lists[block] * 4 + nth]
    high = words[(lists + -(-exceptions // 4))[block] + nth]
    rest[block, place] |= high << width[block].astype(np.uint32)
    ids = (rest + words[starts][:, None]).reshape(-1)
    return ids[first - a * BLOCK : last - a * BLOCK]


def _is_letter(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether a character with these UTF-8 bytes is a ``_LETTER``."""
    upper = first & 0xDF
    plain = (first < 0x80) & (upper >= ord("A")) & (upper <= ord("Z"))
    latin = (first == 0xC3) & (second != 0x97) & (second != 0xB7)  # no multiplication or division sign
    return plain | latin | (first >= 0xC4) & (first <= 0xC8) | (first == 0xC9) & (second <= 0x8F)


class Encoder:
    """A tokenizer file's ids for many texts; units that recur are encoded once.

    Texts are cut where the split pattern of byte-level tokenizers always
    begins a new unit, so the ids are those of the whole text. Tokenizers
    with another split pattern encode every text as one unit.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        split = rules.get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        spaced = any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in rules.get("added_tokens", []))
        self.cuts = bool(usual and not rules.get("normalizer") and not spaced)
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = list(map(len, vocabulary))  # a character for each byte
        for t in rules.get("added_tokens", []):
            self.n_bytes[t["id"]] = len(t["content"].encode())
        self.known: defaultdict = defaultdict()  # units in order of their numbers
        self.known.default_factory = self.known.__len__
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.chars = 0
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts one behind the other, as they stand there, and how many each text has."""
        texts = pc.fill_null(texts, "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        data = texts.buffers()[2] or pa.py_buffer(b"")
        bounds = offsets - offsets[0]
        starts = bounds[:-1][np.diff(bounds) > 0]
        if self.cuts and len(starts):
            text = np.frombuffer(data, np.uint8, bounds[-1], offsets[0])
            blank = np.flatnonzero(text == ord(" "))
            after = np.concatenate([text, np.zeros(2, np.uint8)])
            cut = blank[_is_letter(after[blank + 1], after[blank + 2])]
            begins = np.zeros(len(text) + 1, bool)
            begins[starts] = True
            begins[cut[~begins[cut + 1]]] = True  # the next text's letter makes no cut
            starts = np.flatnonzero(begins)
        counts = np.diff(np.searchsorted(starts, bounds))
        places = np.concatenate([starts + offsets[0], offsets[-1:]]).astype(np.int32)
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), data), counts

    def _learn(self, units: list[str]) -> None:
        whole = np.fromiter((not _UNIT.match(u) for u in units), bool, len(units))
        order = np.argsort(~whole, kind="stable")  # pieces without a blank on their own, then the others joined
        texts = [units[i] for i in order.tolist()]
        alone = int(whole.sum())
        joined = ["".join(texts[a : a + 512]) for a in range(alone, len(texts), 512)]
        made = [x.ids for x in self.tokenizer.encode_batch_fast(texts[:alone] + joined, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(made), np.int64, sum(map(len, made)))
        ends = np.cumsum(self.n_bytes[flat])  # an id stands for so many bytes, which says where each text ends
        wanted = np.cumsum([len(t.encode()) for t in texts])
        last = np.searchsorted(ends, wanted)
        if not np.array_equal(ends[last], wanted):
            raise ValueError("the ids of this tokenizer don't stand for the bytes of the text")
        back = np.argsort(order)
        sizes = np.diff(last, prepend=-1)
        self.starts = np.concatenate([self.starts, (len(self.flat) + np.cumsum(sizes) - sizes)[back]])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        sizes = sizes[back]
        self.sizes = np.concatenate([self.sizes, sizes])

    def _learn_apart(self, units: list[str]) -> None:
        """The same for tokenizers that change the text."""
        made = [self.tokenizer.encode(u, add_special_tokens=False).ids for u in units]
        sizes = np.array([len(x) for x in made], np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, np.array([i for x in made for i in x], np.uint32)])
        self.sizes = np.concatenate([self.sizes, sizes])

    def encode(self, texts: list[str | None] | pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end_id``, and the number of each text's."""
        if len(self.known) > KNOWN_UNITS or self.chars > 32 * KNOWN_UNITS or not self.cuts:
            self.forget()
        units, counts = self._units(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        coded = units.dictionary_encode()  # a lookup for each different unit only
        different, before = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), len(self.known)
        numbers = np.fromiter(map(self.known.__getitem__, different), np.int64, len(different))
        if new := list(islice(self.known, before, None)):
            self.chars += sum(map(len, new))
            (self._learn if self.cuts else self._learn_apart)(new)
        which = numbers[coded.indices.to_numpy()]
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *counts])]
        lengths = np.diff(bounds) + 1
        ids = np.full(int(lengths.sum()), end_id, np.uint32)
        keep = np.ones(len(ids), bool)
        keep[np.cumsum(lengths) - 1] = False
        ids[keep] = self.flat[at]
        return ids, lengths


@cache
def _encoder(path: str) -> Encoder:
    """One for each worker process, which keeps the units it knows from task to task."""
    return Encoder(path)


def _texts(batch: pa.RecordBatch, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters of text in the last column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy()
    a, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= limit:
            yield a, i + 1
            a, held = i + 1, 0
    if a < batch.num_rows:
        yield a, batch.num_rows


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 2,
    percentile: float = PERCENTILE,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode every row's whole text and write the ids to ``path``, in ascending order of document id.

    Rows without an id come first; rows with the same id are ordered by a hash
    of their text, equal rows stay next to each other. A null or empty text
    has the end id alone. Rows are dealt out by range of (id, hash, row), so a
    repeated id is split over tasks.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text)).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
        F.col(text).alias("text"),
    )
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    dealt = rows.repartitionByRange(max(1, -(-size // BYTES_PER_TASK)), *order).sortWithinPartitions(*order)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        part = TaskContext.get().partitionId()
        doc_ids, ids, lengths, held, before = [], [], [], 0, 0

        def segment() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            rows = pa.concat_arrays(doc_ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([len(flat)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                    pa.array([np.concatenate(lengths)], pa.list_(pa.int64())),
                    pa.array([encode_segment(flat, percentile)], pa.binary()),
                ],
                ["part", "before", "n_ids", "doc_ids", "lengths", "data"],
            )

        for batch in batches:
            for a, b in _texts(batch):
                own, sizes = encoder.encode(batch.column(1).slice(a, b - a), end_id)
                ends = np.cumsum(sizes)
                while a < b:  # as many documents as fill a segment
                    done = b - len(sizes)
                    fits = int(np.searchsorted(ends, SEGMENT - held)) + 1
                    take = min(fits, len(sizes))
                    doc_ids.append(batch.column(0).slice(done, take))
                    lengths.append(sizes[:take])
                    ids.append(own[: ends[take - 1]])
                    held += int(ends[take - 1])
                    own, sizes, ends = own[ends[take - 1] :], sizes[take:], ends[take:] - ends[take - 1]
                    a += take
                    if held >= SEGMENT:
                        yield segment()
                        before += held
                        doc_ids, ids, lengths, held = [], [], [], 0
        if held:
            yield segment()

    segments = dealt.select("doc_id", "text").mapInArrow(
        run, f"part int, before long, n_ids long, doc_ids array<{kind}>, lengths array<long>, data binary"
    )
    segments.write.option("compression", "zstd").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The written segments, each with ``start``: the number of ids before it in the whole corpus.

    Parts are in order of document id, as many as writing tasks; the ids
    before each are added up from the index columns alone.
    """
    found = spark.read.parquet(path)
    parts = found.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per writing task
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("of_part"))
    joined = found.join(F.broadcast(starts), "part")
    return joined.withColumn("start", F.col("of_part") + F.col("before")).drop("of_part")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document, read from the segments.

    ``start`` is the number of ids before the document's; n_tokens counts its
    end id too. ``ids_crc32`` is that of the ids as little-endian unsigned
    32-bit numbers. Ids above 2**31 - 1 don't fit the array and are an error.
    """
    found = segments(spark, path).select("start", "doc_ids", "lengths", "data")
    kind = found.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode_segment(batch.column(3)[i].as_buffer()).astype("<u4", copy=False)
                lengths = batch.column(2)[i].values.to_numpy()
                ends = np.concatenate([[0], np.cumsum(lengths)])
                data = memoryview(np.ascontiguousarray(ids)).cast("B")
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
                arrays = [
                    batch.column(1)[i].values,
                    pa.array(batch.column(0)[i].as_py() + ends[:-1]),
                    pa.array(lengths),
                    pa.array(sums, pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    own = pa.array(ids).cast(pa.int32())
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), own))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    columns = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"
    return found.mapInArrow(run, columns + ", ids array<int>" * with_ids)


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """start, ids: the corpus' ids from place ``first`` to before ``last``, a row for each segment touched.

    Other segments are skipped by their index columns, other blocks by the
    block starts.
    """
    touched = segments(spark, path).where((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = max(first - start, 0)
                ids = decode_segment(data.as_buffer(), a, last - start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([start + a]), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], ["start", "ids"]
                )

    return touched.select("start", "data").mapInArrow(run, "start long, ids array<long>")
