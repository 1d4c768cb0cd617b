"""SentencePiece encoding as a relational lattice, and decoding, with the piece table of a model file.

A text is encoded as the segmentation of highest total piece score. Segments
between which no piece can reach are encoded on their own, each different one
once: its substrings are exploded, joined to the piece table, grouped by
segment, and folded.
"""

import re
import string
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.chunks import pack, unpack
from tenura.llm.common import bounded_batches
from tenura.session import store

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"  # how a blank is written in pieces
UNKNOWN_PENALTY = 10.0  # fixed value: below the lowest score, for a character without a piece
STEPS = 128  # positions folded at a time
GROUPS = 100_000  # segments that a task groups by hashing before it sorts instead
RUNS = 1_000_000  # words between blanks in a chunk
CHARS_PER_TASK = 4_000_000  # of text, for each task that encodes segments

# Letters after which a cut may be tried; others are never cut off what follows.
_LETTER = "A-Za-z0-9À-ɏ"
_LETTERS = "".join(re.findall(f"[{_LETTER}]", "".join(map(chr, range(0x300)))))
_PLACE = np.dtype([("chunk", "<i8"), ("place", "<i4")])  # where a segment stands in a chunk's dictionary


@dataclass
class Pieces:
    """A model's vocabulary: pieces with scores, the pieces of single bytes, and where segments end."""

    scored: list[tuple[str, int, float]]
    byte_ids: list[int]  # empty without byte fallback
    unknown_id: int
    texts: list[bytes]  # what each id decodes to

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.scored), default=1)

    @property
    def unknown_score(self) -> float:
        usual = [s for _, _, s in self.scored if s > -1e6]  # reserved pieces are far below
        return min(usual, default=0.0) - UNKNOWN_PENALTY

    def _long(self) -> list[str]:
        return [p.replace(SPACE, " ") for p, _, _ in self.scored if len(p) > 1]

    def signs(self) -> str | None:
        """Punctuation that never follows a letter inside a piece; None if pieces span words."""
        following = {(a, b) for p in self._long() for a, b in zip(p, p[1:], strict=False)}
        if any(b == " " and a != " " for a, b in following):
            return None
        letter = re.compile(f"[{_LETTER}]")
        reached = {b for a, b in following if letter.match(a)}
        return "".join(c for c in string.punctuation if c not in reached)

    def segment_pattern(self) -> re.Pattern:
        """Splits a text (with blanks) where no piece can reach across.

        That is before a blank after something else, around a control
        character that is in no longer piece, and between a letter and a
        punctuation sign that never follows a letter inside a piece.
        """
        signs = self.signs()
        if signs is None:
            return re.compile(r"[\s\S]+")  # pieces span words
        inside = set("".join(self._long()))
        alone = "".join(c for c in map(chr, [*range(32), 127]) if c not in inside)
        a, s, z = f"[{_LETTER}]", re.escape(signs), re.escape(alone)
        other = f"[^{_LETTER} {z}]"  # signs of any kind
        glued = f"[^{_LETTER} {z}{s}]"  # signs that a piece may join to a letter
        alone_or = f"[{z}]|" if alone else ""
        return re.compile(f"{alone_or} *{other}*{a}+(?:{glued}{other}*{a}*)*| *{other}+| +")


def read_model(path: str = MODEL) -> Pieces:
    """The piece table of a model file; its normalisation must be the identity."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as file:
        model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces:
        raise ValueError("only models that leave the text as it is are supported")
    if not rules.add_dummy_prefix:
        raise ValueError("only models that put a blank before a text are supported")
    normal, unknown, control, user_defined, byte = 1, 2, 3, 4, 6
    scored, texts, byte_ids, unknown_id = [], [], {}, 0
    for i, p in enumerate(model.pieces):
        if p.type == byte:
            byte_ids[int(p.piece[1:-1], 16)] = i
            texts.append(bytes([int(p.piece[1:-1], 16)]))
        elif p.type == control:
            texts.append(b"")
        elif p.type == unknown:
            unknown_id = i
            texts.append(" ⁇ ".encode())
        else:
            texts.append(p.piece.replace(SPACE, " ").encode())
            if p.type == normal or p.type == user_defined:
                scored.append((p.piece.replace(SPACE, " "), i, float(p.score)))
    return Pieces(
        scored,
        [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else [],
        unknown_id,
        texts,
    )


@contextmanager
def _groups_in_memory(spark: SparkSession):
    """Group lists by hashing: by default a task with over 128 groups sorts its rows, and spills, instead."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(GROUPS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def edges(words: DataFrame, pieces: Pieces) -> DataFrame:
    """All lattice edges of distinct segments, in the partitions in which these are.

    ``words`` has word, ``a`` (its hash) and whatever else goes with it, in a
    column ``with``.
    An edge is a substring of at most the longest piece's length that is in
    the piece table, or a single character that isn't. Returns a and b (two
    hashes, 96 bits, that stand for the segment), part (of ``STEPS`` positions), word and with (with the first
    edge only: they can be long), and the edge as one number, in the order of
    its fields: where it ends in the part, its size, its piece (one behind the
    last id for a character without one). Rows of a segment come in order.
    """
    longest = pieces.longest
    if longest > 31 or len(pieces.texts) >= 1 << 24:
        raise ValueError("the piece table is too large for the numbers of edges")
    spark = words.sparkSession
    # as many rows as the vocabulary file has pieces
    table = F.broadcast(spark.createDataFrame([(p, i) for p, i, _ in pieces.scored], "piece string, id int"))
    length = F.char_length("word")
    blocks = words.select(
        "a", F.hash("word").alias("b"), "word", "with", length.alias("length"), F.explode(F.sequence(F.lit(0), length - 1, F.lit(STEPS))).alias("base")
    ).select(
        "a",
        "b",
        (F.col("base") / STEPS).cast("int").alias("part"),
        F.when(F.col("base") == 0, F.struct("word", "with")).alias("owner"),
        F.least(F.lit(STEPS), F.col("length") - F.col("base")).alias("n"),
        F.least(F.col("base"), F.lit(longest - 1)).alias("lead"),
        F.expr(
            f"substring(word, greatest(base - {longest - 1}, 0) + 1, {STEPS} + least(base, {longest - 1}))"
        ).alias("block"),
    )
    ends = blocks.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("end"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.col("lead") + F.col("end")))
    cuts = ends.select("*", F.explode(sizes).alias("size")).select(
        "a",
        "b",
        "part",
        F.when((F.col("end") == 1) & (F.col("size") == 1), F.col("owner")).alias("owner"),
        "end",
        "size",
        F.expr("substring(block, lead + end - size + 1, size)").alias("piece"),
    )
    joined = cuts.join(table, "piece", "left").where(F.col("id").isNotNull() | (F.col("size") == 1))
    piece = F.coalesce(F.col("id"), F.lit(len(pieces.texts))).cast("long")
    return joined.select(
        "a",
        "b",
        "part",
        "owner",
        ((F.col("end").cast("long") * (1 << 29)) + F.col("size") * (1 << 24) + piece).alias("edge"),
    )


def _fallback(char: Column, pieces: Pieces) -> Column:
    """The ids of a character's bytes, or the unknown id."""
    if not pieces.byte_ids:
        return F.array(F.lit(pieces.unknown_id))
    known = F.from_json(F.lit(str(pieces.byte_ids)), "array<int>")
    hexes = F.hex(F.encode(char, "UTF-8"))
    return F.transform(
        F.sequence(F.lit(0), F.octet_length(char) - 1),
        lambda i: F.get(known, F.conv(F.substr(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("int")),
    )


def best_path(lattice: DataFrame, pieces: Pieces) -> DataFrame:
    """word, with, ids: the path of highest total score; of equal ones the one with the longer last edge, step by step.

    Edges are grouped by segment, in parts of ``STEPS`` positions, and folded
    edge by edge: the best edge into a position is the one for which the best
    score where it begins and its own add up to most. A second fold follows the
    best edges back from the end.
    """
    longest = pieces.longest
    # scores by id as one constant
    by_id = [pieces.unknown_score] * (len(pieces.texts) + 1)
    for _, i, score in pieces.scored:
        by_id[i] = score
    scores = F.from_json(F.lit(str(by_id)), "array<double>")
    parts = lattice.groupBy("a", "b", "part").agg(
        F.first("owner", ignorenulls=True).alias("owner"), F.collect_list("edge").alias("edges")
    )
    grouped = parts.groupBy("a", "b").agg(
        F.first("owner", ignorenulls=True).alias("owner"),
        F.sort_array(F.collect_list(F.struct("part", "edges"))).alias("parts"),
    )

    def size_of(edge: Column) -> Column:
        return F.shiftright(edge, 24).bitwiseAND(F.lit(31).cast("long")).cast("int")

    def piece_of(edge: Column) -> Column:
        return edge.bitwiseAND(F.lit((1 << 24) - 1).cast("long")).cast("int")

    def score_of(edge: Column) -> Column:
        return F.get(scores, piece_of(edge))

    def forward(best: Column, part: Column) -> Column:
        """``best`` has the best score at each position so far, and the edge that gives it."""
        kept = F.least(F.size(best), F.lit(longest))  # a step looks back by the longest piece at most
        start = F.struct(
            F.slice(best, F.size(best) - kept + 1, kept).alias("done"),
            F.lit(1).cast("long").alias("at"),
            F.lit(None).cast("struct<s: double, e: bigint>").alias("best"),
        )

        def step(state: Column, edge: Column) -> Column:
            """Edges come by end, then size: the next end completes the position before."""
            end = F.shiftright(edge, 29)
            size = size_of(edge)
            same = end == state.at
            behind = (
                F.when(same, F.element_at(state.done, -size).s)
                .when(size == 1, state.best.s)
                .otherwise(F.element_at(state.done, 1 - size).s)
            )
            into = F.struct((behind + score_of(edge)).alias("s"), edge.alias("e"))
            return F.struct(
                F.when(same, state.done).otherwise(F.array_append(state.done, state.best)).alias("done"),
                end.alias("at"),
                F.greatest(F.when(same, state.best), into).alias("best"),  # of equal scores the longer edge
            )

        return F.concat(
            F.slice(best, 1, F.size(best) - kept),
            F.aggregate(part.edges, start, step, lambda end: F.array_append(end.done, end.best)),
        )

    none = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("e")))
    reached = grouped.select("owner", "parts", F.aggregate("parts", none, forward).alias("best"))

    # back from the end: the edges of the path so far, each with the position where it begins
    def follow(path: Column, at: Column) -> Column:
        edge = F.get(F.col("best"), at).e
        step = F.struct((at - size_of(edge)).alias("begin"), edge.alias("edge"))
        return F.when(at == F.element_at(path, -1).begin, F.array_append(path, step)).otherwise(path)

    none = F.array(F.struct((F.size("best") - 1).alias("begin"), F.lit(0).cast("long").alias("edge")))
    blocks = F.sequence(F.size("best") - 1, F.lit(1), F.lit(-STEPS))
    path = F.aggregate(
        blocks,
        none,
        lambda so_far, upto: F.concat(
            F.slice(so_far, 1, F.size(so_far) - 1),
            F.aggregate(
                F.sequence(upto, F.greatest(upto - (STEPS - 1), F.lit(1)), F.lit(-1)), F.slice(so_far, -1, 1), follow
            ),
        ),
    )
    found = reached.select("owner.word", "owner.with", F.reverse(path).alias("path"))
    no_piece = len(pieces.texts)

    def ids_of(step: Column) -> Column:
        char = F.substring(F.col("word"), step.begin + 1, F.lit(1))
        piece = piece_of(step.edge)
        return F.when(piece == no_piece, _fallback(char, pieces)).otherwise(F.array(piece))

    steps = F.slice("path", 1, F.size("path") - 1)
    return found.select("word", "with", F.flatten(F.transform(steps, ids_of)).alias("ids"))


def _runs_of(texts: pa.Array) -> pa.Array:
    """Each text as a list of runs of blanks and what follows them; the first blank of each is left out.

    The model reads a blank before the text, so every run begins with one. A
    piece's sign for a blank is read as a blank, and free to stand between
    the runs. A null or empty text has a null list.
    """
    texts = pc.replace_substring(texts, SPACE, " ")
    several = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
    several = pc.fill_null(several, False)
    texts = pc.if_else(pc.equal(texts, ""), None, texts)
    if not pc.any(several).as_py():
        return pc.split_pattern(texts, " ")
    # several blanks in a row, or at an end
    odd = pc.binary_join_element_wise("", texts.filter(several), " ")
    odd = pc.utf8_slice_codeunits(pc.replace_substring_regex(odd, " ( *)", SPACE + r"\1"), 1)
    return pc.split_pattern(pc.replace_with_mask(pc.replace_substring(texts, " ", SPACE), several, odd), SPACE)


def _runs(text: str | None) -> list[str]:
    """The same for one text."""
    return _runs_of(pa.array([text], pa.string()))[0].as_py() or []


def _release() -> None:
    """Give back what Arrow has freed: several workers stand beside each other and live on after their tasks."""
    pa.default_memory_pool().release_unused()


@dataclass
class _Chunk:
    """Documents as numbers of their runs, as in ``chunks``, with Arrow for the dictionary."""

    number: int
    rows: pa.Table  # the columns besides the text
    lengths: np.ndarray  # runs of each document
    ids: np.ndarray  # all runs, as places in ``runs``
    runs: pa.Array  # the different ones, in order of first occurrence


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    """Group rows whose last column is a text; a chunk ends with the document that reaches ``RUNS``."""
    first = TaskContext.get().partitionId() << 32
    made, total = 0, 0
    rows, lengths, runs = [], [], []

    def finish() -> _Chunk:
        coded = pa.concat_arrays(runs).dictionary_encode()
        ids = coded.indices.to_numpy()
        runs.clear()
        _release()
        return _Chunk(first + made, pa.Table.from_batches(rows), np.concatenate(lengths), ids, coded.dictionary)

    for batch in batches:
        lists = _runs_of(batch.column(batch.num_columns - 1))
        others = batch.drop_columns([batch.schema.names[-1]])
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        flat, ends, start = lists.flatten(), np.concatenate([[0], np.cumsum(sizes)]), 0
        while start < batch.num_rows:
            reaches = int(np.searchsorted(ends[1:], ends[start] + RUNS - total)) + 1
            stop = min(reaches, batch.num_rows)
            rows.append(others.slice(start, stop - start))
            lengths.append(sizes[start:stop])
            runs.append(flat.slice(ends[start], ends[stop] - ends[start]))
            total += int(ends[stop] - ends[start])
            start = stop
            if total >= RUNS:
                yield finish()
                made, total = made + 1, 0
                rows, lengths, runs = [], [], []
        del lists, flat
        _release()
    if lengths:
        yield finish()
    _release()


@dataclass
class _Cuts:
    """How runs are cut into segments."""

    pattern: re.Pattern
    signs: str | None


def _bucket(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each word, by a hash of its length and its first, middle and last 8 bytes."""
    size = _bytes(words).astype(np.int64)
    data = np.concatenate([np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)])
    starts = np.frombuffer(words.buffers()[1], np.int32, len(words), 4 * words.offset).astype(np.int64)
    own = np.where(np.arange(8) < size[:, None], np.uint8(255), np.uint8(0)).view("<u8")[:, 0]
    found = size.astype(np.uint64)
    for at in (np.zeros_like(size), np.maximum(size - 8, 0) // 2, np.maximum(size - 8, 0)):
        window = data[(starts + at)[:, None] + np.arange(8)].view("<u8")[:, 0] & own
        found = (found ^ window) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return ((found >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _bytes(strings: pa.Array) -> np.ndarray:
    return pc.binary_length(strings).to_numpy()


def _segments(runs: pa.Array, cuts: _Cuts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct segments of a chunk's runs, each run's number of them, and all runs' segments.

    Letters followed by signs that no piece joins to them, or either alone,
    are cut for all runs at once; the pattern cuts the others.
    """
    n = len(runs)
    if cuts.signs is None:
        head = tail = runs
        plain = np.zeros(n, bool)
    else:
        head = pc.utf8_rtrim(runs, characters=cuts.signs)
        tail = pc.utf8_ltrim(runs, characters=_LETTERS)
        plain = _bytes(head) + _bytes(tail) == _bytes(runs)
    two = plain & (_bytes(head) > 0) & (_bytes(tail) > 0)
    others = [cuts.pattern.findall(" " + run) for run in runs.filter(pa.array(~plain)).to_pylist()]
    sizes = np.where(two, 2, 1).astype(np.int64)
    sizes[~plain] = [len(x) for x in others]
    starts = np.cumsum(sizes) - sizes
    firsts = pc.if_else(pa.array(two), head, runs).filter(pa.array(plain))
    found = pa.concat_arrays(
        [
            pc.binary_join_element_wise("", firsts, " "),
            tail.filter(pa.array(two)),
            pa.array(chain.from_iterable(others), pa.string()),
        ]
    ).dictionary_encode()
    rest, _ = _take(np.arange(int(sizes.sum())), sizes, np.flatnonzero(~plain))
    flat = np.empty(int(sizes.sum()), np.int64)
    flat[np.concatenate([starts[plain], starts[two] + 1, rest])] = found.indices.to_numpy()
    return found.dictionary, sizes, flat


def _take(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered ``which``, of lists that lie one behind the other in ``flat``, and their sizes."""
    starts = np.cumsum(sizes) - sizes
    size = sizes[which]
    ends = np.cumsum(size)
    at = np.repeat(starts[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    return flat[at], size


def _dictionary(docs: DataFrame, cuts: _Cuts, buckets: int) -> DataFrame:
    """bucket, chunk, steps (between places), sizes, data: every chunk's distinct segments, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            words, _, _ = _segments(c.runs, cuts)
            if not len(words):
                continue
            bucket = _bucket(words, buckets)
            place = np.argsort(bucket, kind="stable")
            words, bucket = words.take(pa.array(place)), bucket[place]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            sizes = _bytes(words).astype("<i4")
            data = memoryview(words.buffers()[2])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            spans = list(zip(first, [*first[1:], len(words)], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[first].astype(np.int32)),
                    pa.array(np.full(len(first), c.number)),
                    pa.array([pack(np.diff(place[a:b], prepend=0).astype("<i4")) for a, b in spans], pa.binary()),
                    pa.array([pack(sizes[a:b]) for a, b in spans], pa.binary()),
                    pa.array([zstandard.compress(data[ends[a] : ends[b]], 1) for a, b in spans], pa.binary()),
                ],
                ["bucket", "chunk", "steps", "sizes", "data"],
            )

    return docs.mapInArrow(run, "bucket int, chunk long, steps binary, sizes binary, data binary")


def _distinct(dictionary: DataFrame) -> DataFrame:
    """word, with: each segment of a partition of packed dictionaries once, and its places in them (``_PLACE``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        if not rows:
            return
        sizes = [unpack(row["sizes"], "<i4") for row in rows]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        data = b"".join(zstandard.decompress(row["data"]) for row in rows)
        words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        places = np.empty(len(words), _PLACE)
        places["chunk"] = np.repeat([row["chunk"] for row in rows], [len(x) for x in sizes])
        places["place"] = np.concatenate([np.cumsum(unpack(row["steps"], "<i4")) for row in rows])
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(np.bincount(codes))]) * _PLACE.itemsize
        owned = places[np.argsort(codes, kind="stable")].tobytes()
        buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(owned)]
        having = pa.Array.from_buffers(pa.binary(), len(coded.dictionary), buffers)
        made = pa.RecordBatch.from_arrays([coded.dictionary, having], ["word", "with"])
        del rows, sizes, offsets, data, words, places, coded, codes
        _release()
        for a in range(0, made.num_rows, 4096):
            yield made.slice(a, 4096)

    return dictionary.select("chunk", "steps", "sizes", "data").mapInArrow(run, "word string, with binary")


def _packed(answers: DataFrame) -> DataFrame:
    """chunk, steps (between places), sizes, ids: what a partition's segments are in each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        having, lists = (table[c].combine_chunks() for c in ("with", "ids"))
        flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
        word = np.repeat(np.arange(len(having)), _bytes(having) // _PLACE.itemsize)
        places = np.frombuffer(b"".join(having.to_pylist()), _PLACE)
        order = np.lexsort((places["place"], places["chunk"]))
        places, word = places[order], word[order]
        cuts = np.flatnonzero(np.diff(places["chunk"], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(places)], strict=True):
            ids, own = _take(flat, sizes, word[a:b])
            packed = [pack(x.astype("<i4")) for x in (np.diff(places["place"][a:b], prepend=0), own, ids)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([places["chunk"][a]]), *(pa.array([x], pa.binary()) for x in packed)],
                ["chunk", "steps", "sizes", "ids"],
            )
        del held, table, having, lists, flat
        _release()

    return answers.select("with", "ids").mapInArrow(run, "chunk long, steps binary, sizes binary, ids binary")


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, with, ids of distinct segments (word) that aren't empty; ``with`` is kept.

    Segments are told apart by two hashes (96 bits) while they are grouped.
    """
    return best_path(edges(words.withColumn("a", F.xxhash64("word")), pieces), pieces)


def encode(docs: DataFrame, pieces: Pieces, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The piece ids of every row's whole text: doc_id, ids, text_crc32 (of the text that was read).

    A null or empty text has no ids and the checksum of nothing. Every row of
    ``docs`` gives a row. ``docs`` must be read the same way by several jobs
    (see chunks).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("crc"),
        F.col(text).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(spread, size // CHARS_PER_TASK)
    # dictionaries are packed until a bucket's are put together; then every segment is a row, whose lattice stays there
    cuts = _Cuts(pieces.segment_pattern(), pieces.signs())
    buckets = max(spread, partitions // 4)
    found = _distinct(_dictionary(rows, cuts, buckets).repartitionById(buckets, "bucket"))
    words = found.repartition(partitions, F.xxhash64("word")).select("word", "with", F.xxhash64("word").alias("a"))
    with _groups_in_memory(spark):
        answers = store(_packed(best_path(edges(words, pieces), pieces)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            words, sizes, flat = _segments(c.runs, cuts)
            numbers = [np.array([len(words)]), sizes, flat, c.lengths, c.ids]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c.number], pa.int64()),
                    pa.array([c.rows["doc_id"].to_pylist()], pa.list_(c.rows.schema.field("doc_id").type)),
                    pa.array([c.rows["crc"].to_pylist()], pa.list_(pa.int64())),
                    pa.array([[pack(x.astype("<i4")) for x in numbers]], pa.list_(pa.binary())),
                ],
                ["chunk", "doc_ids", "crcs", "numbers"],
            )

    def assemble(numbers: pa.Table, answers: pa.Table) -> pa.Table:
        (n,), run_sizes, run_segments, lengths, runs = (
            unpack(x, "<i4").astype(np.int64) for x in numbers["numbers"][0].as_py()
        )
        lists = [[unpack(x, "<i4") for x in answers[c].to_pylist()] for c in ("steps", "sizes", "ids")]
        lists[0] = [np.cumsum(x) for x in lists[0]]
        place, sizes, flat = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in lists)
        order = np.argsort(place)
        if not np.array_equal(place[order], np.arange(n)):
            raise ValueError("the chunks of two passes differ: the input must be read the same way each time")
        flat, sizes = _take(flat, sizes.astype(np.int64), order)
        _release()
        # pieces of each run, then of each document, some documents at a time
        run_flat, counts = _take(flat, sizes, run_segments)
        of_run = np.zeros(len(run_sizes) + 1, np.int64)
        of_run[1:] = np.cumsum(run_sizes)
        totals = np.concatenate([[0], np.cumsum(counts)])
        run_pieces = np.diff(totals[of_run])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        parts, per_doc, a = [], [], 0
        while a < len(lengths):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + 300_000, side="right")) - 1)
            own = runs[ends[a] : ends[b]]
            ids, size = _take(run_flat, run_pieces, own)
            sums = np.concatenate([[0], np.cumsum(size)])
            per_doc.append(np.diff(sums[ends[a : b + 1] - ends[a]]))
            parts.append(ids.astype(np.int32))
            a = b
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(per_doc))]).astype(np.int32)
        return pa.table(
            {
                "doc_id": pa.array(numbers["doc_ids"][0].as_py(), numbers.schema.field("doc_ids").type.value_type),
                "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts))),
                "text_crc32": pa.array(numbers["crcs"][0].as_py(), pa.int64()),
            }
        )

    numbered = rows.mapInArrow(number, f"chunk long, doc_ids array<{kind}>, crcs array<long>, numbers array<binary>")
    return (
        numbered.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(assemble, f"doc_id {kind}, ids array<int>, text_crc32 long")
    )


def decode(encoded: DataFrame, pieces: Pieces, ids: str = "ids") -> DataFrame:
    """``encoded`` with the column text: what the ids stand for, without the blank before the text.

    Null ids give a null text. Bytes that are no valid UTF-8 become the
    replacement character; an id outside the vocabulary is an error.
    """
    texts = pieces.texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(texts, pa.binary())
        width = np.array([len(x) for x in texts], np.int64)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            flat = lists.flatten()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            made = np.frombuffer(vocabulary.take(flat).buffers()[2] or b"", np.uint8)
            ends = np.concatenate([[0], np.cumsum(width[flat.to_numpy()])])[np.cumsum([0, *sizes])]
            begins = ends[:-1][np.diff(ends) > 0]
            blank = begins[made[begins] == ord(" ")]  # before the text
            ends -= np.searchsorted(blank, ends)
            data = pa.py_buffer(np.delete(made, blank))
            joined = pa.Array.from_buffers(
                pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), data]
            )
            joined = pc.if_else(lists.is_valid(), joined, None)
            try:
                decoded = joined.cast(pa.string())
            except pa.ArrowInvalid:  # some bytes are no valid UTF-8
                decoded = pa.array([x and x.decode(errors="replace") for x in joined.to_pylist()], pa.string())
            yield batch.append_column("text", decoded)
            del lists, flat, made, data, joined, decoded
            _release()

    kept = encoded.drop("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, text string")


def round_trips(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """What ``encode`` returned, with round_trip: whether decoding gives the text that was read."""
    decoded = decode(encoded, pieces)
    return decoded.withColumn("round_trip", F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")).drop("text")
