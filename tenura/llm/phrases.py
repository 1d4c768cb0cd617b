"""Collocations of a corpus, counted in depth-truncated suffix subtrees that are built independently.

Prefixes of one word are grouped so that the suffixes of a group fit a memory
budget; a word with more suffixes than that is extended to longer prefixes,
which several groups share. Each group sorts its suffixes, cut after as many
words as a phrase may have, and reads the count of every phrase from the
totals of the leaves below it.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.llm.chunks import chunks, pack, pack_by_chunk, unpack
from tenura.session import store

NO_LANGUAGE = "und"
END = b""  # between pieces; no word is empty
CHUNK_TOKENS = 1_000_000
BUDGET = 2_000_000  # suffixes of a group
PARTS = 32  # of a language's phrases, ranked on their own first
GROUPS_PER_BUCKET = 64  # groups whose prefixes are put in order together

_SPLITS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n\n\n\n\n\n\n\n\n\n ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(row: dict) -> list[bytes]:
    """The words of a text, each with its language in front, with an end behind every piece."""
    language = row["lang"].encode() + b"\n"
    out = []
    for piece in (row["text"] or "").encode().lower().translate(_SPLITS).split(b"\n"):
        words = piece.split()
        if words:
            out += [language + w for w in words]
            out.append(END)
    return out


def _numbered(docs: DataFrame) -> DataFrame:
    """A row per chunk: its tokens as places in words, how often each word occurs, and words in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, tokens, CHUNK_TOKENS):
            n = np.bincount(c.ids, minlength=len(c.words))
            totals: dict[str, int] = {}
            for word, many in zip(c.words, n.tolist(), strict=True):
                if word:
                    language = word.rpartition(b"\n")[0].decode()
                    totals[language] = totals.get(language, 0) + many
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c.number], pa.int64()),
                    pa.array([pack(c.ids.astype("<i4"))], pa.binary()),
                    pa.array([c.words], pa.list_(pa.binary())),
                    pa.array([n], pa.list_(pa.int64())),
                    pa.array([list(totals.items())], pa.map_(pa.string(), pa.int64())),
                ],
                ["chunk", "ids", "words", "n", "totals"],
            )

    return docs.mapInArrow(
        run, "chunk long, ids binary, words array<binary>, n array<long>, totals map<string, long>"
    )


def _vocabulary(dictionary: DataFrame, least: int, budget: int) -> DataFrame:
    """word, id (from 1), f, and where its suffixes go: group, and the number of groups if it is extended.

    Prefixes are laid end to end by their numbers of suffixes; a group takes
    those that begin in its part of the line, ``budget`` long. A prefix longer
    than that is dealt out to all groups it lies across.
    """
    counts = dictionary.groupBy("word").agg(F.sum("n").alias("f")).where((F.col("f") >= least) & (F.col("word") != END))
    counts = store(counts)
    total = counts.agg(F.sum("f")).first()[0] or 0
    buckets = max(1, -(-total // (budget * GROUPS_PER_BUCKET)))
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets))
    line = Window.partitionBy("bucket").orderBy("word")
    laid = counts.withColumn("bucket", bucket).select(
        "word",
        "f",
        (F.col("bucket") * (1 << 32) + F.row_number().over(line)).alias("id"),
        "bucket",
        (F.sum("f").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("f")).alias("begin"),
    )
    first = F.expr(f"begin div {budget}")
    across = F.expr(f"(begin + f - 1) div {budget} - begin div {budget} + 1")
    return store(
        laid.select(
            "word",
            "id",
            "f",
            (F.col("bucket") * (1 << 32) + first).alias("group"),
            F.when(F.col("f") > budget, across).otherwise(F.lit(1)).cast("int").alias("parts"),
        )
    )


def _distinct(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of numbers (0 and more) in order, each once, and the sums of ``n`` over equal ones."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) < 63:
        key = np.zeros(len(n), np.int64)
        for c, b in zip(columns, bits, strict=True):
            key = key << b | c
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.diff(key, prepend=-1) != 0
    else:
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(n), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= np.diff(c[order]) != 0
    firsts = np.flatnonzero(new)
    sums = np.add.reduceat(n[order], firsts) if len(firsts) else n
    return [c[order[firsts]] for c in columns], sums


def subtree(columns: list[np.ndarray], n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """depth, phrases (a row of ids each) and their totals, for every depth from 2.

    ``columns`` are suffixes of a group, word by word, with 0 behind the end of
    a short one; ``n`` says how often each occurs.
    """
    leaves, n = _distinct(columns, n)
    for depth in range(2, len(columns) + 1):
        own = leaves[depth - 1] > 0
        path = [c[own] for c in leaves[:depth]]
        new = np.zeros(len(path[0]), bool)
        new[:1] = True
        for c in path:
            new[1:] |= np.diff(c) != 0
        firsts = np.flatnonzero(new)
        if len(firsts):
            yield depth, np.stack([c[firsts] for c in path], axis=1), np.add.reduceat(n[own], firsts)


def _suffixes(numbered: DataFrame, answers: DataFrame, longest: int) -> DataFrame:
    """group, words, n: the suffixes of each chunk (ids word by word) and their counts, packed by group.

    A suffix ends where its piece does, or before a word that is in no phrase.
    ``whole`` says that all suffixes with the same first word are in the group.
    """

    def run(numbers: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"group": [], "whole": [], "words": [], "n": []}
        if answers.num_rows and numbers.num_rows:
            lists = [[unpack(x, kind) for x in answers[c].to_pylist()] for c, kind in _ANSWER.items()]
            place, ids, group, parts = (np.concatenate(x) for x in lists)
            order = np.lexsort((ids, group))
            place, ids, group, parts = (x[order] for x in (place, ids, group, parts))
            flat = unpack(numbers["ids"][0].as_py(), "<i4")
            number = np.zeros(max(int(flat.max(initial=0)), int(place.max(initial=0))) + 1, np.int64)
            number[place] = np.arange(1, len(place) + 1)  # 0 for an end and for other words
            following = np.concatenate([number[flat], np.zeros(longest, np.int64)])
            columns = [following[: len(flat)]]
            for k in range(1, longest):
                columns.append(np.where(columns[-1] > 0, following[k : k + len(flat)], 0))
            kept = columns[1] > 0
            columns, n = _distinct([c[kept] for c in columns], np.ones(int(kept.sum()), np.int64))
            first = columns[0] - 1
            known = np.concatenate([[0], ids])
            columns = [known[c] for c in columns]
            mixed = np.zeros(len(n), np.uint64)
            for c in columns[1:]:
                mixed = (mixed ^ c.astype(np.uint64)) * _MIX
                mixed ^= mixed >> np.uint64(29)
            to = group[first] + (mixed % parts[first].astype(np.uint64)).astype(np.int64)
            whole = parts[first] == 1
            order = np.lexsort((whole, to))
            cuts = np.flatnonzero((np.diff(to[order], prepend=-1) != 0) | (np.diff(whole[order], prepend=False) != 0))
            for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=False):
                own = order[a:b]
                out["group"].append(int(to[own[0]]))
                out["whole"].append(bool(whole[own[0]]))
                out["words"].append([pack(c[own].astype("<i8")) for c in columns])
                out["n"].append(pack(n[own].astype("<i4")))
        return pa.table(
            [
                pa.array(out["group"], pa.int64()),
                pa.array(out["whole"], pa.bool_()),
                pa.array(out["words"], pa.list_(pa.binary())),
                pa.array(out["n"], pa.binary()),
            ],
            names=["group", "whole", "words", "n"],
        )

    return (
        numbered.select("chunk", "ids")
        .groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(run, "group long, whole boolean, words array<binary>, n binary")
    )


_ANSWER = {"place": "<i4", "id": "<i8", "group": "<i8", "parts": "<i4"}


def _counted(suffixes: DataFrame, least: int) -> DataFrame:
    """ids, f of all phrases of two and more words that occur at least ``least`` times."""

    def read(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray]:
        columns = [np.concatenate([unpack(r["words"][k], "<i8") for r in rows]) for k in range(len(rows[0]["words"]))]
        return columns, np.concatenate([unpack(r["n"], "<i4") for r in rows]).astype(np.int64)

    def run(table: pa.Table) -> pa.Table:
        ids, totals, whole = [pa.array([], pa.list_(pa.int64()))], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for is_whole in (True, False):
            rows = [r for r in table.select(["whole", "words", "n"]).to_pylist() if r["whole"] == is_whole]
            if not rows:
                continue
            columns, n = read(rows)
            for depth, phrases, f in subtree(columns, n):
                # other groups have more of an extended prefix's phrases, unless they are leaves
                final = is_whole or depth == len(columns)
                kept = f >= (least if final else 1)
                own = phrases[kept]
                offsets = np.arange(0, own.size + 1, depth, dtype=np.int32)
                ids.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(own.reshape(-1))))
                totals.append(f[kept])
                whole.append(np.full(len(own), final))
        arrays = [pa.concat_arrays(ids), pa.array(np.concatenate(totals)), pa.array(np.concatenate(whole))]
        return pa.table(arrays, names=["ids", "f", "whole"])

    nodes = store(suffixes.groupBy("group").applyInArrow(run, "ids array<long>, f long, whole boolean"))
    shared = nodes.where("NOT whole").groupBy("ids").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return nodes.where("whole").select("ids", "f").unionByName(shared)


def _number(column: Column) -> Column:
    return column.cast("decimal(18, 0)")


def _scored(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """ids, a, l, r, score of candidates, by the cut with the lowest score (of equal ones the first)."""
    cuts = candidates.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")).select(
        "*",
        F.expr("slice(ids, 1, k)").alias("left"),
        F.expr("slice(ids, k + 1, size(ids) - k)").alias("right"),
    )
    of_left = phrases.select(F.col("ids").alias("left"), F.col("f").alias("l"))
    of_right = phrases.select(F.col("ids").alias("right"), F.col("f").alias("r"))
    # products of counts pass 64 bits: exact decimals of 38 digits
    square = (_number(F.col("a")) * _number(F.col("a"))).cast("decimal(32, 0)") * F.lit(1_000_000).cast("decimal(7, 0)")
    both = cuts.join(of_left, "left").join(of_right, "right")
    scores = both.select("ids", "a", "k", "l", "r", square.alias("square"), (_number(F.col("l")) * _number(F.col("r"))).alias("both"))
    best = scores.select("ids", "a", F.struct(F.expr("square div both").alias("score"), "k", "l", "r").alias("cut"))
    return best.groupBy("ids", "a").agg(F.min("cut").alias("cut")).select("ids", "a", "cut.l", "cut.r", "cut.score")


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    share: int = 50,
    top: int = 2000,
    budget: int = BUDGET,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` collocations of every language.

    Phrases are of 2 to ``longest`` words in a row without one of .,;:!? or a
    line end between them, in lower case (A-Z); they occur a >= ``least``
    times, copies and overlaps counted. n is the number of all words of the
    language (a missing one is ``und``). A phrase is cut in two where
    floor(1000000 * a * a / (l * r)) is least, l and r being the counts of the
    parts; ties go to the first cut. A phrase goes if a longer one that contains
    it has at least ``share`` percent of its count. Rank is by score, then a,
    both descending, then phrase in byte order. Null and empty texts have no
    words; ids aren't read, so missing and repeated ones change nothing. Counts
    must stay below 10**15.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have at least two words and occur at least once")
    rows = docs.select(
        F.struct(
            F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("text")
        ).alias("row")
    ).select(F.lit(0).alias("none"), "row")
    numbered = store(_numbered(rows))
    dictionary = numbered.select("chunk", F.posexplode(F.arrays_zip("words", "n")).alias("place", "x")).select(
        "chunk", "place", F.col("x.words").alias("word"), F.col("x.n").alias("n")
    )
    vocabulary = _vocabulary(dictionary, least, budget)
    found = dictionary.join(vocabulary, "word").select("chunk", *_ANSWER)
    answers = pack_by_chunk(found, {c: kind for c, kind in _ANSWER.items() if c != "place"})
    longer = store(_counted(_suffixes(numbered, answers, longest), least))
    phrases = vocabulary.select(F.array("id").alias("ids"), "f").unionByName(longer)

    # the longest stay; of others the largest count of a longer phrase around them decides
    inner = longer.where(F.size("ids") > 2).select(
        "f",
        F.explode(
            F.expr(
                "flatten(transform(sequence(2, size(ids) - 1), "
                "n -> transform(sequence(1, size(ids) - n + 1), i -> slice(ids, i, n))))"
            )
        ).alias("ids"),
    )
    around = inner.groupBy("ids").agg(F.max("f").alias("most"))
    kept = longer.join(around, "ids", "left").where(
        F.col("most").isNull() | (F.col("most") * 100 < F.col("f") * share)
    )
    scored = _scored(kept.select("ids", F.col("f").alias("a")), phrases)

    words = vocabulary.select("id", F.col("word").cast("string").alias("word"))
    spelling = F.substring_index("word", "\n", -1)
    first = words.select(
        F.col("id").alias("first"),
        F.expr("regexp_extract(word, '(?s)^(.*)\n', 1)").alias("lang"),
        F.concat(spelling, F.lit(" ")).alias("begin"),  # sorts as phrases that begin with the word
    )
    by_score = [F.col("score").desc(), F.col("a").desc()]
    in_language = Window.partitionBy("lang")
    # a language may have a third of all phrases: each of several parts passes its best on
    named = scored.withColumn("first", F.col("ids")[0]).join(first, "first")
    best = named.withColumn("part", F.pmod(F.hash("ids"), F.lit(PARTS)))
    for key in (["lang", "part"], ["lang"]):
        place = F.rank().over(Window.partitionBy(*key).orderBy(*by_score, "begin"))
        best = best.withColumn("place", place).where(F.col("place") <= top)
    spelt = (
        best.select("lang", "ids", "a", "l", "r", "score", F.posexplode("ids").alias("i", "id"))
        .join(words, "id")
        .groupBy("lang", "ids", "a", "l", "r", "score")
        .agg(F.sort_array(F.collect_list(F.struct("i", spelling.alias("word")))).alias("words"))
        .withColumn("phrase", F.array_join(F.col("words.word"), " "))
    )
    ranked = spelt.withColumn("rank", F.row_number().over(in_language.orderBy(*by_score, "phrase")).cast("long"))
    totals = numbered.select(F.explode("totals").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n"))
    return (
        ranked.where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
