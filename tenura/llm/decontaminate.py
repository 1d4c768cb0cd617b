"""Benchmark passages in documents: a prefix-filtered join of word windows, all in SQL functions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import free_name, row_key
from tenura.session import store

# What separates words, and the letters that are lowered.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WINDOWS_AT_ONCE = 200_000  # windows broadcast at a time; some 100 bytes each


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lowered; none for null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, GAP), ""), F.array().cast("array<string>"))


def _shingle(words: Column, at: Column, length: int) -> Column:
    """Hash of ``length`` words from position ``at``; the length is part of it."""
    return F.xxhash64(F.lit(length), *[F.get(words, at + i) for i in range(length)])


def windows(benchmark: DataFrame, size: int, item_id: str, text: str) -> DataFrame:
    """Distinct windows: window (its words), items (ids as strings; a missing id is empty)."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("words")
    )
    starts = items.where(F.size("words") > 0).select(
        "item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))).alias("at")
    )
    return (
        starts.select("item", F.slice("words", F.col("at") + 1, size).alias("window"))
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def _positions(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for each word position and shingle length, and one for a document without words."""
    rows = docs.select("*", F.posexplode_outer("words").alias("at", "_word"))
    shingles = [
        F.when(F.col("at") + n <= F.size("words"), _shingle(F.col("words"), F.col("at"), n)) for n in lengths
    ]
    if len(lengths) == 1:
        return rows.withColumn("shingle", shingles[0])
    return rows.withColumn("shingle", F.explode(F.array(*shingles)))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    shingle: int = 3,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """Which words of each row lie in an occurrence of a window of a benchmark item.

    Returns doc_id, n_words, n_hit (words inside occurrences), items (ids of
    items with occurring windows, sorted strings) and contaminated. A window
    is ``window`` consecutive words of an item, or all words of a shorter one;
    items without words have none. Null texts have no words. Every row of
    ``docs`` gives one row, also copies of a row and rows without an id.

    All shingles of a window must occur for the window to occur, so one of
    them, the rarest in the corpus, is a sufficient prefix to join on. The
    position of the match gives the one place where the window can begin; it
    must lie inside the document, and there the words are compared. Windows
    are broadcast in blocks of bounded size, one pass over the documents each.
    """
    found = store(windows(benchmark, window, item_id, text))
    total, lengths = found.agg(
        F.count("*"), F.sort_array(F.collect_set(F.least(F.size("window"), F.lit(shingle))))
    ).first()
    lengths = list(lengths) or [shingle]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        words_of(F.col(text)).alias("words"),
    )
    positions = _positions(rows, lengths)

    # the shingles of every window, and how often the corpus has each
    length = F.least(F.size("window"), F.lit(shingle))
    own = F.transform(
        F.sequence(F.lit(0), F.size("window") - length),
        lambda at: F.struct(
            at.alias("offset"),
            F.coalesce(*[F.when(length == n, _shingle(F.col("window"), at, n)) for n in lengths]).alias("shingle"),
        ),
    )
    blocks = -(-max(total, 1) // WINDOWS_AT_ONCE)
    parts = [found.where(F.pmod(F.hash("window"), F.lit(blocks)) == b) for b in range(blocks)]
    shingled = found.select("window", "items", F.explode(own).alias("s")).select("window", "items", "s.*")
    wanted = shingled.select("shingle").distinct()
    counted = [
        positions.join(F.broadcast(wanted.where(F.pmod("shingle", F.lit(blocks)) == b)), "shingle") for b in range(blocks)
    ]
    corpus = counted[0]
    for more in counted[1:]:
        corpus = corpus.unionByName(more)
    rarity = corpus.groupBy("shingle").agg(F.count("*").alias("n"))
    prefix = store(
        shingled.join(rarity, "shingle", "left")
        .groupBy("window")
        .agg(
            F.min_by(
                F.struct("shingle", "offset"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")
            ).alias("rarest"),
            F.first("items").alias("items"),
        )
        .select("window", "items", "rarest.*")
    )
    matched = None
    for b in range(len(parts)):
        block = F.broadcast(prefix.where(F.pmod(F.hash("window"), F.lit(blocks)) == b).alias("w"))
        start = F.col("d.at") - F.col("w.offset")
        occurs = (
            (F.col("d.shingle") == F.col("w.shingle"))
            & (start >= 0)
            & (start + F.size("w.window") <= F.size("d.words"))
            & (F.slice("d.words", F.greatest(start, F.lit(0)) + 1, F.size("w.window")) == F.col("w.window"))
        )
        hits = (
            positions.alias("d")
            .join(block, occurs, "left")
            .where(F.col("w.window").isNotNull() | (F.coalesce("d.at", F.lit(0)) == 0))
            .select(
                "d.row",
                "d.doc_id",
                F.size("d.words").alias("n_words"),
                F.when(
                    F.col("w.window").isNotNull(), F.struct(start.alias("a"), (start + F.size("w.window")).alias("b"))
                ).alias("span"),
                "w.items",
            )
        )
        matched = hits if matched is None else matched.unionByName(hits)
    # at most one entry per window that occurs, so a document's rows are bounded by its words
    return (
        matched.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.max("n_words").cast("long").alias("n_words"),
            F.array_sort(F.collect_set("span")).alias("spans"),
            F.collect_set("items").alias("items"),
        )
        .select(
            "doc_id",
            "n_words",
            F.aggregate(
                "spans",
                F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("upto")),
                lambda so_far, s: F.struct(
                    (so_far.hit + F.greatest(s.b - F.greatest(so_far.upto, s.a), F.lit(0))).alias("hit"),
                    F.greatest(so_far.upto, s.b).alias("upto"),
                ),
                lambda end: end.hit,
            ).alias("n_hit"),
            F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"),
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def item_digest(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", items).cast("binary"), 256)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a benchmark window, with all their columns."""
    text = settings.get("text", "text")
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, row_key(docs, settings.pop("doc_id", "doc_id"), text))
    found = contamination(keyed, benchmark, doc_id=key, **settings)
    hit = found.where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(hit, key, "left_anti").drop(key)
