"""From raw documents to encoded training text, stage by stage."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm import decontaminate, language, secrets, sentencepiece, simhash
from tenura.llm.common import bounded_batches, table
from tenura.session import shared_dir

ORACLE_SQL = None  # models are trained and fingerprints hashed; tests compare each stage with brute force

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those whose language is too uncertain, go.

    So do null and empty texts. Repeated rows get the same verdict; whole texts
    decide, however long; missing ids and further columns play no part.
    """
    bounded_batches(spark)
    return language.keep_identified(docs, language.fit(docs)).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints at most 3 bits apart (3-word shingles) one document stays.

    It is the one with the smallest id (a missing one comes first), and of
    equal ids the one with the smallest hash of its text. Null, empty and blank
    texts are one group, repeated rows another; whole texts are fingerprinted.
    """
    bounded_batches(spark)
    return simhash.one_of_each(docs).select(COLUMNS)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go.

    Null and empty texts have no window and stay; repeated rows go or stay
    together; very long texts are searched to their end.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced in the text, and n_chars follows.

    Null and empty texts stay as they are; equal rows are redacted alike, other
    rows with the same or no id are not touched by them.
    """
    clean = secrets.redact(docs, secrets.scan(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document, and whether they decode to its text.

    A null text has no ids, as an empty one. Every row gives one, repeated ones
    too; very long texts are encoded whole.
    """
    pieces = sentencepiece.read_model()
    encoded = sentencepiece.round_trips(sentencepiece.encode(docs, pieces), pieces)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("identify_language", identify_language),
    ("drop_near_duplicates", drop_near_duplicates),
    ("drop_benchmark_passages", drop_benchmark_passages),
    ("redact_secrets", redact_secrets),
    ("encode_pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
