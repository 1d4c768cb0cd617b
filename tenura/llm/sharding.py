"""Shards by jump consistent hashing: no ring table, and a new shard only takes rows."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.session import store


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key.

    Each key draws its next jump from its own random sequence and stays where
    the jump would leave the range, so with one more shard a key either keeps
    its place or jumps into the new shard.
    """
    state = keys.astype(np.int64).view(np.uint64).copy()
    place = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1
        target = ((place[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        inside = target < shards
        moving, target = moving[inside], target[inside]
        place[moving] = target
    return place.astype(np.int32)


def shard_of(key, shards: int):
    """Column: the shard of a 64-bit key column."""
    if shards < 1:
        raise ValueError("there must be at least one shard")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards))

    return place(key)


def assign_shards(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot within the shard and shard after one more is appended, for every row.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot,
    grown_shard. Only doc_id and the number of shards decide the shard: equal
    ids share one, rows without an id too. A null text counts as empty. Slots
    number the rows of a shard without gaps, in no particular order.
    """
    spark = docs.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    key = F.xxhash64(F.col(doc_id))
    rows = store(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(data).cast("long") + 8).alias("size"),
            F.crc32(data).alias("text_crc32"),
            shard_of(key, shards).alias("shard"),
            shard_of(key, shards + 1).alias("grown_shard"),
            F.pmod(F.monotonically_increasing_id(), F.lit(pieces)).cast("int").alias("piece"),
        )
    )
    # Rows are numbered within small even pieces of a shard; the pieces' first
    # numbers come from a table of shards x pieces counts.
    earlier = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "piece")
        .agg(F.count("*").alias("n"))
        .select("shard", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("number", F.row_number().over(within))
        .join(F.broadcast(starts), ["shard", "piece"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("number") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, doc_id: str = "doc_id") -> None:
    """Write the rows to one folder per shard; every task writes its own files there."""
    key = F.xxhash64(F.col(doc_id))
    docs.withColumn("_shard", shard_of(key, shards)).write.partitionBy("_shard").parquet(path)
