"""What several operators share: tables, held-out rows, hot keys, chunks of Arrow rows."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most ``rows`` rows at a time to Python: the usual 10,000 texts are too many for a worker's memory.

    A smaller number that the session has set stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))


def held_out(doc_id: Column, folds: int, fold: int = 2) -> Column:
    """Rows kept away from training; so is a row without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the values only."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def hashed_sample(df: DataFrame, size: int, total: int, *columns: Column | str) -> DataFrame:
    """At most ``size`` of ``total`` rows, drawn by a hash of the columns.

    A first draw leaves about twice as many, so that the task that puts them
    in order gets few from each partition.
    """
    some = df.where(unit_hash(*columns, F.lit(1)) < 2.0 * size / max(total, 1))
    return some.orderBy(F.xxhash64(*columns), *columns).limit(size)


def by_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """A function for mapInArrow that handles one bounded batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return run


def join_counted(many: DataFrame, one: DataFrame, key: str, count: str, share: int = 1000) -> DataFrame:
    """Left join of rows to one row per key, where ``count`` says how many rows a key has.

    Keys with at least a ``share``-th of all rows, of which there are at most
    ``share``, are broadcast, so that no task gets all rows of a hot key.
    """
    total = one.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * share >= F.lit(max(total, share))
    hot_keys = F.broadcast(one.where(hot).limit(share).select(key))
    hot_rows = F.broadcast(one.where(hot).limit(share))
    usual = many.join(hot_keys, key, "left_anti").join(one.where(~hot), key, "left")
    return many.join(hot_rows, key).unionByName(usual)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as make it new among the columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells rows apart, also where ids are missing or repeated; equal rows share it."""
    data = F.col(text).cast("binary")
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(data).alias("hash"), F.crc32(data).alias("crc"))
    # nullable throughout, as it is after it has been written, so that joins need no cast
    return key.cast(f"struct<id:{docs.schema[doc_id].dataType.simpleString()},hash:bigint,crc:bigint>")
