"""Session settings the library relies on."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_utc(spark: SparkSession) -> None:
    """Months, days and gaps are computed in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's checkpoint folder.

    A session without that setting uses the checkpoint folder of its context,
    or else its warehouse, which all executors share too.
    """
    root = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("spark.sql.warehouse.dir")
    )
    return f"{root.rstrip('/')}/tenura-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder once and continue from the copy.

    For results that several later steps read: they scan the copy instead of
    repeating the work, lost executors cost a re-read, and the optimizer
    knows the size.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
