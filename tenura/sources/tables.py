"""Parquet tables as transaction tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.session import ensure_utc


# Stated so that no job opens the files to find out.
SCHEMAS = {
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
        "o_totalprice double, o_orderdate timestamp_ntz"
    ),
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, value double",
    "documents": "doc_id bigint, text string, lang string, source string",
}


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


def orders_as_transactions(
    spark: SparkSession, folder: str, *, dimensions: bool = False
) -> DataFrame:
    """One transaction per order.

    ``dimensions=True`` adds ``product`` and ``country`` of the customer. The
    customer table grows with the data, so how to join it is left to the
    optimizer, which splits customers with very many orders at run time.
    """
    rows = read_table(spark, folder, "orders")
    added = []
    if dimensions:
        customers = read_table(spark, folder, "customer").join(
            read_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
        )
        rows = rows.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        added = [F.col("c_mktsegment").alias("product"), F.col("n_name").alias("country")]
    return rows.select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderdate").alias("transaction_date"),
        F.col("o_totalprice").alias("transaction_amount"),
        F.col("o_orderkey").cast("string").alias("subscription_id"),
        F.col("o_orderstatus").alias("subscription_status"),
        *added,
    )


def customer_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    """``(customer_id, product, country)``, one row per customer."""
    nation = read_table(spark, folder, "nation")
    return (
        read_table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").cast("string").alias("customer_id"),
            F.col("c_mktsegment").alias("product"),
            F.col("n_name").alias("country"),
        )
    )


def events_as_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """One transaction per event, with time of day."""
    return read_table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("ts").alias("transaction_date"),
        F.col("value").alias("transaction_amount"),
    )
