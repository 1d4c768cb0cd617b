import datetime
import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path[:0] = [os.path.dirname(os.path.dirname(__file__)), os.path.dirname(__file__)]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_tx(spark):
    """Transactions from ``(customer, 'yyyy-mm-dd[ hh:mm:ss]', amount)`` rows."""

    def make(rows):
        df = spark.createDataFrame(rows, "customer_id string, d string, transaction_amount double")
        return df.select(
            "customer_id",
            F.col("d").cast("timestamp_ntz").alias("transaction_date"),
            "transaction_amount",
        )

    return make


def month_days(n, start=(2023, 1), day=1):
    """First days of ``n`` months."""
    year, month = start
    dates = []
    for i in range(n):
        y, m = divmod(month - 1 + i, 12)
        dates.append(datetime.date(year + y, m + 1, day).isoformat())
    return dates
