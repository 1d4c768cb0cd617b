"""Monthly cohort retention."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.errors import InsufficientDataError
from tenura.fixed_values import MIN_CUSTOMERS_COHORT
from tenura.functions.dates import month_label, months_between
from tenura.operators.kpis import customer_months


def customer_periods(tx: DataFrame) -> DataFrame:
    """Each active customer-month with the cohort month and months since it.

    The cohort is the first month in a window over one customer's months (at
    most one row per calendar month), so transactions are never joined back
    to their customer.
    """
    months = customer_months(tx.where("customer_id IS NOT NULL"))
    mine = Window.partitionBy("customer_id")
    return (
        months.select("customer_id", "month", F.min("month").over(mine).alias("cohort"))
        .withColumn("period_number", months_between(F.col("cohort"), F.col("month")))
        .where("period_number >= 0")
    )


def cohort_retention(
    tx: DataFrame, *, min_customers: int = MIN_CUSTOMERS_COHORT, check: bool = False
) -> DataFrame:
    """``(cohort_month, period_number, customers, cohort_size, retention_pct)``.

    Cohorts below ``min_customers`` are left out; ``check`` raises when none is left.
    """
    counts = customer_periods(tx).groupBy("cohort", "period_number").agg(
        F.count("*").alias("customers")
    )
    first = F.when(F.col("period_number") == 0, F.col("customers"))
    sized = counts.withColumn("cohort_size", F.max(first).over(Window.partitionBy("cohort")))
    if check:
        largest = sized.agg(F.max("cohort_size")).first()[0] or 0
        if largest < min_customers:
            raise InsufficientDataError(f"cohorts take {min_customers} customers; the largest has {largest}")
    return sized.where(F.col("cohort_size") >= min_customers).select(
        month_label("cohort").alias("cohort_month"),
        "period_number",
        "customers",
        "cohort_size",
        (F.col("customers") * 100.0 / F.col("cohort_size")).alias("retention_pct"),
    )


def cohort_sizes(tx: DataFrame, **options) -> DataFrame:
    return (
        cohort_retention(tx, **options)
        .where("period_number = 0")
        .select("cohort_month", "cohort_size")
    )


def cohort_matrix(retention: DataFrame, periods=None) -> DataFrame:
    """Wide form: one column ``Month n`` per period that occurs, missing cells 0.

    Naming the ``periods`` saves the job that finds them.
    """
    if periods is None:
        periods = [
            r[0] for r in retention.select("period_number").distinct().orderBy("period_number").collect()
        ]
    wide = retention.groupBy("cohort_month").pivot("period_number", list(periods)).agg(
        F.first("retention_pct")
    )
    return wide.na.fill(0.0).withColumnsRenamed({str(p): f"Month {p}" for p in periods})


def cohort_heatmap(retention: DataFrame, max_periods: int = 13) -> DataFrame:
    """Cells of the heatmap: the first periods that occur, newest cohort first, zero as NULL.

    The input has one row per cohort and period, bounded by the calendar.
    """
    nth = F.dense_rank().over(Window.orderBy("period_number"))
    return (
        retention.withColumn("nth", nth)
        .where(F.col("nth") <= max_periods)
        .select(
            "cohort_month",
            "period_number",
            F.nullif(F.col("retention_pct"), F.lit(0.0)).alias("retention_pct"),
        )
        .orderBy(F.desc("cohort_month"), "period_number")
    )


def valid_cohort_customers(tx: DataFrame, *, min_customers: int = MIN_CUSTOMERS_COHORT) -> DataFrame:
    """Customer-months whose cohort is large enough.

    The valid cohorts are broadcast: at most one row per calendar month.
    """
    rows = customer_periods(tx)
    valid = (
        rows.where("period_number = 0")
        .groupBy("cohort")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_customers)
    )
    return rows.join(F.broadcast(valid), "cohort", "left_semi").select(
        "customer_id",
        month_label("cohort").alias("cohort_month"),
        month_label("month").alias("month"),
        "period_number",
    )
