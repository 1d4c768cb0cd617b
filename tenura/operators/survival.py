"""Kaplan-Meier survival and customer lifetime value."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.errors import InsufficientDataError
from tenura.fixed_values import DAYS_PER_MONTH, MIN_CUSTOMERS_CLV
from tenura.operators.ordering import exact_quantile


def survival_at_risk(customers: DataFrame) -> DataFrame:
    """``(timeline_days, at_risk, events, survival_prob)`` per distinct duration.

    Duration is the tenure, at least one day; the event is churn, active
    customers are censored; customers without any date are left out.
    Customers are counted per duration first, so the ordered windows see one
    row per distinct number of days.
    """
    counts = customers.where("tenure_days IS NOT NULL").groupBy(
        F.greatest(F.col("tenure_days"), F.lit(1)).alias("timeline_days")
    ).agg(
        F.count("*").alias("n"),
        F.count_if("is_churned").alias("events"),
    )
    onwards = Window.orderBy(F.desc("timeline_days")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    upto = Window.orderBy("timeline_days").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return counts.withColumn("at_risk", F.sum("n").over(onwards)).select(
        "timeline_days",
        "at_risk",
        "events",
        F.product(1 - F.col("events") / F.col("at_risk")).over(upto).alias("survival_prob"),
    )


def km_curve(customers: DataFrame) -> DataFrame:
    """The survival curve, starting with probability 1 at day 0."""
    curve = survival_at_risk(customers).select("timeline_days", "survival_prob")
    start = F.struct(
        F.lit(0).cast(curve.schema["timeline_days"].dataType).alias("timeline_days"),
        F.lit(1.0).alias("survival_prob"),
    )
    origin = customers.agg(F.count("*").alias("n")).where("n > 0").select(F.inline(F.array(start)))
    return origin.unionByName(curve)


def km_median(customers: DataFrame) -> DataFrame:
    """One row ``(median_lifetime_days)``: first day with survival at or below one half.

    If the curve stays above it, twice the mean tenure.
    """
    reached = F.min(F.when(F.col("survival_prob") <= 0.5, F.col("timeline_days")))
    median = survival_at_risk(customers).agg(reached.cast("double").alias("median"))
    mean = customers.agg((F.avg("tenure_days") * 2).alias("proxy"))
    return median.select(
        F.coalesce(F.col("median"), mean.scalar()).alias("median_lifetime_days")
    )


def clv_per_customer(customers: DataFrame, *, check: bool = True) -> DataFrame:
    """``(customer_id, expected_clv, expected_remaining_months, monthly_spend)``.

    Remaining days are the median lifetime minus tenure, not below 30 for
    active and 0 for churned customers. A customer without any date has no
    tenure and gets NULL.
    """
    if check:
        n = len(customers.select("customer_id").take(MIN_CUSTOMERS_CLV))
        if n < MIN_CUSTOMERS_CLV:
            raise InsufficientDataError(f"lifetime value takes {MIN_CUSTOMERS_CLV} customers; there are {n}")
    left = km_median(customers).scalar() - F.col("tenure_days")
    floor = F.when(F.col("is_churned"), F.lit(0.0)).otherwise(F.lit(30.0))
    rate = F.greatest(F.col("tx_per_month"), F.lit(0.01))
    spend = F.greatest(F.col("aov") * rate, F.lit(0.0))
    # greatest skips NULL, a missing order value must stay missing
    spend = F.when(F.col("aov").isNotNull(), spend)
    months = F.when(F.col("tenure_days").isNotNull(), F.greatest(left, floor) / DAYS_PER_MONTH)
    return (
        customers.withColumns({"_months": months, "_spend": spend})
        .select(
            "customer_id",
            F.round(F.col("_spend") * F.col("_months"), 2).alias("expected_clv"),
            F.round("_months", 1).alias("expected_remaining_months"),
            F.round("_spend", 2).alias("monthly_spend"),
        )
    )


def clv_summary(customers: DataFrame, clv: DataFrame) -> DataFrame:
    return clv.agg(
        F.avg("expected_clv").alias("mean_clv"),
        F.avg("expected_remaining_months").alias("mean_remaining_months"),
        F.max("expected_clv").alias("max_clv"),
    ).withColumn("median_lifetime_days", km_median(customers).scalar())


def clv_histogram(clv: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width histogram ``(bin, lower, upper, customers)`` of CLV, not below 0.

    Empty bins are left out; the largest value belongs to the last bin.
    """
    values = clv.select(F.greatest("expected_clv", F.lit(0.0)).alias("v")).where("v IS NOT NULL")
    span = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")))
    width = F.col("s.hi") - F.col("s.lo")
    position = F.floor((F.col("v") - F.col("s.lo")) * bins / F.nullif(width, F.lit(0.0)))
    bin_number = F.coalesce(F.least(position, F.lit(bins - 1)), F.lit(0)).cast("int")
    return (
        values.withColumn("s", span.scalar())
        .groupBy(bin_number.alias("bin"), "s")
        .agg(F.count("*").alias("customers"))
        .select(
            "bin",
            (F.col("s.lo") + width * F.col("bin") / bins).alias("lower"),
            (F.col("s.lo") + width * (F.col("bin") + 1) / bins).alias("upper"),
            "customers",
        )
    )


def clv_quantile(clv: DataFrame, q: float = 0.9) -> DataFrame:
    return exact_quantile(clv, "expected_clv", q)
