"""Rule-based customer segments."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.fixed_values import AT_RISK_PROBABILITY, HIGH_VALUE_QUANTILE, NEW_TENURE_DAYS
from tenura.operators.ordering import exact_quantile


def with_scores(customers: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Customers with ``churn_probability``; 0.5 where a given score is missing.

    Without scores, recency relative to the longest one stands in for them.
    That proxy lies between 0 and 1 and needs no join.
    """
    if scores is None:
        longest = customers.agg(F.greatest(F.max("recency_days"), F.lit(1))).scalar()
        share = F.least(F.greatest(F.col("recency_days") / longest, F.lit(0.0)), F.lit(1.0))
        return customers.withColumn("churn_probability", share)
    return customers.join(
        scores.select("customer_id", "churn_probability"), "customer_id", "left"
    ).na.fill(0.5, ["churn_probability"])


def recency_proxy(customers: DataFrame) -> DataFrame:
    """``(customer_id, churn_probability)`` from recency alone."""
    return with_scores(customers).select("customer_id", "churn_probability")


def segment_customers(
    customers: DataFrame,
    scores: DataFrame | None = None,
    *,
    new_threshold_days: int = NEW_TENURE_DAYS,
    at_risk_threshold: float = AT_RISK_PROBABILITY,
    high_value_quantile: float = HIGH_VALUE_QUANTILE,
) -> DataFrame:
    """``(customer_id, segment)``, the first rule that holds.

    The high-value threshold is a quantile over all customers, churned ones included.
    """
    threshold = exact_quantile(customers, "monetary_total", high_value_quantile).scalar()
    segment = (
        F.when(F.col("is_churned"), F.lit("Churned"))
        .when(F.col("tenure_days") < new_threshold_days, F.lit("New"))
        .when(F.col("churn_probability") >= at_risk_threshold, F.lit("At Risk"))
        .when(F.col("monetary_total") >= threshold, F.lit("High Value"))
        .otherwise(F.lit("Healthy"))
    )
    return with_scores(customers, scores).select("customer_id", segment.alias("segment"))


def segment_distribution(segments: DataFrame) -> DataFrame:
    """``(segment, customers, share)``."""
    total = segments.agg(F.count("*").alias("n")).scalar()
    return (
        segments.groupBy("segment")
        .agg(F.count("*").alias("customers"))
        .withColumn("share", F.col("customers") / total)
    )
