"""Result tables for people: exports and formatted reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.fixed_values import AT_RISK_HEADERS, CLV_HEADERS, FULL_HEADERS
from tenura.functions import text


def _scored_export(scores: DataFrame, customers: DataFrame, headers: dict) -> DataFrame:
    context = [c for c in headers if c not in ("customer_id", "churn_probability")]
    return (
        scores.select("customer_id", "churn_probability")
        .join(customers.select("customer_id", *context), "customer_id", "left")
        .orderBy(F.desc("churn_probability"), "customer_id")
        .withColumn("churn_probability", F.round("churn_probability", 4))
        .select(*headers)
        .withColumnsRenamed(headers)
    )


def at_risk_export(scores: DataFrame, customers: DataFrame) -> DataFrame:
    """All customers by churn probability with recency, spend and purchases."""
    return _scored_export(scores, customers, AT_RISK_HEADERS)


def full_predictions_export(scores: DataFrame, customers: DataFrame) -> DataFrame:
    """As the at-risk export, with tenure."""
    return _scored_export(scores, customers, FULL_HEADERS)


def clv_export(clv: DataFrame) -> DataFrame:
    """The CLV table, most valuable customers first."""
    return (
        clv.select(*CLV_HEADERS)
        .orderBy(F.desc("expected_clv"), "customer_id")
        .withColumnsRenamed(CLV_HEADERS)
    )


def top_at_risk(scores: DataFrame, customers: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` likeliest to churn, formatted for display.

    The top rows are found first; only their features are looked up, with
    those ``n`` ids broadcast to the customers.
    """
    top = scores.orderBy(F.desc("churn_probability"), "customer_id").limit(n)
    context = customers.select("customer_id", "monetary_total", "recency_days", "frequency").join(
        F.broadcast(top.select("customer_id")), "customer_id", "left_semi"
    )
    return (
        top.join(context, "customer_id", "left")
        .orderBy(F.desc("churn_probability"), "customer_id")
        .select(
            F.col("customer_id").alias("Customer ID"),
            text.percent(F.col("churn_probability"), 1).alias("Churn Risk"),
            F.concat(F.lit("$"), text.number(F.col("monetary_total"))).alias("Total Spend"),
            F.col("recency_days").cast("long").alias("Days Inactive"),
            F.col("frequency").cast("long").alias("Purchases"),
        )
    )


def email_like_ids(customers: DataFrame) -> DataFrame:
    """One row: how many ids look like e-mail addresses, and whether any does."""
    looks = F.col("customer_id").contains("@")
    return customers.agg(F.count_if(looks).alias("ids_with_at")).withColumn(
        "privacy_notice", F.col("ids_with_at") > 0
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Write as CSV files with a header, in the order of the rows."""
    df.write.mode("error").csv(path, header=True)
