"""Monthly KPIs: revenue, active customers, revenue per customer, churn rate."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.functions.dates import month_label, month_of


def customer_months(tx: DataFrame, *dimensions: str) -> DataFrame:
    """One row per customer and month with revenue and row count.

    Combined before the shuffle, so a customer with a third of all rows
    costs one row per task and month. Everything monthly starts here: a
    month's distinct customers are its rows with a customer.
    """
    return (
        tx.where("transaction_date IS NOT NULL")
        .groupBy("customer_id", month_of("transaction_date").alias("month"), *dimensions)
        .agg(
            F.coalesce(F.sum("transaction_amount"), F.lit(0.0)).alias("revenue"),
            F.count("*").alias("transactions"),
        )
    )


def _months_by(tx: DataFrame, dimension: str, customers: DataFrame | None) -> DataFrame:
    """Customer-months with a column of the transactions or, joined after combining, of the customers."""
    if customers is None:
        return customer_months(tx, dimension)
    return customer_months(tx).join(customers.select("customer_id", dimension), "customer_id", "left")


def monthly_totals(tx: DataFrame) -> DataFrame:
    """``(month, revenue, active, arpu)`` per observed month."""
    totals = customer_months(tx).groupBy("month").agg(
        F.sum("revenue").alias("revenue"), F.count("customer_id").alias("active")
    )
    return totals.withColumn("arpu", F.try_divide("revenue", "active"))


def monthly_revenue(tx: DataFrame) -> DataFrame:
    """Revenue needs no customers: one pass, one row per task and month shuffled."""
    return (
        tx.where("transaction_date IS NOT NULL")
        .groupBy(month_of("transaction_date").alias("month"))
        .agg(F.coalesce(F.sum("transaction_amount"), F.lit(0.0)).alias("revenue"))
    )


def monthly_active(tx: DataFrame) -> DataFrame:
    return monthly_totals(tx).select("month", "active")


def monthly_arpu(tx: DataFrame) -> DataFrame:
    return monthly_totals(tx).select("month", "arpu")


def distinct_months(tx: DataFrame) -> DataFrame:
    return (
        tx.where("transaction_date IS NOT NULL")
        .select(month_of("transaction_date").alias("month"))
        .distinct()
    )


def with_next_month(months: DataFrame) -> DataFrame:
    """Each customer-month with the customer's next active month.

    The window holds one customer's months, at most one row per calendar month.
    """
    ahead = Window.partitionBy("customer_id").orderBy("month")
    return months.withColumn("next_month", F.lead("month").over(ahead))


def monthly_kpis(tx: DataFrame) -> DataFrame:
    """Revenue, active customers, ARPU and churn rate per observed month.

    Churn compares consecutive *observed* months: the share of the previous
    month's customers absent from this one; NULL in the first month. No self
    join: customers are counted by (month, next active month), and a
    customer retained in the following observed month is one whose next
    active month is exactly that one.
    """
    pairs = (
        with_next_month(customer_months(tx))
        .groupBy("month", "next_month")
        .agg(F.sum("revenue").alias("revenue"), F.count("customer_id").alias("active"))
    )
    # From here on the data is bounded by the calendar: one row per month,
    # each with one map entry per later month.
    followers = F.map_from_entries(
        F.collect_list(
            F.when(F.col("next_month").isNotNull(), F.struct("next_month", "active"))
        )
    )
    months = pairs.groupBy("month").agg(
        F.sum("revenue").alias("revenue"),
        F.sum("active").alias("active"),
        followers.alias("followers"),
    )
    order = Window.orderBy("month")
    previous = F.lag("active").over(order)
    retained = F.coalesce(
        F.try_element_at(F.lag("followers").over(order), F.col("month")), F.lit(0)
    )
    lost = (
        F.when(previous.isNull(), None)
        .when(previous == 0, F.lit(0.0))
        .otherwise((previous - retained) * 100.0 / previous)
    )
    return months.select(
        "month",
        month_label("month").alias("month_str"),
        "revenue",
        "active",
        F.try_divide("revenue", "active").alias("arpu"),
        lost.alias("churn_rate"),
    )


def monthly_churn_rate(tx: DataFrame) -> DataFrame:
    """``(month, churn_rate)``; the first observed month has no row."""
    return monthly_kpis(tx).where("churn_rate IS NOT NULL").select("month", "churn_rate")


def month_sequence(tx: DataFrame) -> DataFrame:
    """Observed months with their rank and successor; one row per calendar month."""
    order = Window.orderBy("month")
    return distinct_months(tx).select(
        "month",
        F.row_number().over(order).alias("month_rank"),
        F.lead("month").over(order).alias("following"),
    )


def lapsed_customers(tx: DataFrame) -> DataFrame:
    """``(month, customer_id)``: active in the previous observed month, absent in this one.

    The month sequence is broadcast; its size is bounded by the calendar.
    """
    months = customer_months(tx.where("customer_id IS NOT NULL")).select("customer_id", "month")
    steps = F.broadcast(month_sequence(tx))
    return (
        with_next_month(months)
        .join(steps, "month")
        .where("following IS NOT NULL AND NOT (next_month <=> following)")
        .select(F.col("following").alias("month"), "customer_id")
    )


def adjacent_months(tx: DataFrame) -> DataFrame:
    """Customers of consecutive observed months: ``(prev_month, month, prev_active, retained)``."""
    months = customer_months(tx.where("customer_id IS NOT NULL")).select("customer_id", "month")
    steps = F.broadcast(month_sequence(tx))
    return (
        with_next_month(months)
        .join(steps, "month")
        .where("following IS NOT NULL")
        .groupBy(F.col("month").alias("prev_month"), F.col("following").alias("month"))
        .agg(
            F.count("*").alias("prev_active"),
            F.count_if(F.col("next_month") == F.col("following")).alias("retained"),
        )
    )


def kpi_snapshot(tx: DataFrame, monthly: DataFrame | None = None) -> DataFrame:
    """One row: the latest month's figures plus all-time revenue and mean amount.

    ``monthly`` passes a stored result of :func:`monthly_kpis`.
    """
    monthly = monthly_kpis(tx) if monthly is None else monthly
    latest = monthly.agg(
        F.max_by(F.struct("revenue", "active", "arpu", "churn_rate"), "month").alias("k"),
        F.max("month").alias("month"),
    )
    overall = tx.agg(
        F.struct(
            F.coalesce(F.sum("transaction_amount"), F.lit(0.0)).alias("total"),
            F.avg("transaction_amount").alias("mean"),
            F.max("transaction_date").alias("last"),
        )
    )
    return latest.withColumn("o", overall.scalar()).select(
        month_label("month").alias("month"),
        F.col("k.revenue").alias("mrr"),
        F.col("k.active").alias("active_subscribers"),
        F.coalesce("k.arpu", F.lit(0.0)).alias("arpu"),
        F.coalesce("k.churn_rate", F.lit(0.0)).alias("monthly_churn_rate"),
        F.col("o.total").alias("total_revenue"),
        F.col("o.mean").alias("avg_transaction_value"),
        (F.to_date("o.last") < F.last_day("o.last")).alias("is_partial"),
    )


def kpi_by_dimension(tx: DataFrame, dimension: str, customers: DataFrame | None = None) -> DataFrame:
    """Monthly revenue, active customers and ARPU per value of a column.

    Where the column is a property of the customer, pass the table
    ``customers`` that has it, one row per customer: transactions are then
    combined to customer-months before the join.
    """
    months = _months_by(tx, dimension, customers)
    return (
        months.groupBy("month", dimension)
        .agg(F.sum("revenue").alias("revenue"), F.count("customer_id").alias("active"))
        .withColumn("arpu", F.try_divide("revenue", "active"))
    )


def kpi_rollup(tx: DataFrame, dimension: str, customers: DataFrame | None = None) -> DataFrame:
    """As :func:`kpi_by_dimension` with subtotals per month and overall (NULL keys).

    ``level`` is 0 for a detail row, 1 for a month, 3 for the total.
    """
    return (
        _months_by(tx, dimension, customers)
        .rollup("month", dimension)
        .agg(
            F.grouping_id().alias("level"),
            F.sum("revenue").alias("revenue"),
            F.count_distinct("customer_id").alias("active"),
        )
        .withColumn("arpu", F.try_divide("revenue", "active"))
    )


def latest_period(tx: DataFrame) -> DataFrame:
    return monthly_revenue(tx).agg(F.max("month").alias("month"))


def revenue_trend(monthly: DataFrame) -> DataFrame:
    """One row comparing recent with earlier months of ``(month, revenue)``.

    Mean of the last three and of the three before, mean of all but the last
    three, and the first and last value. The input holds one row per month.
    """
    newest = Window.orderBy(F.desc("month"))
    rank = F.col("rank")
    older = (rank > 3) | (F.col("n") <= 3) & (rank == F.col("n"))
    return (
        monthly.select(
            "month",
            "revenue",
            F.row_number().over(newest).alias("rank"),
            F.count("*").over(Window.partitionBy()).alias("n"),
        )
        .agg(
            F.count("*").alias("n_months"),
            F.avg(F.when(rank <= 3, F.col("revenue"))).alias("recent_avg"),
            F.avg(F.when((rank > 3) & (rank <= 6), F.col("revenue"))).alias("prior_avg"),
            F.avg(F.when(older, F.col("revenue"))).alias("older_avg"),
            F.min_by("revenue", "month").alias("first_value"),
            F.max_by("revenue", "month").alias("last_value"),
        )
    )
