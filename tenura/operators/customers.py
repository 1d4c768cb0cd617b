"""Per-customer features, churn labels and the temporal split."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.errors import InsufficientDataError, LeakageError
from tenura.fixed_values import (
    CHURN_WINDOWS,
    DAYS_PER_MONTH,
    FEATURES,
    MIN_CUSTOMERS_MODEL,
)
from tenura.functions.dates import timestamp_micros, whole_days
from tenura.operators.ordering import exact_quantile
from tenura.operators.schema import assert_no_leakage


def reference_date(tx: DataFrame, given=None) -> Column:
    """The given snapshot time, or the latest transaction of the whole table.

    The default includes rows without a customer; it is a scalar subquery
    that reads the date column only.
    """
    if given is not None:
        return F.lit(given).cast("timestamp_ntz")
    return tx.agg(F.max("transaction_date").alias("reference_date")).scalar()


def require_customers(tx: DataFrame, minimum: int, operation: str) -> None:
    """Raise unless there are ``minimum`` distinct customers.

    The first rows usually settle it; only if they do not, all are counted.
    """
    ids = tx.select("customer_id").where("customer_id IS NOT NULL")
    if len({r[0] for r in ids.take(20 * minimum)}) >= minimum:
        return
    actual = ids.distinct().count()
    if actual < minimum:
        raise InsufficientDataError(f"{operation} takes {minimum} rows; there are {actual}")


def customer_days(tx: DataFrame) -> DataFrame:
    """One row per customer and calendar day.

    Gaps between transactions of one day are zero whole days, so first and
    last time, count and sum of a day carry all that features need. The
    combine before the shuffle bounds a customer at one row per day and
    task, whatever share of the table the customer has.
    """
    ts = F.col("transaction_date")
    return (
        tx.where("customer_id IS NOT NULL")
        .groupBy("customer_id", F.to_date(ts).alias("day"))
        .agg(
            F.min(ts).alias("opens"),
            F.max(ts).alias("closes"),
            F.count(ts).alias("n"),
            F.sum("transaction_amount").alias("amount"),
        )
    )


def day_gaps(days: DataFrame) -> DataFrame:
    """Add ``gap``: whole days since the customer's previous active day."""
    mine = Window.partitionBy("customer_id").orderBy("day")
    return days.withColumn("gap", whole_days(F.lag("closes").over(mine), F.col("opens")))


def tx_gaps(tx: DataFrame) -> DataFrame:
    """How often each gap (whole days between consecutive transactions) occurs per customer."""
    gaps = day_gaps(customer_days(tx).where("day IS NOT NULL"))
    between = F.struct(F.col("gap").alias("gap_days"), F.lit(1).cast("long").alias("n"))
    within = F.struct(F.lit(0).cast("long").alias("gap_days"), (F.col("n") - 1).alias("n"))
    return (
        gaps.select("customer_id", F.explode(F.array(between, within)).alias("g"))
        .where("g.gap_days IS NOT NULL AND g.n > 0")
        .groupBy("customer_id", "g.gap_days")
        .agg(F.sum("g.n").alias("n"))
    )


def customer_profile(tx: DataFrame) -> DataFrame:
    """One row per customer: first and last date, count, spend, spread of gaps.

    Two shuffles: customer-days, then customers; window and final aggregation
    share the second one.
    """
    gaps = F.sum(F.greatest(F.col("n") - 1, F.lit(0)) + F.col("gap").isNotNull().cast("long"))
    total = F.sum("gap")
    squares = F.sum(F.col("gap") * F.col("gap"))
    spread = F.when(
        gaps > 1,
        F.sqrt(F.greatest((squares - total * total / gaps) / (gaps - 1), F.lit(0.0))),
    )
    return (
        day_gaps(customer_days(tx))
        .groupBy("customer_id")
        .agg(
            F.max("closes").alias("last_tx"),
            F.min("opens").alias("first_tx"),
            F.sum("n").alias("frequency"),
            F.coalesce(F.sum("amount"), F.lit(0.0)).alias("monetary_total"),
            F.coalesce(spread, F.lit(0.0)).alias("gap_std_days"),
        )
    )


def gap_std(tx: DataFrame) -> DataFrame:
    return customer_profile(tx).select("customer_id", "gap_std_days")


def _rfm_columns(reference: Column) -> dict[str, Column]:
    tenure = F.greatest(whole_days(F.col("first_tx"), F.col("last_tx")), F.lit(1))
    tenure = F.when(F.col("last_tx").isNotNull(), tenure)
    months = F.greatest(F.col("tenure_days") / DAYS_PER_MONTH, F.lit(1.0))
    return {
        "recency_days": whole_days(F.col("last_tx"), reference),
        "tenure_days": tenure,
        "aov": F.try_divide("monetary_total", "frequency"),
        "tx_per_month": F.col("frequency") / months,
    }


def _label_columns(window_days: int) -> dict[str, Column]:
    """A customer without any date has no recency and counts as active."""
    return {
        "is_churned": F.coalesce(F.col("recency_days") > window_days, F.lit(False)),
    }


def customer_table(
    tx: DataFrame,
    *,
    churn_window_days: int = 90,
    reference=None,
    min_customers: int | None = MIN_CUSTOMERS_MODEL,
) -> DataFrame:
    """Features, label and first/last date of every customer in one pass.

    Everything per customer downstream is a projection of this table; store
    it (:func:`tenura.session.store`) when several results are needed. ``min_customers=None`` skips
    the size check.
    """
    if min_customers is not None:
        require_customers(tx, min_customers, "RFM")
    columns = _rfm_columns(reference_date(tx, reference))
    months = {"tx_per_month": columns.pop("tx_per_month")}
    return (
        customer_profile(tx)
        .withColumns(columns)
        .withColumns({**months, **_label_columns(churn_window_days)})
        .select(
            "customer_id",
            *FEATURES,
            "is_churned",
            F.col("first_tx").alias("first_tx_date"),
            F.col("last_tx").alias("last_tx_date"),
        )
    )


def rfm_features(tx: DataFrame, **options) -> DataFrame:
    """``customer_id`` and the seven features."""
    return customer_table(tx, **options).select("customer_id", *FEATURES)


def churn_labels(tx: DataFrame, *, churn_window_days: int = 90, reference=None) -> DataFrame:
    """``(customer_id, is_churned, last_tx_date, days_since_last_tx)``.

    Churned means more than ``churn_window_days`` whole days without a transaction.
    """
    last = (
        tx.where("customer_id IS NOT NULL")
        .groupBy("customer_id")
        .agg(F.max("transaction_date").alias("last_tx_date"))
    )
    since = whole_days(F.col("last_tx_date"), reference_date(tx, reference))
    return (
        last.withColumn("recency_days", since)
        .withColumns(_label_columns(churn_window_days))
        .select(
            "customer_id",
            "is_churned",
            "last_tx_date",
            F.col("recency_days").alias("days_since_last_tx"),
        )
    )


def churn_labels_multi(tx: DataFrame, windows=CHURN_WINDOWS, reference=None) -> DataFrame:
    """Labels for several windows at once: one more row per customer and window."""
    days = F.col("days_since_last_tx")
    return (
        churn_labels(tx, reference=reference)
        .select(
            "customer_id",
            days,
            F.explode(F.array(*[F.lit(w) for w in windows])).alias("churn_window_days"),
        )
        .withColumn(
            "is_churned", F.coalesce(days > F.col("churn_window_days"), F.lit(False))
        )
    )


def churn_summary(labels: DataFrame) -> DataFrame:
    """One row: churned, active, rate (0 without customers)."""
    churned = F.count_if("is_churned")
    return labels.agg(
        churned.alias("n_churned"),
        F.count_if(~F.col("is_churned")).alias("n_active"),
        F.coalesce(F.try_divide(churned, F.count("*")), F.lit(0.0)).alias("churn_rate"),
    )


def rfm_summary(customers: DataFrame) -> DataFrame:
    return customers.agg(
        F.avg("recency_days").alias("avg_recency_days"),
        F.avg("frequency").alias("avg_frequency"),
        F.avg("monetary_total").alias("avg_monetary_total"),
        F.avg("aov").alias("avg_order_value"),
    )


def global_stats(tx: DataFrame, customers: DataFrame) -> DataFrame:
    """One row: latest date, customers, mean tenure, largest recency."""
    return customers.agg(
        F.count("*").alias("n_customers"),
        F.avg("tenure_days").alias("mean_tenure_days"),
        F.max("recency_days").alias("max_recency_days"),
    ).withColumn("reference_date", reference_date(tx))


def feature_matrix(customers: DataFrame, features=FEATURES) -> DataFrame:
    """Model input: features without nulls, 0/1 label, first date."""
    matrix = customers.select("customer_id", *features)
    assert_no_leakage(matrix)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features}
    return customers.select(
        "customer_id",
        *filled.values(),
        F.col("is_churned").cast("int").alias("is_churned"),
        "first_tx_date",
    )


def split_cutoff(matrix: DataFrame, train_ratio: float = 0.80) -> DataFrame:
    """One row ``(cutoff_micros)``: the quantile of first dates in microseconds."""
    joined = matrix.select(timestamp_micros(F.col("first_tx_date")).alias("micros"))
    return exact_quantile(joined, "micros", train_ratio).withColumnRenamed("quantile", "cutoff_micros")


def temporal_split(matrix: DataFrame, *, train_ratio: float = 0.80, check: bool = True) -> DataFrame:
    """Add ``split``: ``train`` up to the cutoff, ``test`` for later joiners.

    If nobody joined after the cutoff, the latest joiners are moved to the
    test set, which fails when one of them shares the last training date.
    ``check=False`` skips that look at the data.
    """
    first = F.col("first_tx_date")
    micros = timestamp_micros(first)
    cutoff = split_cutoff(matrix, train_ratio).scalar()
    if check:
        found = matrix.agg(
            F.count("*").alias("n"), F.max(micros).alias("last")
        ).withColumn("cutoff", cutoff).first()
        if found["n"] < 2:
            raise InsufficientDataError(f"a split by time takes 2 customers; there are {found['n']}")
        cutoff = found["cutoff"]
        if found["last"] <= cutoff:
            cutoff = _cutoff_before_latest(matrix, max(1, round(found["n"] * (1 - train_ratio))))
        cutoff = F.lit(cutoff)
    return matrix.withColumn(
        "split", F.when(micros <= cutoff, F.lit("train")).otherwise(F.lit("test"))
    )


def _cutoff_before_latest(matrix: DataFrame, held_out: int) -> float:
    """The date below the ``held_out`` latest joiners, if a date separates them.

    The cutoff reached the last date, so at least ``held_out`` customers
    joined on it: either exactly those are held out or the date is split.
    """
    by_date = matrix.groupBy(timestamp_micros(F.col("first_tx_date")).alias("micros")).agg(
        F.count("*").alias("n")
    )
    latest = by_date.orderBy(F.desc("micros")).limit(2).collect()
    if len(latest) == 2 and latest[0]["n"] == held_out:
        return float(latest[1]["micros"])
    raise LeakageError("test customers share the first date of the last training customers")


def latest_joiners(matrix: DataFrame, n: int) -> DataFrame:
    """The ``n`` customers who joined last."""
    return (
        matrix.select("customer_id", "first_tx_date")
        .orderBy(F.desc("first_tx_date"), "customer_id")
        .limit(n)
    )


def split_leakage(split: DataFrame) -> DataFrame:
    """One row ``(leaking)``: test customers not later than the last training customer."""
    first = F.col("first_tx_date")
    train_end = split.where("split = 'train'").agg(F.max(first).alias("m")).scalar()
    return split.agg(
        F.count_if((F.col("split") == "test") & (first <= train_end)).alias("leaking")
    )


def assert_split(split: DataFrame) -> DataFrame:
    leaking = split_leakage(split).first()["leaking"]
    if leaking:
        raise LeakageError(f"{leaking} test customers joined before the training cutoff")
    return split
