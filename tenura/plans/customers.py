"""Customer features, labels, split, lifetime value, segments and exports."""

from pyspark.sql import functions as F

from tenura import sinks
from tenura.operators import customers as cust
from tenura.operators import segments, survival
from tenura.operators.ordering import exact_quantile
from tenura.plans import tables as t
from tenura.plans.registry import NUDGE, query, rounded

FEATURES = f"""recency_days, frequency, round(monetary_total, 2) AS monetary_total, round(aov + {NUDGE}, 4) AS aov,
tenure_days, round(tx_per_month + {NUDGE}, 4) AS tx_per_month, round(gap_std_days, 4) AS gap_std_days"""


def _money(df):
    """Four digits, two for sums of money."""
    ratios = tuple(c for c in ("aov", "tx_per_month") if c in df.columns)
    return rounded(df.withColumn("monetary_total", F.round("monetary_total", 2)), ratios=ratios)


# --- Aggregates and gaps -------------------------------------------------------------------


@query(
    "customer_agg",
    f"""WITH {t.TX} SELECT customer_id, max(transaction_date) AS last_tx, min(transaction_date) AS first_tx,
    CAST(count(transaction_date) AS BIGINT) AS frequency, round(sum(transaction_amount), 2) AS monetary_total
    FROM tx GROUP BY 1""",
)
def customer_agg(spark, folder):
    return _money(cust.customer_profile(t.tx(spark, folder)).drop("gap_std_days"))


def _gaps_sql(source: str) -> str:
    return f"""WITH {source}, {t.CUSTOMERS} SELECT customer_id, gap AS gap_days, CAST(count(*) AS BIGINT) AS n
    FROM gaps WHERE gap IS NOT NULL GROUP BY 1, 2"""


@query("tx_gaps", _gaps_sql(t.TX))
def tx_gaps(spark, folder):
    return cust.tx_gaps(t.tx(spark, folder))


@query("tx_gaps_events", _gaps_sql(t.EVENTS))
def tx_gaps_events(spark, folder):
    return cust.tx_gaps(t.events(spark, folder))


@query(
    "sort_tx_by_customer_date",
    f"""WITH {t.TX} SELECT customer_id, transaction_date, transaction_amount FROM tx
    ORDER BY customer_id, transaction_date""",
)
def sort_tx_by_customer_date(spark, folder):
    tx = t.tx(spark, folder).select("customer_id", "transaction_date", "transaction_amount")
    return tx.orderBy("customer_id", "transaction_date")


@query("gap_std", f"WITH {t.TX_CUSTOMERS} SELECT customer_id, round(gap_std_days, 4) AS gap_std_days FROM cust")
def gap_std(spark, folder):
    return rounded(cust.gap_std(t.tx(spark, folder)))


@query(
    "join_left_gap",
    f"""WITH {t.TX_CUSTOMERS}, spread AS (
      SELECT customer_id, stddev_samp(gap) AS s FROM gaps GROUP BY 1)
    SELECT c.customer_id, c.frequency, round(coalesce(s, 0), 4) AS gap_std_days
    FROM cust c LEFT JOIN spread USING (customer_id)""",
)
def join_left_gap(spark, folder):
    return rounded(cust.customer_profile(t.tx(spark, folder)).select("customer_id", "frequency", "gap_std_days"))


@query("rfm_features", f"WITH {t.TX_CUSTOMERS} SELECT customer_id, {FEATURES} FROM feats")
def rfm_features(spark, folder):
    return _money(cust.rfm_features(t.tx(spark, folder)))


@query("rfm_features_events", f"WITH {t.EVENTS}, {t.CUSTOMERS} SELECT customer_id, {FEATURES} FROM feats")
def rfm_features_events(spark, folder):
    return _money(cust.rfm_features(t.events(spark, folder), min_customers=None))


@query(
    "rfm_summary",
    f"""WITH {t.TX_CUSTOMERS} SELECT round(avg(recency_days), 4) AS avg_recency_days,
    round(avg(frequency), 4) AS avg_frequency, round(avg(monetary_total), 2) AS avg_monetary_total,
    round(avg(aov), 2) AS avg_order_value FROM feats""",
)
def rfm_summary(spark, folder):
    summary = cust.rfm_summary(t.customers(spark, folder))
    money = {c: F.round(c, 2) for c in ("avg_monetary_total", "avg_order_value")}
    return rounded(summary.withColumns(money))


@query(
    "global_stats",
    f"""WITH {t.TX_CUSTOMERS} SELECT CAST(count(*) AS BIGINT) AS n_customers,
    round(avg(tenure_days), 4) AS mean_tenure_days, max(recency_days) AS max_recency_days,
    (SELECT max(transaction_date) FROM tx) AS reference_date FROM feats""",
)
def global_stats(spark, folder):
    return rounded(cust.global_stats(t.tx(spark, folder), t.stored_customers(spark, folder)))


# --- Labels, matrix, split -----------------------------------------------------------------


@query(
    "churn_labels",
    f"""WITH {t.TX_CUSTOMERS} SELECT customer_id, is_churned, last_tx_date,
    recency_days AS days_since_last_tx FROM feats""",
)
def churn_labels(spark, folder):
    return cust.churn_labels(t.tx(spark, folder))


@query(
    "join_scalar_reference_date",
    f"""WITH {t.TX_CUSTOMERS} SELECT customer_id, last_tx_date, recency_days AS days_since_last_tx,
    (SELECT max(transaction_date) FROM tx) AS reference_date FROM feats""",
)
def join_scalar_reference_date(spark, folder):
    tx = t.tx(spark, folder)
    return (
        cust.churn_labels(tx)
        .drop("is_churned")
        .withColumn("reference_date", cust.reference_date(tx))
    )


@query(
    "churn_labels_multi",
    f"""WITH {t.TX_CUSTOMERS} SELECT customer_id, recency_days AS days_since_last_tx,
    CAST(w AS INTEGER) AS churn_window_days, recency_days > w AS is_churned
    FROM feats, (SELECT unnest([30, 60, 90, 120]) AS w)""",
)
def churn_labels_multi(spark, folder):
    return cust.churn_labels_multi(t.tx(spark, folder))


@query(
    "churn_summary",
    f"""WITH {t.TX_CUSTOMERS} SELECT CAST(count(*) FILTER (is_churned) AS BIGINT) AS n_churned,
    CAST(count(*) FILTER (NOT is_churned) AS BIGINT) AS n_active,
    round(avg(CAST(is_churned AS INTEGER)), 6) AS churn_rate FROM feats""",
)
def churn_summary(spark, folder):
    return rounded(cust.churn_summary(cust.churn_labels(t.tx(spark, folder))), 6)


MATRIX = f"""CAST(recency_days AS DOUBLE) AS recency_days, CAST(frequency AS DOUBLE) AS frequency,
round(monetary_total, 2) AS monetary_total, round(aov + {NUDGE}, 4) AS aov, CAST(tenure_days AS DOUBLE) AS tenure_days,
round(tx_per_month + {NUDGE}, 4) AS tx_per_month, round(gap_std_days, 4) AS gap_std_days,
CAST(is_churned AS INTEGER) AS is_churned, first_tx_date"""


@query("feature_matrix", f"WITH {t.TX_CUSTOMERS} SELECT customer_id, {MATRIX} FROM feats")
def feature_matrix(spark, folder):
    return _money(cust.feature_matrix(t.customers(spark, folder)))


@query(
    "join_inner_features",
    f"""WITH {t.TX_CUSTOMERS}, firsts AS (SELECT customer_id, min(transaction_date) AS first_date FROM tx GROUP BY 1)
    SELECT f.customer_id, f.recency_days, f.frequency, c.is_churned, first_date AS first_tx_date
    FROM feats f JOIN feats c ON c.customer_id = f.customer_id JOIN firsts x ON x.customer_id = f.customer_id""",
)
def join_inner_features(spark, folder):
    return t.customers(spark, folder).select(
        "customer_id", "recency_days", "frequency", "is_churned", "first_tx_date"
    )


@query("join_inner_labels", f"WITH {t.TX_CUSTOMERS} SELECT customer_id, {FEATURES}, is_churned FROM feats")
def join_inner_labels(spark, folder):
    tx = t.tx(spark, folder)
    labels = cust.churn_labels(tx).select("customer_id", "is_churned")
    return _money(cust.rfm_features(tx).join(labels, "customer_id"))


SPLIT = """
cutoff AS (SELECT quantile_cont(CAST(epoch_us(first_tx_date) AS DOUBLE), 0.8) AS c FROM feats),
split AS (
  SELECT *, CASE WHEN epoch_us(first_tx_date) <= (SELECT c FROM cutoff) THEN 'train' ELSE 'test' END AS split
  FROM feats)"""


@query(
    "temporal_split",
    f"WITH {t.TX_CUSTOMERS}, {SPLIT} SELECT customer_id, first_tx_date, split FROM split",
)
def temporal_split(spark, folder):
    matrix = cust.feature_matrix(t.stored_customers(spark, folder))
    return cust.temporal_split(matrix).select("customer_id", "first_tx_date", "split")


@query(
    "split_predicate",
    f"""WITH {t.TX_CUSTOMERS}, {SPLIT} SELECT split, CAST(count(*) AS BIGINT) AS customers,
    CAST(sum(CAST(is_churned AS INTEGER)) AS BIGINT) AS churned, min(first_tx_date) AS first_joined,
    max(first_tx_date) AS last_joined FROM split GROUP BY 1""",
)
def split_predicate(spark, folder):
    matrix = cust.feature_matrix(t.stored_customers(spark, folder))
    return (
        cust.temporal_split(matrix)
        .groupBy("split")
        .agg(
            F.count("*").alias("customers"),
            F.sum("is_churned").alias("churned"),
            F.min("first_tx_date").alias("first_joined"),
            F.max("first_tx_date").alias("last_joined"),
        )
    )


@query(
    "split_leakage_assert",
    f"""WITH {t.TX_CUSTOMERS}, {SPLIT} SELECT CAST(count(*) AS BIGINT) AS leaking FROM split
    WHERE split = 'test' AND first_tx_date <= (SELECT max(first_tx_date) FROM split WHERE split = 'train')""",
)
def split_leakage_assert(spark, folder):
    matrix = cust.feature_matrix(t.stored_customers(spark, folder))
    return cust.split_leakage(cust.temporal_split(matrix))


@query(
    "nlargest_dates",
    f"""WITH {t.TX_CUSTOMERS} SELECT customer_id, first_tx_date FROM feats
    ORDER BY first_tx_date DESC, customer_id LIMIT 20""",
)
def nlargest_dates(spark, folder):
    return cust.latest_joiners(cust.feature_matrix(t.customers(spark, folder)), 20)


# --- Clips and quantiles -----------------------------------------------------------------------


@query(
    "clip",
    f"""WITH {t.TX_CUSTOMERS} SELECT customer_id, tenure_days,
    round(greatest(tenure_days / 30.44, 1), 4) AS months,
    round(greatest(aov * greatest(tx_per_month, 0.01), 0), 2) AS monthly_spend,
    round(least(greatest(churn_probability, 0), 1), 4) AS proxy FROM scored""",
)
def clip(spark, folder):
    scored = segments.with_scores(t.stored_customers(spark, folder))
    floor = lambda c, low: F.greatest(c, F.lit(low))
    return scored.select(
        "customer_id",
        "tenure_days",
        F.round(floor(F.col("tenure_days") / 30.44, 1.0), 4).alias("months"),
        F.round(floor(F.col("aov") * floor(F.col("tx_per_month"), 0.01), 0.0), 2).alias("monthly_spend"),
        F.round("churn_probability", 4).alias("proxy"),
    )


QUANTILES = """
SELECT quantile_cont(CAST(epoch_us(first_tx_date) AS DOUBLE), 0.8) AS first_date_micros_q80,
       round(quantile_cont(CAST(monetary_total AS DOUBLE), 0.75), 2) AS spend_q75 FROM feats"""


@query("quantile_linear", f"WITH {t.TX_CUSTOMERS} {QUANTILES}")
def quantile_linear(spark, folder):
    customers = t.stored_customers(spark, folder)
    return cust.split_cutoff(customers).select(
        F.col("cutoff_micros").alias("first_date_micros_q80"),
        F.round(exact_quantile(customers, "monetary_total", 0.75).scalar(), 2).alias("spend_q75"),
    )


@query("quantile_distributed", f"WITH {t.TX_CUSTOMERS} {QUANTILES}")
def quantile_distributed(spark, folder):
    """As ``quantile_linear`` by the path for columns that outgrow one task."""
    customers = t.stored_customers(spark, folder)
    spend = exact_quantile(customers, "monetary_total", 0.75)
    return cust.split_cutoff(customers).select(
        F.col("cutoff_micros").alias("first_date_micros_q80"),
        F.round(spend.scalar(), 2).alias("spend_q75"),
    )


# --- Survival and lifetime value ------------------------------------------------------------------

# Each duration is compared with all customers at risk at that time.
SURVIVAL = """
lives AS (SELECT greatest(tenure_days, 1) AS t, is_churned FROM feats),
risk AS (
  SELECT d.t AS timeline_days, (SELECT count(*) FROM lives l WHERE l.t >= d.t) AS at_risk, d.events
  FROM (SELECT t, count(*) FILTER (is_churned) AS events FROM lives GROUP BY t) d),
survival AS (
  SELECT *, product(1 - events * 1.0 / at_risk) OVER (ORDER BY timeline_days) AS survival_prob FROM risk),
median AS (
  SELECT coalesce((SELECT min(timeline_days) FROM survival WHERE survival_prob <= 0.5),
                  (SELECT 2 * avg(tenure_days) FROM feats)) AS m),
left_days AS (
  SELECT *, CASE WHEN is_churned THEN greatest((SELECT m FROM median) - tenure_days, 0)
                 ELSE greatest((SELECT m FROM median) - tenure_days, 30) END / 30.44 AS months,
         greatest(aov * greatest(tx_per_month, 0.01), 0) AS spend FROM feats),
clv AS (
  SELECT customer_id, round(spend * months, 2) AS expected_clv, round(months, 1) AS expected_remaining_months,
         round(spend, 2) AS monthly_spend FROM left_days)"""

TX_CLV = t.TX_CUSTOMERS + "," + SURVIVAL


def _clv(spark, folder):
    return survival.clv_per_customer(t.stored_customers(spark, folder))


@query(
    "survival_at_risk",
    f"""WITH {TX_CLV} SELECT timeline_days, CAST(at_risk AS BIGINT) AS at_risk, CAST(events AS BIGINT) AS events,
    round(survival_prob, 6) AS survival_prob FROM survival""",
)
def survival_at_risk(spark, folder):
    return rounded(survival.survival_at_risk(t.customers(spark, folder)), 6)


@query(
    "km_curve",
    f"""WITH {TX_CLV} SELECT timeline_days, round(survival_prob, 6) AS survival_prob FROM survival
    UNION ALL SELECT 0, 1.0""",
)
def km_curve(spark, folder):
    return rounded(survival.km_curve(t.stored_customers(spark, folder)), 6)


@query("km_median", f"WITH {TX_CLV} SELECT CAST(m AS DOUBLE) AS median_lifetime_days FROM median")
def km_median(spark, folder):
    return survival.km_median(t.stored_customers(spark, folder))


@query("clv_per_customer", f"WITH {TX_CLV} SELECT * FROM clv")
def clv_per_customer(spark, folder):
    return _clv(spark, folder)


@query(
    "conditional_select",
    f"""WITH {TX_CLV} SELECT is_churned, CAST(count(*) AS BIGINT) AS customers,
    min(expected_remaining_months) AS least_months, max(expected_remaining_months) AS most_months
    FROM clv JOIN feats USING (customer_id) GROUP BY 1""",
)
def conditional_select(spark, folder):
    customers = t.stored_customers(spark, folder)
    churned = customers.select("customer_id", "is_churned")
    return (
        survival.clv_per_customer(customers)
        .join(churned, "customer_id")
        .groupBy("is_churned")
        .agg(
            F.count("*").alias("customers"),
            F.min("expected_remaining_months").alias("least_months"),
            F.max("expected_remaining_months").alias("most_months"),
        )
    )


@query(
    "clv_summary",
    f"""WITH {TX_CLV} SELECT round(avg(expected_clv), 2) AS mean_clv,
    round(avg(expected_remaining_months), 2) AS mean_remaining_months, round(max(expected_clv), 2) AS max_clv,
    CAST((SELECT m FROM median) AS DOUBLE) AS median_lifetime_days FROM clv""",
)
def clv_summary(spark, folder):
    customers = t.stored_customers(spark, folder)
    return rounded(survival.clv_summary(customers, survival.clv_per_customer(customers)), 2)


@query(
    "clv_histogram",
    f"""WITH {TX_CLV}, v AS (SELECT greatest(expected_clv, 0) AS v FROM clv),
    s AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
    b AS (SELECT least(CAST(floor((v - lo) * 30 / (hi - lo)) AS INTEGER), 29) AS bin, lo, hi FROM v, s)
    SELECT bin, round(lo + (hi - lo) * bin / 30, 2) AS lower, round(lo + (hi - lo) * (bin + 1) / 30, 2) AS upper,
    CAST(count(*) AS BIGINT) AS customers FROM b GROUP BY bin, lo, hi""",
)
def clv_histogram(spark, folder):
    return rounded(survival.clv_histogram(_clv(spark, folder)), 2)


@query("clv_quantile", f"WITH {TX_CLV} SELECT round(quantile_cont(CAST(expected_clv AS DOUBLE), 0.9), 2) AS quantile FROM clv")
def clv_quantile(spark, folder):
    return rounded(survival.clv_quantile(_clv(spark, folder)), 2)


# --- Segments ------------------------------------------------------------------------------------


def segments_sql(source: str) -> str:
    return f"""
segmented AS (
  SELECT customer_id, CASE WHEN is_churned THEN 'Churned' WHEN tenure_days < 90 THEN 'New'
         WHEN churn_probability >= 0.6 THEN 'At Risk'
         WHEN monetary_total >= (SELECT quantile_cont(CAST(monetary_total AS DOUBLE), 0.75) FROM feats) THEN 'High Value'
         ELSE 'Healthy' END AS segment
  FROM {source})"""


@query(
    "recency_proxy",
    f"WITH {t.TX_CUSTOMERS} SELECT customer_id, round(churn_probability, 6) AS churn_probability FROM scored",
)
def recency_proxy(spark, folder):
    return rounded(segments.recency_proxy(t.stored_customers(spark, folder)), 6)


@query("segment_customers", f"WITH {t.TX_CUSTOMERS}, {segments_sql('scored')} SELECT * FROM segmented")
def segment_customers(spark, folder):
    return segments.segment_customers(t.stored_customers(spark, folder))


@query(
    "segment_distribution",
    f"""WITH {t.TX_CUSTOMERS}, {segments_sql('scored')} SELECT segment, CAST(count(*) AS BIGINT) AS customers,
    round(count(*) * 1.0 / (SELECT count(*) FROM segmented), 6) AS share FROM segmented GROUP BY 1""",
)
def segment_distribution(spark, folder):
    return rounded(segments.segment_distribution(segments.segment_customers(t.stored_customers(spark, folder))), 6)


@query(
    "join_left_scores",
    f"""WITH {t.TX_CUSTOMERS}, known AS (SELECT customer_id, churn_probability AS p FROM scored WHERE NOT is_churned)
    SELECT customer_id, round(coalesce(p, 0.5), 6) AS churn_probability FROM feats LEFT JOIN known USING (customer_id)""",
)
def join_left_scores(spark, folder):
    """Scores that cover active customers only; the others get one half."""
    customers = t.stored_customers(spark, folder)
    known = segments.with_scores(customers).where("NOT is_churned")
    scored = segments.with_scores(customers, known).select("customer_id", "churn_probability")
    return rounded(scored, 6)


# --- Exports ---------------------------------------------------------------------------------------

_EXPORT = """customer_id AS "Customer ID", round(churn_probability, 4) AS "Churn Probability",
recency_days AS "Days Since Last Purchase", round(monetary_total, 2) AS "Total Spend",
frequency AS "Total Purchases\""""


def _export(df):
    return df.withColumn("Total Spend", F.round("Total Spend", 2))


def _scores(spark, folder):
    customers = t.stored_customers(spark, folder)
    return segments.recency_proxy(customers), customers


@query("sink_at_risk_csv", f"WITH {t.TX_CUSTOMERS} SELECT {_EXPORT} FROM scored")
def sink_at_risk_csv(spark, folder):
    return _export(sinks.at_risk_export(*_scores(spark, folder)))


@query("sink_full_predictions_csv", f'WITH {t.TX_CUSTOMERS} SELECT {_EXPORT}, tenure_days AS "Tenure Days" FROM scored')
def sink_full_predictions_csv(spark, folder):
    return _export(sinks.full_predictions_export(*_scores(spark, folder)))


@query(
    "sink_clv_csv",
    f"""WITH {TX_CLV} SELECT customer_id AS "Customer ID", expected_clv AS "Expected CLV",
    expected_remaining_months AS "Remaining Months", monthly_spend AS "Monthly Spend" FROM clv""",
)
def sink_clv_csv(spark, folder):
    return sinks.clv_export(_clv(spark, folder))


@query(
    "join_left_export",
    f"""WITH {t.TX_CUSTOMERS} SELECT customer_id, round(churn_probability, 6) AS churn_probability, recency_days,
    round(monetary_total, 2) AS monetary_total, frequency FROM scored""",
)
def join_left_export(spark, folder):
    scores, customers = _scores(spark, folder)
    context = customers.select("customer_id", "recency_days", "monetary_total", "frequency")
    joined = scores.join(context, "customer_id", "left")
    return rounded(joined.withColumn("monetary_total", F.round("monetary_total", 2)), 6)


@query(
    "sort_scores_desc",
    f"""WITH {t.TX_CUSTOMERS} SELECT customer_id, round(churn_probability, 6) AS churn_probability FROM scored
    ORDER BY churn_probability DESC, customer_id""",
)
def sort_scores_desc(spark, folder):
    scores, _ = _scores(spark, folder)
    return rounded(scores.orderBy(F.desc("churn_probability"), "customer_id"), 6)


@query(
    "sort_clv_desc",
    f"WITH {TX_CLV} SELECT customer_id, expected_clv FROM clv ORDER BY expected_clv DESC, customer_id",
)
def sort_clv_desc(spark, folder):
    return _clv(spark, folder).select("customer_id", "expected_clv").orderBy(F.desc("expected_clv"), "customer_id")


@query(
    "top_at_risk",
    f"""WITH {t.TX_CUSTOMERS} SELECT customer_id AS "Customer ID", format('{{:.1f}}%', churn_probability * 100) AS "Churn Risk",
    '$' || format('{{:,.0f}}', monetary_total) AS "Total Spend", recency_days AS "Days Inactive",
    frequency AS "Purchases" FROM scored ORDER BY churn_probability DESC, customer_id LIMIT 20""",
)
def top_at_risk(spark, folder):
    return sinks.top_at_risk(*_scores(spark, folder))


@query(
    "pii_email_ids",
    f"""WITH {t.PARSED} SELECT CAST(count(*) FILTER (contains(customer_id, '@')) AS BIGINT) AS ids_with_at,
    count(*) FILTER (contains(customer_id, '@')) > 0 AS privacy_notice FROM parsed""",
)
def pii_email_ids(spark, folder):
    return sinks.email_like_ids(t.parsed(spark, folder))
