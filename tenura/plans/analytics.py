"""Monthly KPIs and cohorts."""

from pyspark.sql import functions as F

from tenura.operators import cohorts, kpis
from tenura.plans import tables as t
from tenura.plans.registry import NUDGE, labelled, query, rounded
from tenura.sources.tables import customer_dimensions

# Month by month over sets of customers: active in one observed month, gone in the next.
MONTHS = """
months AS (
  SELECT date_trunc('month', transaction_date) AS month, sum(transaction_amount) AS revenue,
         count(DISTINCT customer_id) AS active
  FROM tx WHERE transaction_date IS NOT NULL GROUP BY 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY month) AS nr FROM months),
presence AS (
  SELECT DISTINCT customer_id, nr FROM tx JOIN numbered ON date_trunc('month', transaction_date) = month
  WHERE customer_id IS NOT NULL),
lapsed AS (
  SELECT p.nr + 1 AS nr, p.customer_id FROM presence p
  LEFT JOIN presence n ON n.customer_id = p.customer_id AND n.nr = p.nr + 1
  WHERE n.customer_id IS NULL AND p.nr < (SELECT max(nr) FROM numbered)),
churn AS (
  SELECT m.nr, m.month, 100.0 * (SELECT count(*) FROM lapsed l WHERE l.nr = m.nr) / p.active AS churn_rate
  FROM numbered m JOIN numbered p ON p.nr = m.nr - 1),
kpis AS (
  SELECT m.month, strftime(m.month, '%Y-%m') AS month_str, revenue, active, revenue / active AS arpu, churn_rate
  FROM numbered m LEFT JOIN churn c ON c.nr = m.nr)"""

TX_MONTHS = t.TX + "," + MONTHS


@query(
    "monthly_kpis",
    f"""WITH {TX_MONTHS} SELECT month_str, round(revenue, 2) AS revenue, CAST(active AS BIGINT) AS active,
    round(arpu + {NUDGE}, 2) AS arpu, round(churn_rate, 2) AS churn_rate FROM kpis""",
)
def monthly_kpis(spark, folder):
    return rounded(kpis.monthly_kpis(t.tx(spark, folder)).drop("month"), 2, ratios=("arpu",))


@query(
    "monthly_revenue",
    f"WITH {TX_MONTHS} SELECT month_str AS month, round(revenue, 2) AS revenue FROM kpis",
)
def monthly_revenue(spark, folder):
    return labelled(rounded(kpis.monthly_revenue(t.tx(spark, folder)), 2))


@query(
    "monthly_active",
    f"WITH {TX_MONTHS} SELECT month_str AS month, CAST(active AS BIGINT) AS active FROM kpis",
)
def monthly_active(spark, folder):
    return labelled(kpis.monthly_active(t.tx(spark, folder)))


@query("monthly_arpu", f"WITH {TX_MONTHS} SELECT month_str AS month, round(arpu + {NUDGE}, 2) AS arpu FROM kpis")
def monthly_arpu(spark, folder):
    return labelled(rounded(kpis.monthly_arpu(t.tx(spark, folder)), 2, ratios=("arpu",)))


@query(
    "monthly_churn_rate",
    f"""WITH {TX_MONTHS} SELECT month_str AS month, round(churn_rate, 4) AS churn_rate
    FROM kpis WHERE churn_rate IS NOT NULL""",
)
def monthly_churn_rate(spark, folder):
    return labelled(rounded(kpis.monthly_churn_rate(t.tx(spark, folder))))


@query(
    "lapsed_customers",
    f"""WITH {TX_MONTHS} SELECT strftime(month, '%Y-%m') AS month, customer_id
    FROM lapsed JOIN numbered USING (nr)""",
)
def lapsed_customers(spark, folder):
    return labelled(kpis.lapsed_customers(t.tx(spark, folder)))


@query(
    "join_anti_lapsed",
    f"""WITH {TX_MONTHS} SELECT strftime(month, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS lapsed
    FROM lapsed JOIN numbered USING (nr) GROUP BY 1""",
)
def join_anti_lapsed(spark, folder):
    lapsed = kpis.lapsed_customers(t.tx(spark, folder))
    return labelled(lapsed.groupBy("month").agg(F.count("*").alias("lapsed")))


@query(
    "join_adjacent_months",
    f"""WITH {TX_MONTHS} SELECT strftime(p.month, '%Y-%m') AS prev_month, strftime(m.month, '%Y-%m') AS month,
    CAST(p.active AS BIGINT) AS prev_active,
    CAST(p.active - (SELECT count(*) FROM lapsed l WHERE l.nr = m.nr) AS BIGINT) AS retained
    FROM numbered m JOIN numbered p ON p.nr = m.nr - 1""",
)
def join_adjacent_months(spark, folder):
    return labelled(kpis.adjacent_months(t.tx(spark, folder)), "prev_month", "month")


@query("distinct_months", f"WITH {TX_MONTHS} SELECT month_str AS month FROM kpis")
def distinct_months(spark, folder):
    return labelled(kpis.distinct_months(t.tx(spark, folder)))


@query("sort_series", f"WITH {TX_MONTHS} SELECT month_str AS month, round(revenue, 2) AS revenue FROM kpis ORDER BY 1")
def sort_series(spark, folder):
    return labelled(rounded(kpis.monthly_revenue(t.tx(spark, folder)), 2)).orderBy("month")


@query("latest_period", f"WITH {TX_MONTHS} SELECT max(month_str) AS month FROM kpis")
def latest_period(spark, folder):
    return labelled(kpis.latest_period(t.tx(spark, folder)))


@query(
    "kpi_snapshot",
    f"""WITH {TX_MONTHS} SELECT month_str AS month, round(revenue, 2) AS mrr,
    CAST(active AS BIGINT) AS active_subscribers, round(arpu + {NUDGE}, 2) AS arpu,
    round(coalesce(churn_rate, 0), 2) AS monthly_churn_rate,
    (SELECT round(sum(transaction_amount), 2) FROM tx) AS total_revenue,
    (SELECT round(avg(transaction_amount) + {NUDGE}, 2) FROM tx) AS avg_transaction_value,
    (SELECT CAST(max(transaction_date) AS DATE) < last_day(CAST(max(transaction_date) AS DATE)) FROM tx) AS is_partial
    FROM kpis ORDER BY month DESC LIMIT 1""",
)
def kpi_snapshot(spark, folder):
    return rounded(kpis.kpi_snapshot(t.tx(spark, folder)), 2, ratios=("arpu", "avg_transaction_value"))


TREND = """
ranked AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS back, count(*) OVER () AS n FROM months),
trend AS (
  SELECT count(*) AS n_months,
         (SELECT avg(revenue) FROM ranked WHERE back <= 3) AS recent_avg,
         (SELECT avg(revenue) FROM ranked WHERE back BETWEEN 4 AND 6) AS prior_avg,
         (SELECT avg(revenue) FROM ranked WHERE n - back < greatest(1, n - 3)) AS older_avg,
         (SELECT revenue FROM ranked ORDER BY month LIMIT 1) AS first_value,
         (SELECT revenue FROM ranked ORDER BY month DESC LIMIT 1) AS last_value
  FROM months)"""


@query(
    "recent_vs_prior_avg",
    f"""WITH {TX_MONTHS}, {TREND} SELECT CAST(n_months AS BIGINT) AS n_months, round(recent_avg, 2) AS recent_avg,
    round(prior_avg, 2) AS prior_avg, round(older_avg, 2) AS older_avg, round(first_value, 2) AS first_value,
    round(last_value, 2) AS last_value FROM trend""",
)
def recent_vs_prior_avg(spark, folder):
    return rounded(kpis.revenue_trend(kpis.monthly_revenue(t.tx(spark, folder))), 2)


@query(
    "kpi_by_dimension",
    f"""WITH {t.TX_DIMENSIONS} SELECT strftime(transaction_date, '%Y-%m') AS month, country,
    round(sum(transaction_amount), 2) AS revenue, CAST(count(DISTINCT customer_id) AS BIGINT) AS active,
    round(sum(transaction_amount) / count(DISTINCT customer_id) + {NUDGE}, 2) AS arpu FROM tx GROUP BY 1, 2""",
)
def kpi_by_dimension(spark, folder):
    return labelled(rounded(kpis.kpi_by_dimension(t.tx(spark, folder), "country", customer_dimensions(spark, folder)), 2, ratios=("arpu",)))


@query(
    "kpi_rollup",
    f"""WITH {t.TX_DIMENSIONS}, m AS (SELECT *, strftime(transaction_date, '%Y-%m') AS month FROM tx)
    SELECT month, product, CAST(grouping(month, product) AS BIGINT) AS level,
    round(sum(transaction_amount), 2) AS revenue, CAST(count(DISTINCT customer_id) AS BIGINT) AS active,
    round(sum(transaction_amount) / count(DISTINCT customer_id) + {NUDGE}, 2) AS arpu FROM m GROUP BY ROLLUP (month, product)""",
)
def kpi_rollup(spark, folder):
    return labelled(rounded(kpis.kpi_rollup(t.tx(spark, folder), "product", customer_dimensions(spark, folder)), 2, ratios=("arpu",)))


COHORTS = """
firsts AS (
  SELECT customer_id, date_trunc('month', min(transaction_date)) AS cohort
  FROM tx WHERE customer_id IS NOT NULL GROUP BY 1),
activity AS (
  SELECT DISTINCT tx.customer_id, cohort, date_trunc('month', transaction_date) AS month,
         12 * (year(transaction_date) - year(cohort)) + month(transaction_date) - month(cohort) AS period_number
  FROM tx JOIN firsts ON tx.customer_id = firsts.customer_id),
cells AS (SELECT cohort, period_number, count(DISTINCT customer_id) AS customers FROM activity GROUP BY 1, 2),
sizes AS (SELECT cohort, customers AS cohort_size FROM cells WHERE period_number = 0 AND customers >= 10),
retention AS (
  SELECT strftime(cohort, '%Y-%m') AS cohort_month, CAST(period_number AS INTEGER) AS period_number,
         CAST(customers AS BIGINT) AS customers, CAST(cohort_size AS BIGINT) AS cohort_size,
         100.0 * customers / cohort_size AS retention_pct
  FROM cells JOIN sizes USING (cohort))"""

TX_COHORTS = t.TX + "," + COHORTS


@query(
    "join_tx_cohort",
    f"""WITH {TX_COHORTS} SELECT customer_id, strftime(cohort, '%Y-%m') AS cohort,
    strftime(month, '%Y-%m') AS month, CAST(period_number AS INTEGER) AS period_number FROM activity""",
)
def join_tx_cohort(spark, folder):
    return labelled(cohorts.customer_periods(t.tx(spark, folder)), "cohort", "month")


@query(
    "fn_month_arith",
    f"""WITH {TX_COHORTS} SELECT CAST(period_number AS INTEGER) AS period_number,
    CAST(count(*) AS BIGINT) AS customer_months FROM activity GROUP BY 1""",
)
def fn_month_arith(spark, folder):
    periods = cohorts.customer_periods(t.tx(spark, folder))
    return periods.groupBy("period_number").agg(F.count("*").alias("customer_months"))


@query(
    "filter_nonneg_period",
    f"""WITH {TX_COHORTS} SELECT CAST(count(*) AS BIGINT) AS customer_months,
    CAST(min(period_number) AS INTEGER) AS lowest FROM activity WHERE period_number >= 0""",
)
def filter_nonneg_period(spark, folder):
    return cohorts.customer_periods(t.tx(spark, folder)).agg(
        F.count("*").alias("customer_months"), F.min("period_number").alias("lowest")
    )


@query(
    "cohort_retention",
    f"""WITH {TX_COHORTS} SELECT cohort_month, period_number, customers, cohort_size,
    round(retention_pct, 4) AS retention_pct FROM retention""",
)
def cohort_retention(spark, folder):
    return rounded(cohorts.cohort_retention(t.tx(spark, folder)))


@query(
    "filter_valid_cohorts",
    f"""WITH {TX_COHORTS} SELECT strftime(cohort, '%Y-%m') AS cohort_month,
    CAST(cohort_size AS BIGINT) AS cohort_size FROM sizes""",
)
@query(
    "cohort_sizes",
    f"""WITH {TX_COHORTS} SELECT strftime(cohort, '%Y-%m') AS cohort_month,
    CAST(cohort_size AS BIGINT) AS cohort_size FROM sizes""",
)
def cohort_sizes(spark, folder):
    return cohorts.cohort_sizes(t.tx(spark, folder))


@query(
    "join_semi_valid_cohorts",
    f"""WITH {TX_COHORTS} SELECT customer_id, strftime(cohort, '%Y-%m') AS cohort_month,
    strftime(month, '%Y-%m') AS month, CAST(period_number AS INTEGER) AS period_number
    FROM activity WHERE cohort IN (SELECT cohort FROM sizes)""",
)
def join_semi_valid_cohorts(spark, folder):
    return cohorts.valid_cohort_customers(t.tx(spark, folder))


_PERIODS = range(80)


@query(
    "cohort_matrix",
    f"WITH {TX_COHORTS} SELECT cohort_month, "
    + ", ".join(
        f'coalesce(round(max(CASE WHEN period_number = {p} THEN retention_pct END), 4), 0) AS "Month {p}"'
        for p in _PERIODS
    )
    + " FROM retention GROUP BY 1",
)
def cohort_matrix(spark, folder):
    retention = cohorts.cohort_retention(t.tx(spark, folder))
    return rounded(cohorts.cohort_matrix(retention, _PERIODS))


@query(
    "cohort_heatmap_view",
    f"""WITH {TX_COHORTS} SELECT cohort_month, period_number, round(nullif(retention_pct, 0), 4) AS retention_pct
    FROM retention WHERE period_number IN (SELECT DISTINCT period_number FROM retention ORDER BY 1 LIMIT 13)""",
)
def cohort_heatmap_view(spark, folder):
    return rounded(cohorts.cohort_heatmap(cohorts.cohort_retention(t.tx(spark, folder))))
