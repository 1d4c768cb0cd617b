"""Monthly series and their forecasts."""

import math

import pandas as pd
from pyspark.sql import functions as F

from tenura.operators import forecast as fc
from tenura.plans import tables as t
from tenura.plans.analytics import TX_MONTHS
from tenura.plans.registry import labelled, query, rounded
from tenura.session import store
from tenura.sources.tables import customer_dimensions

SERIES = TX_MONTHS + """,
series AS (
  SELECT 'revenue' AS series_key, month, revenue AS value FROM months
  UNION ALL SELECT 'subscribers', month, CAST(active AS DOUBLE) FROM months)"""


def _series(spark, folder):
    return fc.series_input(t.tx(spark, folder))


@query(
    "forecast_series_input",
    f"WITH {SERIES} SELECT series_key, strftime(month, '%Y-%m') AS month, round(value, 2) AS value FROM series",
)
def forecast_series_input(spark, folder):
    return labelled(rounded(_series(spark, folder), 2))


def _status_sql(source: str) -> str:
    return f"""
status AS (
  SELECT series_key, count(*) AS n_months, max(month) AS last_month,
         CASE WHEN count(*) >= 6 THEN 'ok' ELSE 'insufficient' END AS status FROM {source} GROUP BY 1)"""


@query(
    "forecast_min_history",
    f"""WITH {SERIES}, both_sources AS (
      SELECT 'orders ' || series_key AS series_key, month FROM series
      UNION ALL SELECT DISTINCT 'events ' || k, date_trunc('month', ts)
                FROM events, (SELECT unnest(['revenue', 'subscribers']) AS k)),
    {_status_sql('both_sources')}
    SELECT series_key, CAST(n_months AS BIGINT) AS n_months, strftime(last_month, '%Y-%m') AS last_month, status FROM status""",
)
def forecast_min_history(spark, folder):
    """Orders span years; events a single month, too short to forecast."""
    named = lambda source, df: df.withColumn("series_key", F.concat(F.lit(source + " "), "series_key"))
    both = named("orders", _series(spark, folder)).unionByName(
        named("events", fc.series_input(t.events(spark, folder)))
    )
    return labelled(fc.history_status(both), "last_month")


@query(
    "forecast_calendar",
    f"""WITH {SERIES}, {_status_sql('series')}
    SELECT series_key, CAST(h AS INTEGER) AS step, strftime(last_month + to_months(CAST(h AS INTEGER)), '%Y-%m') AS month
    FROM status, (SELECT unnest(range(1, 13)) AS h)""",
)
def forecast_calendar(spark, folder):
    return labelled(fc.forecast_calendar(fc.history_status(_series(spark, folder))))


@query(
    "forecast_intervals",
    f"""WITH {SERIES}, stats AS (
      SELECT series_key, avg(value) AS point, stddev_samp(value) AS spread, max(month) AS last_month FROM series GROUP BY 1)
    SELECT series_key, strftime(last_month + to_months(CAST(h AS INTEGER)), '%Y-%m') AS month, 'forecast' AS kind,
           round(greatest(point, 0), 2) AS value, round(greatest(point - 1.282 * spread * sqrt(h), 0), 2) AS lower,
           round(greatest(point, 0) + 1.282 * spread * sqrt(h), 2) AS upper, 'mean' AS backend
    FROM stats, (SELECT unnest(range(1, 13)) AS h)""",
)
def forecast_intervals(spark, folder):
    """Intervals around each series' mean, whose residuals SQL can compute too."""
    points = (
        _series(spark, folder)
        .groupBy("series_key")
        .agg(
            F.avg("value").alias("point"),
            F.stddev_samp("value").alias("spread"),
            F.max("month").alias("last_month"),
        )
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(12))))
    )
    return rounded(fc.with_intervals(points, "mean"), 2)


# Holt's recurrence month by month for every grid point: the data with a zero
# start (a) and the responses to a unit level (p) and a unit trend (q).
HOLT = SERIES + """,
y AS (SELECT series_key, month, value, row_number() OVER (PARTITION BY series_key ORDER BY month) AS i FROM series),
grid AS (SELECT x / 10.0::DOUBLE AS alpha, z / 10.0::DOUBLE AS beta
         FROM (SELECT unnest(range(1, 10)) AS x), (SELECT unnest(range(1, 10)) AS z)),
run AS (
  SELECT series_key, alpha, beta, 0::BIGINT AS i, 0::DOUBLE AS e, 0::DOUBLE AS p, 0::DOUBLE AS q,
         0::DOUBLE AS la, 0::DOUBLE AS ba, 1::DOUBLE AS lp, 0::DOUBLE AS bp, 0::DOUBLE AS lq, 1::DOUBLE AS bq
  FROM (SELECT DISTINCT series_key FROM y), grid
  UNION ALL
  SELECT series_key, alpha, beta, i, value - (la + ba), lp + bp, lq + bq,
         na, beta * (na - la) + (1 - beta) * ba,
         np, beta * (np - lp) + (1 - beta) * bp,
         nq, beta * (nq - lq) + (1 - beta) * bq
  FROM (SELECT r.series_key, alpha, beta, y.i, value, la, ba, lp, bp, lq, bq,
               alpha * value + (1 - alpha) * (la + ba) AS na,
               (1 - alpha) * (lp + bp) AS np, (1 - alpha) * (lq + bq) AS nq
        FROM run r JOIN y ON y.series_key = r.series_key AND y.i = r.i + 1)),
sums AS (
  SELECT series_key, alpha, beta, count(*) AS n, sum(e * e) AS ee, sum(e * p) AS ep, sum(e * q) AS eq,
         sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(e) AS e, sum(p) AS p, sum(q) AS q
  FROM run WHERE i > 0 GROUP BY 1, 2, 3),
starts AS (
  SELECT *, (ep * qq - eq * pq) / (pp * qq - pq * pq) AS l0, (eq * pp - ep * pq) / (pp * qq - pq * pq) AS b0 FROM sums),
errors AS (SELECT *, ee - l0 * ep - b0 * eq AS sse, e - l0 * p - b0 * q AS total FROM starts),
best AS (
  SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY round(sse, 6), alpha, beta) AS place FROM errors),
holt AS (
  SELECT b.series_key, b.n, b.alpha, b.beta, b.sse,
         la + l0 * lp + b0 * lq AS level, ba + l0 * bp + b0 * bq AS trend,
         sqrt((sse - total * total / n) / (n - 1)) AS spread,
         (SELECT max(month) FROM y WHERE y.series_key = b.series_key) AS last_month
  FROM best b JOIN run r ON r.series_key = b.series_key AND r.alpha = b.alpha AND r.beta = b.beta AND r.i = b.n
  WHERE place = 1),
holt_forecast AS (
  SELECT series_key, strftime(last_month + to_months(CAST(h AS INTEGER)), '%Y-%m') AS month, h,
         greatest(level + h * trend, 0) AS value,
         greatest(greatest(level + h * trend, 0) - 1.282 * spread * sqrt(h), 0) AS lower,
         greatest(level + h * trend, 0) + 1.282 * spread * sqrt(h) AS upper
  FROM holt, (SELECT unnest(range(1, 13)) AS h))"""


@query(
    "forecast_holt_fit",
    f"""WITH RECURSIVE {HOLT} SELECT series_key, CAST(n AS INTEGER) AS n, alpha, beta, round(level, 2) AS level,
    round(trend, 2) AS trend, round(spread, 2) AS spread FROM holt""",
)
def forecast_holt_fit(spark, folder):
    return rounded(fc.holt_grid(_series(spark, folder)).drop("last_month", "sse"), 2)


@query(
    "forecast_holt",
    f"""WITH RECURSIVE {HOLT} SELECT series_key, month, 'forecast' AS kind, round(value, 2) AS value,
    round(lower, 2) AS lower, round(upper, 2) AS upper, 'holt' AS backend FROM holt_forecast""",
)
def forecast_holt(spark, folder):
    return rounded(fc.forecast_holt(_series(spark, folder)), 2)


@query(
    "forecast_summary",
    f"""WITH RECURSIVE {HOLT} SELECT series_key, round(sum(value), 2) AS total, round(avg(value), 2) AS mean,
    round(max_by(value, h), 2) AS last_value, CAST(count(*) AS BIGINT) AS horizon FROM holt_forecast GROUP BY 1""",
)
def forecast_summary(spark, folder):
    return rounded(fc.forecast_summary(fc.forecast_holt(_series(spark, folder))), 2)


@query(
    "union_history_forecast",
    f"""WITH RECURSIVE {HOLT},
    past AS (SELECT series_key, strftime(month, '%Y-%m') AS month, round(value, 2) AS value, i FROM y)
    SELECT series_key, month, 'historical' AS kind, value, NULL AS lower, NULL AS upper, NULL AS backend FROM past
    UNION ALL SELECT series_key, month, 'anchor', value, value, value, NULL FROM past
              WHERE i = (SELECT max(i) FROM past z WHERE z.series_key = past.series_key)
    UNION ALL SELECT series_key, month, 'forecast', round(value, 2), round(lower, 2), round(upper, 2), 'holt' FROM holt_forecast""",
)
def union_history_forecast(spark, folder):
    series = store(_series(spark, folder))
    return rounded(fc.history_and_forecast(series, fc.forecast_holt(series)), 2)


# Smoothing with a season: start values from the first two years, then the recurrence month by month
# for every point of a grid that is refined twice around its best point. ``s`` begins with the season
# of the month that comes next.
def _seasonal(series: str) -> str:
    parts = [f"""
y2 AS (SELECT series_key, month, value, row_number() OVER (PARTITION BY series_key ORDER BY month) AS i FROM {series}),
size2 AS (
  SELECT series_key, count(*) AS n, max(month) AS last_month, 1 + sum(value * value) AS power,
         (avg(value) FILTER (i BETWEEN 13 AND 24) - avg(value) FILTER (i <= 12)) / 12 AS trend,
         avg(value) FILTER (i <= 12) AS mean
  FROM y2 GROUP BY 1 HAVING count(*) >= 24),
start2 AS (
  SELECT series_key, any_value(size2.mean - trend * 6.5) AS l, any_value(trend) AS b,
         list(value - (size2.mean - trend * 6.5) - trend * i ORDER BY i) AS s
  FROM y2 JOIN size2 USING (series_key) WHERE i <= 12 GROUP BY 1),
best0 AS (SELECT series_key, 0.5::DOUBLE AS alpha, 0.5::DOUBLE AS beta, 0.5::DOUBLE AS gamma FROM size2)"""]
    for r, (width, step) in enumerate(fc._ROUNDS, 1):
        moves = [round(-width + step * i, 10) for i in range(int(round(2 * width / step)) + 1)]
        held = lambda c, m: f"greatest(least(round({c} + {m}, 10), 0.99), 0.01)::DOUBLE AS {c}"
        parts.append(f"""
move{r} AS (SELECT unnest({moves}::DOUBLE[]) AS m),
grid{r} AS (
  SELECT DISTINCT series_key, {held("alpha", "a.m")}, {held("beta", "b.m")}, {held("gamma", "c.m")}
  FROM best{r - 1}, move{r} a, move{r} b, move{r} c),
run{r} AS (
  SELECT series_key, alpha, beta, gamma, 0::BIGINT AS i, l, b, s, 0::DOUBLE AS sse, 0::DOUBLE AS errors
  FROM grid{r} JOIN start2 USING (series_key)
  UNION ALL
  SELECT series_key, alpha, beta, gamma, i, l, beta * (l - before) + (1 - beta) * b,
         list_append(s[2:12], gamma * (value - carried) + (1 - gamma) * s[1]), sse + e * e, errors + e
  FROM (SELECT r.series_key, alpha, beta, gamma, y2.i, value, l AS before, b, s, sse, errors, l + b AS carried,
               value - (l + b) - s[1] AS e, alpha * (value - s[1]) + (1 - alpha) * (l + b) AS l
        FROM run{r} r JOIN y2 ON y2.series_key = r.series_key AND y2.i = r.i + 1)),
best{r} AS (
  SELECT * FROM (
    SELECT run{r}.*, n, last_month, row_number() OVER (
             PARTITION BY series_key ORDER BY round(sse / power, 12), alpha, beta, gamma) AS place
    FROM run{r} JOIN size2 USING (series_key) WHERE i = n) WHERE place = 1)""")
    last = f"best{len(fc._ROUNDS)}"
    parts.append(f"""
seasonal AS (
  SELECT series_key, n, alpha, beta, gamma, l, b, s, last_month,
         sqrt(greatest((sse - errors * errors / n) / (n - 1), 0)) AS spread FROM {last}),
seasonal_forecast AS (
  SELECT series_key, strftime(last_month + to_months(CAST(h AS INTEGER)), '%Y-%m') AS month, 'forecast' AS kind, value,
         greatest(value - 1.282 * spread * sqrt(h), 0) AS lower, value + 1.282 * spread * sqrt(h) AS upper
  FROM (SELECT *, greatest(l + h * b + s[(h - 1) % 12 + 1], 0) AS value
        FROM seasonal, (SELECT unnest(range(1, 13)) AS h)))""")
    return ",".join(parts)


_ROUNDED = "series_key, month, kind, round(value, 2) AS value, round(lower, 2) AS lower, round(upper, 2) AS upper"


@query(
    "forecast_holt_winters",
    f"WITH RECURSIVE {SERIES}, {_seasonal('series')} SELECT {_ROUNDED}, 'holt_winters' AS backend FROM seasonal_forecast",
)
def forecast_holt_winters(spark, folder):
    return rounded(fc.forecast(_series(spark, folder)), 2)


@query(
    "forecast_holt_winters_fit",
    f"""WITH RECURSIVE {SERIES}, {_seasonal('series')} SELECT series_key, CAST(n AS INTEGER) AS n, alpha, beta, gamma,
    round(l, 2) AS level, round(b, 2) AS trend, round(spread, 2) AS spread FROM seasonal""",
)
def forecast_holt_winters_fit(spark, folder):
    return rounded(fc.seasonal_grid(_series(spark, folder)).drop("last_month", "sse", "seasons"), 4).withColumns(
        {c: F.round(c, 2) for c in ("level", "trend", "spread")}
    )


PRODUCT_SERIES = t.TX_DIMENSIONS + """,
by_month AS (
  SELECT coalesce(product, '') AS product, date_trunc('month', transaction_date) AS month,
         sum(transaction_amount) AS revenue, CAST(count(DISTINCT customer_id) AS DOUBLE) AS active
  FROM tx GROUP BY ALL),
products AS (
  SELECT 'revenue|' || product AS series_key, month, revenue AS value FROM by_month
  UNION ALL SELECT 'subscribers|' || product, month, active FROM by_month)"""


@query(
    "forecast_by_product",
    f"WITH RECURSIVE {PRODUCT_SERIES}, {_seasonal('products')} SELECT {_ROUNDED}, 'holt_winters' AS backend FROM seasonal_forecast",
)
def forecast_by_product(spark, folder):
    """Two series per product, fitted in parallel."""
    products = customer_dimensions(spark, folder)
    return rounded(fc.forecast(fc.series_input(t.tx(spark, folder), "product", products)), 2)


# Ridge regression: design rows, sums of products, and elimination column by column.
_ANGLES = ", ".join(
    f"{f}((f + i) % 12 * {2 * math.pi / 12!r} * {k})" for k in range(1, fc._WAVES + 1) for f in ("sin", "cos")
)
REGRESSION = SERIES + f""",
sized AS (
  SELECT series_key, list(value ORDER BY month) AS y, count(*) AS n, max(month) AS last_month, month(min(month)) - 1 AS f,
         coalesce(nullif(max(abs(value)), 0), 1) AS scale, CAST(floor(count(*) * 0.8) AS INTEGER) - 1 AS most
  FROM series GROUP BY 1 HAVING count(*) >= 6),
bent AS (
  SELECT *, list_transform(range(1, least({fc._MAX_BENDS}, most) + 1),
                           lambda k: round_even(k * (most / least({fc._MAX_BENDS}, most)), 0) / (n - 1)) AS bends,
         list_transform(y, lambda v: v / scale) AS target FROM sized),
prior AS (
  SELECT series_key, greatest(var_pop(step) / 2, 1e-6) AS noise
  FROM (SELECT series_key, value / scale - lag(value / scale) OVER (PARTITION BY series_key ORDER BY month) AS step
        FROM series JOIN sized USING (series_key)) GROUP BY 1),
design AS (
  SELECT series_key, i, n, target[i + 1] AS target,
         [1.0::DOUBLE, i / (n - 1)] || list_transform(bends, lambda c: greatest(i / (n - 1) - c, 0))
         || CASE WHEN n >= 12 THEN [{_ANGLES}] ELSE [] END AS x, len(bends) AS bends
  FROM (SELECT *, unnest(range(0, n + 12)) AS i FROM bent)),
cells AS (SELECT series_key, i, target, bends, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS a FROM design WHERE i < n),
products AS (
  SELECT p.series_key, p.a, q.a AS b, sum(p.v * q.v) + CASE WHEN p.a = q.a THEN any_value(noise) /
           pow(CASE WHEN p.a <= 2 THEN {fc._PRIOR_TREND} WHEN p.a <= 2 + any_value(p.bends) THEN {fc._PRIOR_BEND}
                    ELSE {fc._PRIOR_WAVE} END, 2) ELSE 0 END AS s
  FROM cells p JOIN cells q ON p.series_key = q.series_key AND p.i = q.i JOIN prior ON prior.series_key = p.series_key
  GROUP BY p.series_key, p.a, q.a),
sides AS (SELECT series_key, a, sum(v * target) AS s FROM cells GROUP BY ALL),
lines AS (SELECT series_key, a, list(p.s ORDER BY b) || [any_value(sides.s)] AS r 
            FROM products p JOIN sides USING (series_key, a) GROUP BY series_key, a),
elimination AS (
  SELECT series_key, 1 AS p, list(r ORDER BY a) AS m FROM lines GROUP BY 1
  UNION ALL
  SELECT series_key, p + 1, list_transform(m, lambda r, i: CASE WHEN i = p THEN list_transform(r, lambda x: x / m[p][p])
    ELSE list_transform(r, lambda x, j: x - r[p] / m[p][p] * m[p][j]) END) FROM elimination WHERE p <= len(m)),
weights AS (SELECT series_key, list_transform(m, lambda r: r[len(r)]) AS w FROM elimination WHERE p = len(m) + 1),
estimates AS (
  SELECT series_key, i, design.n, y[i + 1] AS y, last_month,
         scale * list_sum(list_transform(x, lambda v, j: v * w[j])) AS estimate
  FROM design JOIN weights USING (series_key) JOIN bent USING (series_key)),
misses AS (SELECT series_key, stddev_samp(y - estimate) AS spread FROM estimates WHERE i < n GROUP BY 1)"""


@query(
    "forecast_seasonal_regression",
    f"""WITH RECURSIVE {REGRESSION}
    SELECT series_key, strftime(last_month + to_months(CAST(i - n + 1 AS INTEGER)), '%Y-%m') AS month, 'forecast' AS kind,
           round(greatest(estimate, 0), 2) AS value, round(greatest(estimate - 1.282 * spread, 0), 2) AS lower,
           round(estimate + 1.282 * spread, 2) AS upper, 'seasonal_regression' AS backend
    FROM estimates JOIN misses USING (series_key) WHERE i >= n""",
)
def forecast_seasonal_regression(spark, folder):
    return rounded(fc.forecast(_series(spark, folder), method="seasonal_regression"), 2)


@query(
    "forecast_backend_dispatch",
    f"""WITH RECURSIVE {HOLT}, {_seasonal('series')}
    SELECT {_ROUNDED}, 'holt_winters' AS backend FROM seasonal_forecast
    UNION ALL SELECT series_key, month, 'forecast', round(value, 2), round(lower, 2), round(upper, 2), 'holt' FROM holt_forecast""",
)
def forecast_backend_dispatch(spark, folder):
    """Both smoothing methods on the same series, by name."""
    series = store(_series(spark, folder))
    both = [fc.forecast(series, method=method) for method in ("holt_winters", "holt")]
    return rounded(both[0].unionByName(both[1]), 2)


def _mean_of_last_year(history, horizon):
    """A forecaster as a user would write it: the mean of the last twelve months."""
    last = history["value"].tail(12)
    return pd.DataFrame({"step": range(1, horizon + 1), "point": last.mean(), "spread": last.std()})


@query(
    "forecast_own_method",
    f"""WITH {SERIES}, {_status_sql('series')}, recent AS (
      SELECT series_key, avg(value) AS point, stddev_samp(value) AS spread, max(month) AS last_month
      FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY month DESC) AS back FROM series)
      WHERE back <= 12 GROUP BY 1)
    SELECT series_key, strftime(last_month + to_months(CAST(h AS INTEGER)), '%Y-%m') AS month, 'forecast' AS kind,
           round(greatest(point, 0), 2) AS value, round(greatest(point - 1.282 * spread * sqrt(h), 0), 2) AS lower,
           round(greatest(point, 0) + 1.282 * spread * sqrt(h), 2) AS upper, 'mean_of_last_year' AS backend
    FROM recent JOIN (SELECT series_key FROM status WHERE status = 'ok') USING (series_key), (SELECT unnest(range(1, 13)) AS h)""",
)
def forecast_own_method(spark, folder):
    """A registered function beside the built-in methods, with their intervals and calendar."""
    fc.register_forecaster("mean_of_last_year", _mean_of_last_year)
    return rounded(fc.forecast(_series(spark, folder), method="mean_of_last_year"), 2)
