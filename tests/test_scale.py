"""Skewed input, independence of partitioning, and the shape of plans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenura.operators import cohorts, customers, kpis, quality
from tenura.operators.ordering import exact_quantile, running_totals, with_next
from tenura.plans import ORACLES, QUERIES
from tenura.sources import events_as_transactions, orders_as_transactions

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all rows belong to one customer, half of those to one day."""
    rng = np.random.default_rng(11)
    n = 4000
    ids = np.where(rng.random(n) < 0.5, "hot", [f"c{i}" for i in rng.integers(0, 60, n)])
    seconds = rng.integers(0, 400 * 86400, n)
    burst = (ids == "hot") & (rng.random(n) < 0.5)
    seconds[burst] = 200 * 86400 + rng.integers(0, 86400, burst.sum())
    frame = pd.DataFrame(
        {
            "customer_id": ids,
            "transaction_date": pd.Timestamp("2023-01-01") + pd.to_timedelta(seconds, unit="s"),
            "transaction_amount": rng.integers(0, 50, n).astype(float),
        }
    )
    df = spark.createDataFrame(frame).withColumn("transaction_date", F.col("transaction_date").cast("timestamp_ntz"))
    return frame, df.repartition(6)


def test_features_of_hot_customer(skewed):
    frame, df = skewed
    ordered = frame.sort_values(["customer_id", "transaction_date"])
    gaps = ordered.groupby("customer_id")["transaction_date"].diff().dt.days
    spread = gaps.groupby(ordered["customer_id"]).std().fillna(0.0)
    grouped = frame.groupby("customer_id")
    days = (grouped["transaction_date"].max() - grouped["transaction_date"].min()).dt.days.clip(lower=1)
    last = (frame["transaction_date"].max() - grouped["transaction_date"].max()).dt.days
    found = customers.rfm_features(df).toPandas().set_index("customer_id").sort_index()
    assert (found["frequency"] == grouped.size()).all() and found["frequency"]["hot"] > 1800
    assert (found["tenure_days"] == days).all() and (found["recency_days"] == last).all()
    assert np.allclose(found["gap_std_days"], spread) and np.allclose(found["monetary_total"], grouped["transaction_amount"].sum())


def test_monthly_results_of_skewed_table(skewed):
    frame, df = skewed
    month = frame["transaction_date"].dt.to_period("M")
    active = frame.groupby(month)["customer_id"].agg(set).sort_index()
    lost = {str(active.index[i]): len(active.iloc[i - 1] - active.iloc[i]) / len(active.iloc[i - 1]) * 100 for i in range(1, len(active))}
    found = kpis.monthly_kpis(df).toPandas().set_index("month_str").sort_index()
    assert (found["active"] == active.map(len).to_numpy()).all()
    assert found["churn_rate"].dropna().to_dict() == pytest.approx(lost)
    lapsed = kpis.lapsed_customers(df).count()
    assert lapsed == sum(len(active.iloc[i - 1] - active.iloc[i]) for i in range(1, len(active)))
    firsts = month.groupby(frame["customer_id"]).min()
    pairs = pd.DataFrame({"c": frame["customer_id"], "m": month}).drop_duplicates()
    pairs["p"] = [(m - firsts[c]).n for c, m in zip(pairs["c"], pairs["m"])]
    expected = pairs.groupby([pairs["c"].map(firsts).astype(str), "p"]).size().to_dict()
    cells = cohorts.cohort_retention(df, min_customers=1).collect()
    assert {(r["cohort_month"], r["period_number"]): r["customers"] for r in cells} == expected


def test_duplicates_of_one_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 2000, "hot").otherwise(F.col("id").cast("string")).alias("customer_id"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("transaction_date"),
        F.lit(1.0).alias("transaction_amount"),
        F.col("id").alias("nr"),
    )
    kept = quality.dedup_transactions(df, "nr")
    assert kept.count() == 1001 and kept.where("customer_id = 'hot'").first()["nr"] == 0
    assert quality.finding_count(df, "duplicates").first()["affected_count"] == 1999


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.75, 0.8, 0.9, 1.0])
def test_quantile(spark, q):
    rng = np.random.default_rng(5)
    values = np.where(rng.random(900) < 0.35, 7.0, rng.normal(10, 5, 900).round(2))
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(5)
    found = exact_quantile(df, "x", q).first()["quantile"]
    assert found == pytest.approx(np.quantile(values, q), abs=1e-9)


def test_quantile_of_few_or_equal_values(spark):
    for values in ([5.0], [5.0, 5.0, 5.0], [1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        assert exact_quantile(df, "x", 0.8).first()[0] == pytest.approx(np.quantile(values, 0.8))
    empty = spark.createDataFrame([], "x double")
    assert exact_quantile(empty, "x", 0.5).first()[0] is None


def test_quantile_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(v,) for v in (1.0, nan, 3.0, None, inf, -inf, 2.0, inf)], "x double")
    expected = {0.0: -inf, 0.2: 1.0, 0.3: 1.5, 0.6: 3.0, 0.7: inf, 1.0: inf}
    for q, value in expected.items():
        assert exact_quantile(df, "x", q).first()[0] == pytest.approx(value)


def test_running_totals_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(v, 1) for v in (2.0, nan, None, inf, -inf)], "x double, w int")
    up = [str(r.x) for r in running_totals(df, "x", {"t": "w"}).orderBy("t").collect()]
    down = [str(r.x) for r in running_totals(df, "x", {"t": "w"}, descending=True).orderBy("t").collect()]
    assert up == ["None", "-inf", "2.0", "inf", "nan"] and down == up[::-1]
    ahead = {str(r.x): r.next_w for r in with_next(df.withColumn("w", F.col("x")), "x", ["w"]).collect()}
    assert [str(ahead[x]) for x in up] == ["-inf", "2.0", "inf", "nan", "None"]


def test_running_totals(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).cast("double").alias("x"), F.lit(2).alias("w"))
    for descending in (False, True):
        rows = running_totals(df, "x", {"total": "w"}, descending=descending).collect()
        assert len(rows) == 500
        for r in rows:
            assert r["total"] == 2 * ((500 - r["x"]) if descending else (r["x"] + 1))


def test_partitioning_does_not_matter(spark):
    tx = events_as_transactions(spark, SMALL)
    result = lambda df: sorted(
        (r["customer_id"], r["frequency"], r["tenure_days"], round(r["gap_std_days"], 9))
        for r in customers.rfm_features(df, min_customers=None).collect()
    )
    assert result(tx.coalesce(1)) == result(tx.repartition(8))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_python_only_where_announced(spark):
    tx = orders_as_transactions(spark, SMALL)
    for df in (kpis.monthly_kpis(tx), cohorts.cohort_retention(tx), customers.customer_table(tx)):
        assert "Python" not in plan(df) and "Pandas" not in plan(df)


def test_scans_read_needed_columns_only(spark):
    tx = orders_as_transactions(spark, SMALL)
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan(kpis.monthly_revenue(tx))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan(cohorts.customer_periods(tx))


def test_customer_table_shuffles_twice(spark):
    """Customer-days and customers; the third exchange is the one-row reference date."""
    text = plan(customers.customer_table(orders_as_transactions(spark, SMALL), min_customers=None))
    assert text.count("Exchange hashpartitioning") == 2
