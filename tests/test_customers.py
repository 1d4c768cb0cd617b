import pytest

from tenura.errors import InsufficientDataError, LeakageError
from tenura.operators import customers as cust
from tenura.operators import segments, survival


def core(extra=()):
    rows = [("c1", "2024-01-01", 100.0), ("c1", "2024-02-01", 150.0), ("c2", "2024-03-15", 10.0)]
    return rows + [(f"f{i}", "2024-02-10", 20.0) for i in range(48)] + list(extra)


def one(df, customer="c1"):
    return df.where(f"customer_id = '{customer}'").first()


def test_features(make_tx):
    row = one(cust.rfm_features(make_tx(core())))
    assert (row["frequency"], row["monetary_total"], row["aov"], row["tenure_days"]) == (2, 250.0, 125.0, 31)
    assert row["recency_days"] == 43
    assert row["tx_per_month"] == pytest.approx(2 / (31 / 30.44))
    assert row["gap_std_days"] == 0.0
    single = one(cust.rfm_features(make_tx(core())), "f0")
    assert (single["tenure_days"], single["gap_std_days"], single["tx_per_month"]) == (1, 0.0, 1.0)


def test_whole_days_not_midnights(make_tx):
    times = ["2024-01-01 23:00:00", "2024-01-02 01:00:00", "2024-01-02 02:00:00", "2024-01-04 01:30:00"]
    df = make_tx([("a", t, 1.0) for t in times])
    gaps = {r["gap_days"]: r["n"] for r in cust.tx_gaps(df).collect()}
    assert gaps == {0: 2, 1: 1}
    row = one(cust.rfm_features(df, min_customers=None), "a")
    assert row["tenure_days"] == 2
    assert row["gap_std_days"] == pytest.approx((1 / 3) ** 0.5)


def test_reference_before_last_date_floors(make_tx):
    labels = cust.churn_labels(make_tx([("a", "2024-01-02 12:00:00", 1.0)]), reference="2024-01-02 00:00:00")
    assert labels.first()["days_since_last_tx"] == -1


def test_reference_includes_rows_without_customer(make_tx):
    df = make_tx(core([(None, "2024-04-15", 1.0)]))
    row = one(cust.rfm_features(df))
    assert row["recency_days"] == 74
    assert cust.rfm_features(df).where("customer_id IS NULL").count() == 0


def test_customer_without_dates_is_active(make_tx):
    row = one(cust.customer_table(make_tx(core([("x", None, 5.0)]))), "x")
    assert (row["is_churned"], row["recency_days"], row["frequency"], row["monetary_total"]) == (False, None, 0, 5.0)


@pytest.mark.parametrize("rows", [[], [("c1", "2024-01-01", 1.0)], core()[:40]])
def test_too_few_customers(make_tx, rows):
    with pytest.raises(InsufficientDataError):
        cust.rfm_features(make_tx(rows))


def test_label_boundary(make_tx):
    df = make_tx([("a", "2024-01-01", 1.0), ("b", "2023-12-31", 1.0)])
    labels = cust.churn_labels(df, churn_window_days=91, reference="2024-04-01")
    assert {r["customer_id"]: r["is_churned"] for r in labels.collect()} == {"a": False, "b": True}
    summary = cust.churn_summary(labels).first()
    assert (summary["n_churned"], summary["n_active"], summary["churn_rate"]) == (1, 1, 0.5)


def joined(spark, days):
    rows = [(f"c{i}", d) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "customer_id string, d string")
    return df.selectExpr("customer_id", "cast(d as timestamp_ntz) AS first_tx_date", "0 AS is_churned")


def test_split_80_20(spark):
    df = spark.range(100).selectExpr(
        "cast(id as string) AS customer_id",
        "cast(timestamp'2023-01-01' + make_dt_interval(cast(id * 3 as int)) as timestamp_ntz) AS first_tx_date",
    )
    split = cust.assert_split(cust.temporal_split(df))
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 80, "test": 20}


def test_split_edge_cases(spark):
    two = cust.temporal_split(joined(spark, ["2024-01-01", "2024-01-02"])).orderBy("customer_id").collect()
    assert [r["split"] for r in two] == ["train", "test"]
    with pytest.raises(InsufficientDataError):
        cust.temporal_split(joined(spark, ["2024-01-01"]))
    with pytest.raises(LeakageError):
        cust.temporal_split(joined(spark, ["2024-01-01"] * 10))
    all_train = cust.temporal_split(joined(spark, ["2024-01-01", "2024-01-02", "2024-01-03"]), train_ratio=1.0)
    assert {r["customer_id"]: r["split"] for r in all_train.collect()} == {"c0": "train", "c1": "train", "c2": "test"}


def people(spark, rows):
    return spark.createDataFrame(
        rows,
        "customer_id string, tenure_days long, is_churned boolean, aov double, tx_per_month double, "
        "monetary_total double, recency_days long",
    )


def test_clv_uses_twice_mean_tenure_without_median(spark):
    rows = [(f"c{i}", 180, i < 3, 50.0, 1.0, 1.0, 1) for i in range(10)]
    customers = people(spark, rows)
    assert survival.km_median(customers).first()[0] == 360.0
    clv = {r["customer_id"]: r for r in survival.clv_per_customer(customers).collect()}
    assert clv["c5"]["expected_remaining_months"] == round(180 / 30.44, 1)
    assert clv["c5"]["expected_clv"] == round(50 * 180 / 30.44, 2)
    with pytest.raises(InsufficientDataError):
        survival.clv_per_customer(people(spark, rows[:9]))


def test_customers_without_a_date_have_no_lifetime(spark):
    rows = [(f"c{i}", 180, i < 6, 50.0, 1.0, 1.0, 1) for i in range(10)] + [("none", None, None, None, None, None, None)]
    customers = people(spark, rows)
    assert survival.survival_at_risk(customers).agg({"at_risk": "max"}).first()[0] == 10
    found = {r["customer_id"]: r for r in survival.clv_per_customer(customers).collect()}
    assert found["none"]["expected_remaining_months"] is None and found["none"]["expected_clv"] is None
    assert found["c9"]["expected_remaining_months"] is not None


def test_median_and_floors(spark):
    rows = [(f"c{i}", 10 * (i + 1), i < 10, 10.0, 1.0, 1.0, 1) for i in range(12)]
    customers = people(spark, rows)
    curve = {r["timeline_days"]: r["survival_prob"] for r in survival.km_curve(customers).collect()}
    assert curve[0] == 1.0 and curve[10] == pytest.approx(11 / 12) and len(curve) == 13
    assert survival.km_median(customers).first()[0] == 60.0
    clv = {r["customer_id"]: r["expected_remaining_months"] for r in survival.clv_per_customer(customers).collect()}
    assert clv["c8"] == 0.0 and clv["c11"] == round(30 / 30.44, 1)


def test_segments(spark):
    rows = [(f"c{i}", 365, i == 0, 1.0, 1.0, 100.0 * (i + 1), 1) for i in range(50)]
    rows[1] = ("c1", 20, False, 1.0, 1.0, 9999.0, 1)
    customers = people(spark, rows)
    scores = spark.createDataFrame([(f"c{i}", 0.95 if i == 2 else 0.1) for i in range(40)], "customer_id string, churn_probability double")
    found = {r["customer_id"]: r["segment"] for r in segments.segment_customers(customers, scores).collect()}
    assert (found["c0"], found["c1"], found["c2"], found["c49"], found["c10"]) == ("Churned", "New", "At Risk", "High Value", "Healthy")
    missing = segments.with_scores(customers, scores).where("customer_id = 'c45'").first()
    assert missing["churn_probability"] == 0.5
    distribution = segments.segment_distribution(segments.segment_customers(customers, scores)).collect()
    assert sum(r["customers"] for r in distribution) == 50
