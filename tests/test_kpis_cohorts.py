import pytest
from conftest import month_days

from tenura.errors import InsufficientDataError
from tenura.operators import cohorts, kpis


def two_months():
    return [(f"c{i}", d, a) for d, a in (("2024-01-10", 100.0), ("2024-02-10", 120.0)) for i in range(10)]


def test_two_months(make_tx):
    rows = kpis.monthly_kpis(make_tx(two_months())).orderBy("month").collect()
    assert [(r["month_str"], r["revenue"], r["active"], r["arpu"], r["churn_rate"]) for r in rows] == [
        ("2024-01", 1000.0, 10, 100.0, None),
        ("2024-02", 1200.0, 10, 120.0, 0.0),
    ]
    snap = kpis.kpi_snapshot(make_tx(two_months())).first()
    assert (snap["mrr"], snap["active_subscribers"], snap["total_revenue"], snap["avg_transaction_value"]) == (1200.0, 10, 2200.0, 110.0)


@pytest.mark.parametrize(
    "february, rate",
    [(["a", "b"], 50.0), (["x", "y"], 100.0), (["a", "b", "c", "d", "e"], 0.0)],
)
def test_churn_rate(make_tx, february, rate):
    rows = [(c, "2024-01-05", 1.0) for c in "abcd"] + [(c, "2024-02-05", 1.0) for c in february]
    found = kpis.monthly_churn_rate(make_tx(rows)).collect()
    assert [(r["month"].month, r["churn_rate"]) for r in found] == [(2, rate)]


def test_single_month_has_no_churn(make_tx):
    df = make_tx([("a", "2024-01-05", 1.0)])
    assert kpis.monthly_churn_rate(df).count() == 0
    assert kpis.kpi_snapshot(df).first()["monthly_churn_rate"] == 0.0


def test_unobserved_months_are_skipped(make_tx):
    df = make_tx([("a", "2024-01-05", 1.0), ("b", "2024-01-06", 1.0), ("a", "2024-06-05", 1.0)])
    assert [r["churn_rate"] for r in kpis.monthly_churn_rate(df).collect()] == [50.0]
    assert [(str(r["month"]), r["customer_id"]) for r in kpis.lapsed_customers(df).collect()] == [("2024-06-01", "b")]


def test_null_customers_and_amounts(make_tx):
    df = make_tx([(None, "2024-01-05", 5.0), ("a", "2024-01-05", None), ("a", None, 7.0)])
    row = kpis.monthly_kpis(df).first()
    assert (row["revenue"], row["active"], row["arpu"]) == (5.0, 1, 5.0)
    assert kpis.kpi_snapshot(df).first()["total_revenue"] == 12.0


def cohort_rows():
    rows = [(f"c{i}", "2024-01-03", 1.0) for i in range(50)]
    return rows + [(f"c{i}", "2024-02-03", 1.0) for i in range(25)] + [("late", "2024-02-04", 1.0)]


def test_cohort_retention(make_tx):
    found = cohorts.cohort_retention(make_tx(cohort_rows()), check=True).orderBy("period_number").collect()
    assert [(r["cohort_month"], r["period_number"], r["retention_pct"]) for r in found] == [("2024-01", 0, 100.0), ("2024-01", 1, 50.0)]
    matrix = cohorts.cohort_matrix(cohorts.cohort_retention(make_tx(cohort_rows()), min_customers=1))
    assert matrix.columns == ["cohort_month", "Month 0", "Month 1"]
    assert {tuple(r) for r in matrix.collect()} == {("2024-01", 100.0, 50.0), ("2024-02", 100.0, 0.0)}


def test_cohorts_too_small(make_tx):
    with pytest.raises(InsufficientDataError):
        cohorts.cohort_retention(make_tx([("a", "2024-01-01", 1.0), ("b", "2024-02-01", 1.0)]), check=True)


def test_trend(make_tx):
    days = month_days(8)
    df = make_tx([("a", d, float(i)) for i, d in enumerate(days)])
    row = kpis.revenue_trend(kpis.monthly_revenue(df)).first()
    assert (row["n_months"], row["recent_avg"], row["prior_avg"], row["older_avg"]) == (8, 6.0, 3.0, 2.0)
    short = kpis.revenue_trend(kpis.monthly_revenue(make_tx([("a", d, float(i + 1)) for i, d in enumerate(days[:2])]))).first()
    assert (short["older_avg"], short["first_value"], short["last_value"]) == (1.0, 1.0, 2.0)
