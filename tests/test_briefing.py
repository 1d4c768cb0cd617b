import os

import pytest
from pyspark.sql import functions as F

from tenura import fixed_values as words
from tenura import workflows
from tenura.functions import text
from tenura.operators import briefing as b
from tenura.operators import forecast
from tenura.plans import QUERIES
from tenura.plans import tables as t


def facts(spark, rate=0.1, months=8, recent=100.0, prior=100.0, older=100.0, **extra):
    row = lambda **k: spark.range(1).select(*[F.lit(v).alias(c) for c, v in k.items()])
    n = 1000
    churned = round(n * rate)
    given = dict(
        snapshot=row(active_subscribers=1200, mrr=45678.9, arpu=38.07),
        trend=row(
            n_months=months, recent_avg=recent, prior_avg=prior, older_avg=older, first_value=100.0, last_value=recent
        ),
        churn=row(n_churned=churned, n_active=n - churned, churn_rate=rate),
        behaviour=row(avg_recency_days=33.6, avg_frequency=4.26),
    )
    return b.briefing_facts(**given, **{k: row(**v) for k, v in extra.items()})


@pytest.mark.parametrize(
    "rate, phrase, status",
    [
        (0.0, "No customers have lapsed in the last 90 days", "success"),
        (0.04, "only 4.0% of customers have gone inactive in the last 90 days — fewer than 1 in 25.", "success"),
        (0.1, "Churn sits at 10.0%", "success"),
        (0.15, "not alarming", "warning"),
        (0.25, "roughly 1 in 4 customers", "error"),
        (0.4, "Churn is high at 40.0% — more than 40% of customers", "error"),
    ],
)
def test_health_by_churn(spark, rate, phrase, status):
    row = facts(spark, rate).select(b.health_summary().alias("s")).withColumn("st", b.health_status(F.col("s"))).first()
    assert phrase in row["s"] and row["st"] == status
    assert "1,200 active subscribers generating $45,679 in monthly recurring revenue ($38.07 average" in row["s"]


@pytest.mark.parametrize(
    "months, recent, phrase",
    [
        (6, 110.0, "trended upward over recent months (+10%)"),
        (6, 80.0, "dipped 20%"),
        (6, 101.0, "broadly stable"),
        (3, 110.0, "shows an upward trend"),
        (3, 90.0, "shows a downward trend"),
        (3, 100.0, "remained relatively stable"),
    ],
)
def test_health_trend(spark, months, recent, phrase):
    assert phrase in facts(spark, months=months, recent=recent).select(b.health_summary()).first()[0]


def test_single_month_has_no_trend(spark):
    assert facts(spark, months=1).select(b.health_summary()).first()[0].endswith("average per customer).")


def test_churn_analysis(spark):
    plain = facts(spark).select(b.churn_analysis(False)).first()[0]
    assert "Of 1,000 customers analysed, 100 (10.0%)" in plain
    assert "recency is 34 days" in plain and "average of 4.3 times" in plain
    top = facts(spark, importance={"first": "recency_days", "second": "my_own_feature"})
    told = top.select(b.churn_analysis(True)).first()[0]
    assert "signal is **time since last purchase**. Customers who haven't" in told
    assert "predictor is **my own feature**." in told and "based on 90 days of inactivity" in told


@pytest.mark.parametrize("recent, phrase", [(120.0, "grown 20%"), (80.0, "declined 20%"), (100.0, "broadly stable")])
def test_outlook_without_forecast(spark, recent, phrase):
    assert phrase in facts(spark, recent=recent).select(b.revenue_outlook(False)).first()[0]


def test_outlook_short_history(spark):
    assert "Insufficient history" in facts(spark, months=3).select(b.revenue_outlook(False)).first()[0]


@pytest.mark.parametrize(
    "end, subs, phrases, advice",
    [
        (120.0, 1300.0, ("**grow**", "grow to 1,300 by month 12, up from 1,200"), "Sustain the trajectory"),
        (90.0, 1000.0, ("**decline**", "decline to 1,000"), "decline to $90/month"),
        (101.0, 1210.0, ("**remain stable**", "near current levels (1,210 at month 12)"), "Sustain"),
    ],
)
def test_outlook_with_forecast(spark, end, subs, phrases, advice):
    ahead = dict(start_revenue=100.0, end_revenue=end, total_revenue=1234.0, end_subscribers=subs, horizon=12)
    df = facts(spark, forecast=ahead)
    told = df.select(b.revenue_outlook(True)).first()[0]
    assert all(p in told for p in phrases) and "($1,234 total over the period)" in told
    assert advice in df.select(b.recommendations(False, False, True)).first()[0]


def counts(**given):
    return {"Churned": 0, "New": 0, "At Risk": 0, "High Value": 0, "Healthy": 0, **given}


def test_segments(spark):
    df = facts(spark, segments=counts(Churned=1500, Healthy=500) | {"total": 2000})
    told = df.select(b.customer_segments(True)).first()[0].split("\n\n")
    assert told[0] == "Customer base of 2,000 breaks down as follows:"
    assert told[1].startswith("- **1,500 Churned** (75%)") and told[2].startswith("- **500 Healthy** (25%)") and len(told) == 3
    none = facts(spark).select(b.customer_segments(False)).first()[0]
    assert "900 (90.0%) are active and 100 (10.0%) have lapsed" in none


@pytest.mark.parametrize(
    "segments, phrase",
    [({"At Risk": 12}, "Contact the 12 at-risk"), ({"Churned": 5}, "Reach out to 5 churned"), ({}, "No customers are currently")],
)
def test_recommendations_with_segments(spark, segments, phrase):
    df = facts(spark, segments=counts(**segments) | {"total": 100}, top_clv={"quantile": 2345.6})
    told = df.select(b.recommendations(True, True, False)).first()[0].split("\n\n")
    assert len(told) == 3 and phrase in told[0] and "$2,346+" in told[1] and told[2].startswith("**3.** **Generate")


@pytest.mark.parametrize("rate, phrase", [(0.2, "At 20.0%, churn"), (0.1, "from the 900 currently active"), (0.01, "Maintain momentum")])
def test_recommendations_by_churn(spark, rate, phrase):
    assert phrase in facts(spark, rate).select(b.recommendations(False, False, False)).first()[0]


@pytest.mark.parametrize("auc, label", [(0.95, "excellent"), (0.85, "strong"), (0.75, "good"), (0.65, "moderate"), (0.55, "limited")])
def test_confidence(spark, auc, label):
    df = facts(spark, metrics=dict(auc=auc, precision=0.625, n_train=1600, n_test=400))
    told = df.select(b.model_confidence()).first()[0]
    assert f"AUC of {auc:.3f}, indicating **{label}**" in told
    assert "approximately 62% of the time (precision: 0.625). Trained on 1,600 customers, tested on 400." in told


def test_report_sections_follow_the_facts(spark):
    row = b.briefing_report(facts(spark)).first()
    assert row["model_confidence"] is None and not row["sections_with_ml"] and row["client_type"] == "template"
    assert all(row[c] for c in ("health_summary", "churn_analysis", "revenue_outlook", "customer_segments", "recommendations"))
    ml = b.briefing_report(facts(spark, metrics=dict(auc=0.9, precision=0.5, n_train=1, n_test=1))).first()
    assert ml["sections_with_ml"] and "excellent" in ml["model_confidence"]


def test_text_functions(spark):
    df = spark.createDataFrame([("**bold** and *italic*", "5—ten • “it’s” · x…")], "a string, b string")
    row = df.select(text.strip_markdown(F.col("a")), text.latin1_safe(F.col("b"))).first()
    assert tuple(row) == ("bold and italic", "5-ten * \"it's\" * x...")


@pytest.mark.parametrize("value", [0.125, 0.375, 2.5, 1234567.895, 0.045, 99999.5])
def test_numbers_format_like_python(spark, value):
    x = F.lit(value)
    row = spark.range(1).select(text.number(x, 2), text.number(x), text.plain_number(x, 1), text.percent(x, 1)).first()
    assert tuple(row) == (f"{value:,.2f}", f"{value:,.0f}", f"{value:.1f}", f"{value:.1%}")


def test_an_empty_segment_table_reads_as_none(spark):
    empty = dict.fromkeys(("total", "New", "Healthy", "At Risk", "High Value", "Churned"), 0)
    said = lambda f, flag: f.select(b.customer_segments(flag).alias("s")).first()["s"]
    assert said(facts(spark, segments=empty), True) == said(facts(spark), False)


def test_briefing_of_transactions(spark, make_tx):
    rows = [(f"c{i}", f"2024-{m:02d}-0{1 + i % 9}", 10.0 + i) for i in range(60) for m in range(1, 9) if i % 4 or m < 3]
    tx = make_tx(rows)
    report = workflows.brief(tx).first()
    assert report["model_confidence"] is None and not report["sections_with_ml"]
    sections = ("health_summary", "churn_analysis", "revenue_outlook", "customer_segments", "recommendations")
    assert all(len(report[s]) > 40 for s in sections)
    ahead = workflows.brief(tx, forecast=forecast.forecast(forecast.series_input(tx), method="holt")).first()
    assert ahead["revenue_outlook"] != report["revenue_outlook"]


def test_report_query_says_what_its_parts_say(spark):
    """The sections of the whole report, put together from the figures of other queries."""
    folder = os.environ.get("TENURA_TEST_DATA", "/root/testdata/sf0.001")
    run = lambda name: QUERIES[name](spark, folder).toPandas()
    report = run("brief_report").iloc[0]
    assert report["health_summary"] == run("brief_health").iloc[0, 0]
    assert report["revenue_outlook"] == run("brief_revenue_forecast").iloc[0, 0]
    top = list(run("top_features").sort_values("rank")["feature_name"])
    for name in top[:2]:
        assert f"**{words.FEATURE_NAMES[name]}**" in report["churn_analysis"]
        assert words.FEATURE_EXPLANATIONS[name] in report["churn_analysis"]
    assert report["churn_analysis"].endswith(run("brief_churn_model").iloc[0, 0].split(". ")[-1])
    metrics = run("model_metrics").iloc[0]
    assert f"{metrics['auc']:.3f}" in report["model_confidence"] and f"tested on {int(metrics['n_test']):,}" in report["model_confidence"]
    scored = run("score_ensemble").set_index("customer_id")["churn_probability"]
    customers = t.customers(spark, folder).toPandas().set_index("customer_id")
    kept = customers[~customers["is_churned"] & (customers["tenure_days"] >= words.NEW_TENURE_DAYS)]
    at_risk = int((scored[kept.index] >= words.AT_RISK_PROBABILITY).sum())
    line = words.SEGMENT_LINES["At Risk"].split("{n}")[0]
    assert (f"{line}{at_risk:,}" in report["customer_segments"]) == (at_risk > 0)
    assert report["recommendations"] and report["client_type"] == "template" and report["sections_with_ml"]
