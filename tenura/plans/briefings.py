"""Briefing sections and the text functions behind them."""

from pyspark.sql import functions as F

from tenura import fixed_values as words
from tenura import workflows
from tenura.fixed_values import FEATURES
from tenura.functions import text
from tenura.operators import briefing as b
from tenura.operators import customers as cust
from tenura.operators import forecast as fc
from tenura.operators import explain, kpis, scoring, segments, survival
from tenura.plans import modelling, tables as t
from tenura.plans.analytics import MONTHS, TREND
from tenura.plans.customers import SPLIT, SURVIVAL, segments_sql
from tenura.plans.forecasts import HOLT
from tenura.plans.registry import query, sql_text
from tenura.session import store
from tenura.sources.tables import read_table

# --- Facts in SQL -------------------------------------------------------------------------------

FACTS = ",".join(
    [
        t.TX_CUSTOMERS,
        MONTHS,
        TREND,
        """
churned AS (
  SELECT count(*) FILTER (is_churned) AS n_churned, count(*) FILTER (NOT is_churned) AS n_active,
         count(*) AS n, count(*) FILTER (is_churned) * 1.0 / count(*) AS rate,
         avg(recency_days) AS recency, avg(frequency) AS frequency FROM feats),
facts AS (
  SELECT c.*, tr.*, k.revenue AS mrr, k.active AS subscribers, k.arpu,
         CAST(greatest(2, round_even(1 / nullif(rate, 0), 0)) AS BIGINT) AS n_in
  FROM churned c, trend tr, (SELECT * FROM kpis ORDER BY month DESC LIMIT 1) k)""",
    ]
)

_PARTS = dict(
    rate="format('{:.1f}%', rate * 100)",
    rate0="format('{:.0f}%', rate * 100)",
    n_in="CAST(n_in AS VARCHAR)",
    window="'90'",
    churned="format('{:,}', n_churned)",
    active="format('{:,}', n_active)",
    active_share="format('{:.1f}%', (1 - rate) * 100)",
    total="format('{:,}', n)",
)
_CHANGE = "CASE WHEN {before} > 0 THEN (recent_avg - {before}) / {before} ELSE 0 END"
_ARPU = "format('{:.2f}', arpu)"


def _facts(spark, folder, customers=None, *, with_forecast=False, **options):
    tx = t.tx(spark, folder)
    customers = t.stored_customers(spark, folder) if customers is None else customers
    monthly = store(kpis.monthly_kpis(tx))
    if with_forecast:
        series = fc.as_series(monthly)
        options["forecast"] = b.forecast_facts(series, fc.forecast_holt(series))
    return b.briefing_facts(
        snapshot=kpis.kpi_snapshot(tx, monthly),
        trend=kpis.revenue_trend(monthly),
        churn=cust.churn_summary(customers),
        behaviour=cust.rfm_summary(customers),
        **options,
    )


def _segments(customers, scores=None):
    return b.segment_counts(segments.segment_customers(customers, scores))


def _top_clv(customers):
    return survival.clv_quantile(survival.clv_per_customer(customers))


# --- Sections ----------------------------------------------------------------------------------------


def _health_sql() -> str:
    say = {k: sql_text(v, **_PARTS) for k, v in words.HEALTH_CHURN.items()}
    change = _CHANGE.format(before="prior_avg")
    told = {k: sql_text(v, pct=f"format('{{:.0f}}%', abs({change}) * 100)") for k, v in words.HEALTH_TREND.items()}
    base = sql_text(
        words.HEALTH_BASE, active="format('{:,}', subscribers)", mrr="format('{:,.0f}', mrr)", arpu=_ARPU
    )
    return f"""concat_ws(' ',
    CASE WHEN rate = 0 THEN {say['none']} WHEN rate < 0.05 THEN {say['strong']}
         WHEN rate < 0.12 THEN {say['acceptable']} WHEN rate < 0.20 THEN {say['room']}
         WHEN rate < 0.30 THEN {say['elevated']} ELSE {say['high']} END,
    {base},
    CASE WHEN n_months >= 6 THEN CASE WHEN {change} > 0.05 THEN {told['up']}
                                      WHEN {change} < -0.05 THEN {told['down']} ELSE {told['flat']} END
         WHEN n_months >= 2 THEN CASE WHEN last_value > first_value * 1.05 THEN {told['short_up']}
                                      WHEN last_value < first_value * 0.95 THEN {told['short_down']}
                                      ELSE {told['short_flat']} END END)"""


@query("brief_health", f"WITH {FACTS} SELECT {_health_sql()} AS health_summary FROM facts")
def brief_health(spark, folder):
    return _facts(spark, folder).select(b.health_summary().alias("health_summary"))


_CHURN_SQL = sql_text(
    words.CHURN_NO_MODEL,
    recency="format('{:.0f}', recency)",
    **{**_PARTS, "frequency": "format('{:.1f}', frequency)"},
)


@query("brief_churn", f"WITH {FACTS} SELECT {_CHURN_SQL} AS churn_analysis FROM facts")
def brief_churn(spark, folder):
    return _facts(spark, folder).select(b.churn_analysis(False).alias("churn_analysis"))


def _named(table: dict[str, str], key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN " + sql_text(v) for k, v in table.items()) + " END"


_MODEL_CHURN_SQL = " || ' ' || ".join(
    [
        sql_text(
            template, name=_named(words.FEATURE_NAMES, f), explanation=_named(words.FEATURE_EXPLANATIONS, f)
        )
        for template, f in ((words.CHURN_LEAD, "strongest[1]"), (words.CHURN_SECOND, "strongest[2]"))
    ]
    + [sql_text(words.CHURN_CONTEXT, **_PARTS)]
)


@query(
    "brief_churn_model",
    f"""WITH RECURSIVE {FACTS}, {SPLIT}, {modelling.LOGISTIC},
    coefficient_sizes AS (SELECT unnest([{", ".join(f"'{c}'" for c in FEATURES)}]) AS feature, abs(unnest(b[2:])) AS size FROM coefficients),
    by_size AS (SELECT list(feature ORDER BY size DESC, feature) AS strongest FROM coefficient_sizes)
    SELECT {_MODEL_CHURN_SQL} AS churn_analysis FROM facts, by_size""",
)
def brief_churn_model(spark, folder):
    """The section on churn with a model: the regression, whose scaled coefficients rank the features."""
    fitted, _, _ = modelling.logistic(spark, folder)
    sizes = [(f, abs(c)) for f, c in zip(fitted.features, fitted.coefficients.tolist())]
    order = sorted(sizes, key=lambda x: (-x[1], x[0]))
    ranks = spark.createDataFrame(
        [(f, size, i) for i, (f, size) in enumerate(order, 1)], "feature_name string, mean_abs_shap double, rank long"
    )
    facts = _facts(spark, folder, importance=b.top_two_features(ranks))
    return facts.select(b.churn_analysis(True).alias("churn_analysis"))


def _outlook_sql() -> str:
    change = _CHANGE.format(before="older_avg")
    told = {k: sql_text(v, pct=f"format('{{:.0f}}%', abs({change}) * 100)") for k, v in words.OUTLOOK_TREND.items()}
    return f"""CASE WHEN n_months < 4 THEN {told['short']} WHEN {change} > 0.05 THEN {told['up']}
    WHEN {change} < -0.05 THEN {told['down']} ELSE {told['flat']} END || ' ' || {sql_text(words.OUTLOOK_ARPU, arpu=_ARPU)}"""


@query("brief_revenue", f"WITH {FACTS} SELECT {_outlook_sql()} AS revenue_outlook FROM facts")
def brief_revenue(spark, folder):
    return _facts(spark, folder).select(b.revenue_outlook(False).alias("revenue_outlook"))


# The Holt query and the facts share the table of transactions and months.
HOLT_FACTS = HOLT + "," + t.CUSTOMERS + "," + FACTS.split(MONTHS + ",", 1)[1] + """,
ahead AS (
  SELECT max_by(value, h) FILTER (series_key = 'revenue') AS end_revenue,
         sum(value) FILTER (series_key = 'revenue') AS total_revenue,
         max_by(value, h) FILTER (series_key = 'subscribers') AS end_subscribers,
         (SELECT value FROM y WHERE series_key = 'revenue' ORDER BY i DESC LIMIT 1) AS start_revenue
  FROM holt_forecast)"""


def _way(value, base, outcomes):
    return f"""CASE WHEN {value} > {base} * 1.02 THEN {outcomes['up']}
    WHEN {value} < {base} * 0.98 THEN {outcomes['down']} ELSE {outcomes['flat']} END"""


def _outlook_forecast_sql() -> str:
    directions = {k: f"'{v}'" for k, v in words.OUTLOOK_DIRECTIONS.items()}
    revenue = sql_text(
        words.OUTLOOK_FORECAST,
        horizon="'12'",
        direction="(" + _way("end_revenue", "start_revenue", directions) + ")",
        end="format('{:,.0f}', end_revenue)",
        total="format('{:,.0f}', total_revenue)",
    )
    parts = dict(end="format('{:,.0f}', end_subscribers)", horizon="'12'", active="format('{:,}', subscribers)")
    sentences = {k: sql_text(v, **parts) for k, v in words.OUTLOOK_SUBSCRIBERS.items()}
    return f"{revenue} || ' ' || {_way('end_subscribers', 'subscribers', sentences)}"


@query(
    "brief_revenue_forecast",
    f"WITH RECURSIVE {HOLT_FACTS} SELECT {_outlook_forecast_sql()} AS revenue_outlook FROM facts, ahead",
)
def brief_revenue_forecast(spark, folder):
    facts = _facts(spark, folder, with_forecast=True)
    return facts.select(b.revenue_outlook(True).alias("revenue_outlook"))


SEGMENT_COUNTS = f"""{segments_sql('scored')},
sizes_of AS (SELECT segment, count(*) AS k, (SELECT count(*) FROM segmented) AS total FROM segmented GROUP BY 1)"""


def _segments_sql() -> str:
    lines = []
    for segment, template in words.SEGMENT_LINES.items():
        line = sql_text(template, n="format('{:,}', k)", share="format('{:.0f}%', k * 100.0 / total)")
        lines.append(f"(SELECT {line} FROM sizes_of WHERE segment = '{segment}')")
    intro = sql_text(words.SEGMENT_INTRO, total="format('{:,}', n)")
    return f"{intro} || concat_ws(chr(10) || chr(10), {', '.join(lines)})"


@query("brief_segments", f"WITH {FACTS}, {SEGMENT_COUNTS} SELECT {_segments_sql()} AS customer_segments FROM facts")
def brief_segments(spark, folder):
    customers = t.stored_customers(spark, folder)
    facts = _facts(spark, folder, customers, segments=_segments(customers))
    return facts.select(b.customer_segments(True).alias("customer_segments"))


@query(
    "brief_segments_none",
    f"WITH {FACTS} SELECT {sql_text(words.SEGMENT_NONE, **_PARTS)} AS customer_segments FROM facts",
)
def brief_segments_none(spark, folder):
    return _facts(spark, folder).select(b.customer_segments(False).alias("customer_segments"))


_SIZE = "coalesce((SELECT k FROM sizes_of WHERE segment = '{0}'), 0)"


def _recommend_sql(ml: bool) -> str:
    say = words.RECOMMEND_CHURN
    plans = words.RECOMMEND_FORECAST
    if not ml:
        told = {k: sql_text(v, **_PARTS) for k, v in say.items() if k in ("urgent", "score", "maintain")}
        first = f"CASE WHEN rate > 0.15 THEN {told['urgent']} WHEN rate > 0.05 THEN {told['score']} ELSE {told['maintain']} END"
        second = sql_text(words.RECOMMEND_NO_CLV, arpu=_ARPU)
        third = sql_text(plans["none"])
    else:
        at_risk, churned = _SIZE.format("At Risk"), _SIZE.format("Churned")
        shown = lambda n: f"format('{{:,}}', {n})"
        first = f"""CASE WHEN {at_risk} > 0 THEN {sql_text(say['at_risk'], at_risk=shown(at_risk))}
        WHEN {churned} > 0 THEN {sql_text(say['win_back'], churned=shown(churned))} ELSE {sql_text(say['monitor'])} END"""
        top = "(SELECT quantile_cont(CAST(expected_clv AS DOUBLE), 0.9) FROM clv)"
        second = sql_text(words.RECOMMEND_CLV, top_clv=f"format('{{:,.0f}}', {top})")
        alert = sql_text(plans["alert"], end="format('{:,.0f}', end_revenue)")
        third = f"CASE WHEN end_revenue < start_revenue * 0.95 THEN {alert} ELSE {sql_text(plans['sustain'])} END"
    return f"concat_ws(chr(10) || chr(10), {first}, {second}, {third})"


@query("brief_recommendations", f"WITH {FACTS} SELECT {_recommend_sql(False)} AS recommendations FROM facts")
def brief_recommendations(spark, folder):
    return _facts(spark, folder).select(b.recommendations(False, False, False).alias("recommendations"))


@query(
    "brief_recommendations_full",
    f"WITH RECURSIVE {HOLT_FACTS}, {SURVIVAL}, {SEGMENT_COUNTS} SELECT {_recommend_sql(True)} AS recommendations FROM facts, ahead",
)
def brief_recommendations_full(spark, folder):
    customers = t.stored_customers(spark, folder)
    facts = _facts(
        spark,
        folder,
        customers,
        segments=_segments(customers),
        top_clv=_top_clv(customers),
        with_forecast=True,
    )
    return facts.select(b.recommendations(True, True, True).alias("recommendations"))


def _confidence_sql() -> str:
    levels = lambda pick: "CASE " + " ".join(
        f"WHEN auc >= {low} THEN {sql_text(pick(name, why))}" for low, name, why in words.CONFIDENCE_LEVELS
    ) + " END"
    return sql_text(
        words.CONFIDENCE,
        auc="format('{:.3f}', auc)",
        label=levels(lambda name, why: name),
        detail=levels(lambda name, why: why),
        precision0="format('{:.0f}%', precision * 100)",
        precision="format('{:.3f}', precision)",
        n_train="format('{:,}', n)",
        n_test="format('{:,}', n)",
    )


@query(
    "brief_model_confidence",
    f"""WITH {modelling.TX_SCORED}, {modelling.METRICS}, area AS ({modelling._AUC}),
    m AS (SELECT auc, coalesce(tp * 1.0 / nullif(flagged, 0), 0) AS precision, n_test AS n FROM hits, area)
    SELECT {_confidence_sql()} AS model_confidence FROM m""",
)
def brief_model_confidence(spark, folder):
    """For the tenure score, judged on all customers."""
    scored = modelling._scored(spark, folder)
    metrics = (
        scoring.classification_metrics(scored)
        .withColumn("auc", scoring.auc_exact(scored).scalar())
        .withColumn("n_train", F.col("n_test"))
        .select(F.struct("*").alias("metrics"))
    )
    return metrics.select(b.model_confidence().alias("model_confidence"))


@query("brief_report")
def brief_report(spark, folder):
    """The whole briefing, by the library's own job, with the trained model: no SQL trains the forest."""
    tx = t.tx(spark, folder)
    fitted, split = modelling.trained(spark, folder)
    customers = t.stored_customers(spark, folder)
    scores = store(fitted.score(split).select("customer_id", "churn_probability"))
    shap = store(explain.shap_values(fitted, split.where("split = 'test'")))
    study = workflows.Study(
        customers=customers,
        split=split,
        model=fitted,
        metrics=modelling.evaluation(fitted, split),
        roc=None,
        importance=explain.shap_importance(shap, fitted.features),
        predictions=scores,
        clv=survival.clv_per_customer(customers),
        segments=segments.segment_customers(customers, scores),
    )
    return workflows.brief(tx, study=study, forecast=fc.forecast_holt(fc.series_input(tx)))


_STATUS_SQL = (
    "CASE WHEN "
    + " OR ".join(f"contains(lower(s), '{w}')" for w in words.HEALTH_BAD_WORDS)
    + " THEN 'error' WHEN "
    + " OR ".join(f"contains(lower(s), '{w}')" for w in words.HEALTH_WARN_WORDS)
    + " THEN 'warning' ELSE 'success' END"
)


@query(
    "brief_health_status",
    f"WITH {FACTS} SELECT {_STATUS_SQL} AS status FROM (SELECT {_health_sql()} AS s FROM facts)",
)
def brief_health_status(spark, folder):
    return _facts(spark, folder).select(b.health_status(b.health_summary()).alias("status"))


# --- Text functions on whole texts -----------------------------------------------------------------------


@query(
    "fn_strip_markdown",
    r"""SELECT doc_id, regexp_replace(regexp_replace(t, '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g') AS plain
    FROM (SELECT doc_id, '**' || source || '** is *' || lang || '*: ' || text AS t FROM documents)""",
)
def fn_strip_markdown(spark, folder):
    docs = read_table(spark, folder, "documents")
    marked = F.concat(
        F.lit("**"), "source", F.lit("** is *"), "lang", F.lit("*: "), "text"
    )
    return docs.select("doc_id", text.strip_markdown(marked).alias("plain"))


@query(
    "fn_latin1_safe",
    """SELECT doc_id, replace(translate(t, '—–•·‘’“”', '--**''''""'), '…', '...') AS plain
    FROM (SELECT doc_id, '“' || source || '” – ‘' || lang || '’ — • · … ' || text AS t FROM documents)""",
)
def fn_latin1_safe(spark, folder):
    docs = read_table(spark, folder, "documents")
    marked = F.concat(
        F.lit("“"), "source", F.lit("” – ‘"), "lang", F.lit("’ — • · … "), "text"
    )
    return docs.select("doc_id", text.latin1_safe(marked).alias("plain"))


@query(
    "fn_format_kpis",
    f"""WITH {t.TX} SELECT subscription_id, '$' || format('{{:,.0f}}', transaction_amount) AS dollars,
    '$' || format('{{:.2f}}', transaction_amount / 8) AS eighth, format('{{:,}}', CAST(subscription_id AS BIGINT)) AS number,
    format('{{:.1f}}%', transaction_amount / 1000000 * 100) AS share,
    format('{{:.0f}}%', transaction_amount / 1000000 * 100) AS share0,
    format('{{:.3f}}', transaction_amount / 1000000) AS ratio FROM tx""",
)
def fn_format_kpis(spark, folder):
    """Every amount in the formats the briefing uses, on numbers both engines share exactly."""
    amount = F.col("transaction_amount")
    dollars = lambda x: F.concat(F.lit("$"), x)
    return t.tx(spark, folder).select(
        "subscription_id",
        dollars(text.number(amount)).alias("dollars"),
        dollars(text.plain_number(amount / 8, 2)).alias("eighth"),
        text.count(F.col("subscription_id")).alias("number"),
        text.percent(amount / 1000000, 1).alias("share"),
        text.percent(amount / 1000000).alias("share0"),
        text.plain_number(amount / 1000000, 3).alias("ratio"),
    )
