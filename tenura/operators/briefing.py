"""Written briefing from one-row results.

``briefing_facts`` gathers everything as structs in one row; each section is
a text expression over it. Sections without their optional input (segments,
CLV, forecast, model) fall back to wording that needs none.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura import fixed_values as words
from tenura.functions import text


def _one(df: DataFrame) -> Column:
    """A one-row table as a struct column."""
    return df.select(F.struct("*").alias("s")).scalar()


def segment_counts(segments: DataFrame) -> DataFrame:
    """One row with a column per segment and ``total``."""
    return segments.agg(
        *[F.count_if(F.col("segment") == s).alias(s) for s in words.SEGMENTS],
        F.count("*").alias("total"),
    )


def forecast_facts(history: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One row: start and end revenue, total, end subscribers, horizon.

    Takes series and forecasts keyed ``revenue`` and ``subscribers``.
    """
    mine = lambda key: F.col("series_key") == key
    value = lambda key: F.when(mine(key), F.col("value"))
    month = lambda key: F.when(mine(key), F.col("month"))
    start = history.agg(F.max_by(value("revenue"), month("revenue"))).scalar()
    return forecasts.agg(
        F.max_by(value("revenue"), month("revenue")).alias("end_revenue"),
        F.sum(value("revenue")).alias("total_revenue"),
        F.max_by(value("subscribers"), month("subscribers")).alias("end_subscribers"),
        F.count(value("revenue")).alias("horizon"),
    ).withColumn("start_revenue", start)


def top_two_features(importance: DataFrame) -> DataFrame:
    """One row ``(first, second)`` of an importance table."""
    nth = lambda n: F.max(F.when(F.col("rank") == n, F.col("feature_name")))
    return importance.agg(nth(1).alias("first"), nth(2).alias("second"))


def briefing_facts(
    *,
    snapshot: DataFrame,
    trend: DataFrame,
    churn: DataFrame,
    behaviour: DataFrame,
    window_days: int = 90,
    segments: DataFrame | None = None,
    top_clv: DataFrame | None = None,
    forecast: DataFrame | None = None,
    importance: DataFrame | None = None,
    metrics: DataFrame | None = None,
) -> DataFrame:
    """One row of facts from one-row tables.

    snapshot: kpi_snapshot · trend: revenue_trend · churn: churn_summary ·
    behaviour: rfm_summary · segments: segment_counts · top_clv:
    clv_quantile · forecast: forecast_facts · importance: top_two_features ·
    metrics: ``(auc, precision, n_train, n_test)``
    """
    given = {
        "snapshot": snapshot,
        "trend": trend,
        "behaviour": behaviour,
        "segments": segments,
        "top_clv": top_clv,
        "forecast": forecast,
        "importance": importance,
        "metrics": metrics,
    }
    base = churn.select(F.struct("*").alias("churn"), F.lit(window_days).alias("window"))
    return base.withColumns({k: _one(df) for k, df in given.items() if df is not None})


def _churn_parts() -> dict[str, Column]:
    rate = F.col("churn.churn_rate")
    total = F.col("churn.n_churned") + F.col("churn.n_active")
    return dict(
        rate=text.percent(rate, 1),
        rate0=text.percent(rate, 0),
        n_in=F.greatest(F.lit(2), F.bround(F.try_divide(F.lit(1.0), rate), 0).cast("long")).cast("string"),
        window=F.col("window").cast("string"),
        churned=text.count(F.col("churn.n_churned")),
        active=text.count(F.col("churn.n_active")),
        active_share=text.percent(1 - rate, 1),
        total=text.count(total),
    )


def health_summary() -> Column:
    rate = F.col("churn.churn_rate")
    parts = _churn_parts()
    say = lambda key: text.fill(words.HEALTH_CHURN[key], **parts)
    churn = (
        F.when(rate == 0, say("none"))
        .when(rate < 0.05, say("strong"))
        .when(rate < 0.12, say("acceptable"))
        .when(rate < 0.20, say("room"))
        .when(rate < 0.30, say("elevated"))
        .otherwise(say("high"))
    )
    base = text.fill(
        words.HEALTH_BASE,
        active=text.count(F.col("snapshot.active_subscribers")),
        mrr=text.number(F.col("snapshot.mrr")),
        arpu=text.plain_number(F.col("snapshot.arpu"), 2),
    )
    n = F.col("trend.n_months")
    change = _change(F.col("trend.recent_avg"), F.col("trend.prior_avg"))
    first, last = F.col("trend.first_value"), F.col("trend.last_value")
    told = lambda key: text.fill(words.HEALTH_TREND[key], pct=text.percent(F.abs(change)))
    trend = (
        F.when((n >= 6) & (change > 0.05), told("up"))
        .when((n >= 6) & (change < -0.05), told("down"))
        .when(n >= 6, told("flat"))
        .when((n >= 2) & (last > first * 1.05), told("short_up"))
        .when((n >= 2) & (last < first * 0.95), told("short_down"))
        .when(n >= 2, told("short_flat"))
    )
    return F.concat_ws(" ", churn, base, trend)


def _change(now: Column, before: Column) -> Column:
    return F.when(before > 0, (now - before) / before).otherwise(F.lit(0.0))


def _lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), default)


def feature_name(key: Column) -> Column:
    """A feature in words; unknown ones with blanks for underscores."""
    return _lookup(words.FEATURE_NAMES, key, F.replace(key, F.lit("_"), F.lit(" ")))


def feature_explanation(key: Column) -> Column:
    return _lookup(words.FEATURE_EXPLANATIONS, key, F.lit(""))


def churn_analysis(with_importance: bool) -> Column:
    parts = _churn_parts()
    if not with_importance:
        return text.fill(
            words.CHURN_NO_MODEL,
            recency=text.plain_number(F.col("behaviour.avg_recency_days")),
            frequency=text.plain_number(F.col("behaviour.avg_frequency"), 1),
            **parts,
        )
    first, second = F.col("importance.first"), F.col("importance.second")
    tell = lambda template, key: text.fill(
        template, name=feature_name(key), explanation=feature_explanation(key)
    )
    return F.concat_ws(
        " ",
        tell(words.CHURN_LEAD, first),
        tell(words.CHURN_SECOND, second),
        text.fill(words.CHURN_CONTEXT, **parts),
    )


def revenue_outlook(with_forecast: bool) -> Column:
    arpu = text.plain_number(F.col("snapshot.arpu"), 2)
    if not with_forecast:
        change = _change(F.col("trend.recent_avg"), F.col("trend.older_avg"))
        told = lambda key: text.fill(words.OUTLOOK_TREND[key], pct=text.percent(F.abs(change)))
        trend = (
            F.when(F.col("trend.n_months") < 4, told("short"))
            .when(change > 0.05, told("up"))
            .when(change < -0.05, told("down"))
            .otherwise(told("flat"))
        )
        return F.concat_ws(" ", trend, text.fill(words.OUTLOOK_ARPU, arpu=arpu))
    end, start = F.col("forecast.end_revenue"), F.col("forecast.start_revenue")
    subs, active = F.col("forecast.end_subscribers"), F.col("snapshot.active_subscribers")
    horizon = F.col("forecast.horizon").cast("string")
    direction = _three_way(end, start, 0.02, {k: F.lit(v) for k, v in words.OUTLOOK_DIRECTIONS.items()})
    revenue = text.fill(
        words.OUTLOOK_FORECAST,
        horizon=horizon,
        direction=direction,
        end=text.number(end),
        total=text.number(F.col("forecast.total_revenue")),
    )
    parts = dict(end=text.number(subs), horizon=horizon, active=text.count(active))
    sentences = {k: text.fill(v, **parts) for k, v in words.OUTLOOK_SUBSCRIBERS.items()}
    return F.concat_ws(" ", revenue, _three_way(subs, active, 0.02, sentences))


def _three_way(value: Column, base: Column, margin: float, outcomes: dict[str, Column]) -> Column:
    return (
        F.when(value > base * (1 + margin), outcomes["up"])
        .when(value < base * (1 - margin), outcomes["down"])
        .otherwise(outcomes["flat"])
    )


def customer_segments(with_segments: bool) -> Column:
    none = text.fill(words.SEGMENT_NONE, **_churn_parts())
    if not with_segments:
        return none
    total = F.col("segments.total")
    lines = []
    for segment, template in words.SEGMENT_LINES.items():
        n = F.col("segments")[segment]
        line = text.fill(template, n=text.count(n), share=text.percent(n / total))
        lines.append(F.when(n > 0, line))
    intro = text.fill(words.SEGMENT_INTRO, total=text.count(total))
    return F.when(total > 0, F.concat(intro, F.concat_ws("\n\n", *lines))).otherwise(none)


def recommendations(with_segments: bool, with_clv: bool, with_forecast: bool) -> Column:
    say = words.RECOMMEND_CHURN
    parts = _churn_parts()
    if with_segments:
        at_risk, churned = F.col("segments")["At Risk"], F.col("segments")["Churned"]
        first = (
            F.when(at_risk > 0, text.fill(say["at_risk"], at_risk=text.count(at_risk)))
            .when(churned > 0, text.fill(say["win_back"], churned=text.count(churned)))
            .otherwise(F.lit(say["monitor"]))
        )
    else:
        rate = F.col("churn.churn_rate")
        first = (
            F.when(rate > 0.15, text.fill(say["urgent"], **parts))
            .when(rate > 0.05, text.fill(say["score"], **parts))
            .otherwise(F.lit(say["maintain"]))
        )
    if with_clv:
        second = text.fill(words.RECOMMEND_CLV, top_clv=text.number(F.col("top_clv.quantile")))
    else:
        second = text.fill(
            words.RECOMMEND_NO_CLV, arpu=text.plain_number(F.col("snapshot.arpu"), 2)
        )
    plans = words.RECOMMEND_FORECAST
    if with_forecast:
        end = F.col("forecast.end_revenue")
        third = F.when(
            end < F.col("forecast.start_revenue") * 0.95, text.fill(plans["alert"], end=text.number(end))
        ).otherwise(F.lit(plans["sustain"]))
    else:
        third = F.lit(plans["none"])
    return F.concat_ws("\n\n", first, second, third)


def model_confidence() -> Column:
    auc, precision = F.col("metrics.auc"), F.col("metrics.precision")
    label = detail = None
    for lowest, name, explanation in words.CONFIDENCE_LEVELS:
        reached = auc >= lowest
        label = F.when(reached, F.lit(name)) if label is None else label.when(reached, F.lit(name))
        detail = (
            F.when(reached, F.lit(explanation))
            if detail is None
            else detail.when(reached, F.lit(explanation))
        )
    return text.fill(
        words.CONFIDENCE,
        auc=text.plain_number(auc, 3),
        label=label,
        detail=detail,
        precision0=text.percent(precision),
        precision=text.plain_number(precision, 3),
        n_train=text.count(F.col("metrics.n_train")),
        n_test=text.count(F.col("metrics.n_test")),
    )


def health_status(summary: Column) -> Column:
    """``error``, ``warning`` or ``success`` by the wording of the summary; bad words win."""
    lower = F.lower(summary)
    contains = lambda options: reduce(or_, [lower.contains(w) for w in options])
    return (
        F.when(contains(words.HEALTH_BAD_WORDS), F.lit("error"))
        .when(contains(words.HEALTH_WARN_WORDS), F.lit("warning"))
        .otherwise(F.lit("success"))
    )


def briefing_report(facts: DataFrame) -> DataFrame:
    """All sections in one row; sections follow from which facts were given."""
    has = set(facts.columns)
    confidence = model_confidence() if "metrics" in has else F.lit(None).cast("string")
    return facts.select(
        health_summary().alias("health_summary"),
        churn_analysis("importance" in has).alias("churn_analysis"),
        revenue_outlook("forecast" in has).alias("revenue_outlook"),
        customer_segments("segments" in has).alias("customer_segments"),
        recommendations("segments" in has, "top_clv" in has, "forecast" in has).alias("recommendations"),
        confidence.alias("model_confidence"),
        F.lit("template").alias("client_type"),
        F.lit("metrics" in has).alias("sections_with_ml"),
    )
