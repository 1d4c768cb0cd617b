import datetime
import itertools

import numpy as np
import pandas as pd
import pytest
from conftest import month_days

from tenura.errors import InsufficientDataError
from tenura.operators import forecast as fc


def series(spark, n, key="s", value=lambda i: 1000 + 10 * i + 20 * (i * i % 7)):
    rows = [(key, datetime.date.fromisoformat(d), float(value(i))) for i, d in enumerate(month_days(n))]
    return spark.createDataFrame(rows, "series_key string, month date, value double")


@pytest.mark.parametrize("method", fc.METHODS)
@pytest.mark.parametrize("n", [6, 12, 18, 30])
def test_shape_and_bands(spark, method, n):
    rows = fc.forecast(series(spark, n), 6, method).orderBy("month").collect()
    assert len(rows) == 6
    widths = [r["upper"] - r["value"] for r in rows]
    for r in rows:
        assert r["value"] >= 0 and 0 <= r["lower"] <= r["value"] <= r["upper"]
    if method != "seasonal_regression":
        assert widths == sorted(widths) and widths[0] < widths[-1]


def test_calendar_follows_last_month(spark):
    months = [r["month"] for r in fc.forecast(series(spark, 12), 12).orderBy("month").collect()]
    assert months[0] == "2024-01" and months[-1] == "2024-12"
    calendar = fc.forecast_calendar(fc.history_status(series(spark, 12)), 3).collect()
    assert [(r["step"], str(r["month"])) for r in calendar] == [(1, "2024-01-01"), (2, "2024-02-01"), (3, "2024-03-01")]


def test_short_series_do_not_stop_the_others(spark):
    both = series(spark, 12, "long").unionByName(series(spark, 3, "short"))
    assert {r["series_key"] for r in fc.forecast(both).collect()} == {"long"}
    status = {r["series_key"]: r["status"] for r in fc.history_status(both).collect()}
    assert status == {"long": "ok", "short": "insufficient"}
    with pytest.raises(InsufficientDataError):
        fc.require_history(both)


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        fc.forecast(series(spark, 12), method="magic")


def test_recovers_trend_and_season(spark):
    wave = lambda i: 500 + 5 * i + 50 * np.sin(2 * np.pi * i / 12)
    for method, tolerance in (("holt_winters", 1e-3), ("seasonal_regression", 40)):
        rows = fc.forecast(series(spark, 48, value=wave), 12, method).orderBy("month").collect()
        assert np.abs([r["value"] - wave(48 + i) for i, r in enumerate(rows)]).max() < tolerance


def test_falling_series_stop_at_zero(spark):
    rows = fc.forecast_holt(series(spark, 12, value=lambda i: 120 - 10 * i)).collect()
    assert min(r["value"] for r in rows) == 0.0 and min(r["lower"] for r in rows) == 0.0


def holt_by_hand(y, alpha, beta, level, trend):
    """Residuals of the recurrence from a start."""
    out = []
    for seen in y:
        carried = level + trend
        out.append(seen - carried)
        new = alpha * seen + (1 - alpha) * carried
        trend = beta * (new - level) + (1 - beta) * trend
        level = new
    return np.array(out)


def test_trend_grid_is_the_best_of_all_points(spark):
    """Residuals are linear in the start, so least squares over unit starts gives each point's optimum."""
    rng = np.random.default_rng(2)
    noise = rng.normal(0, 20, 18)
    df = series(spark, 18, value=lambda i: 300 + 4 * i + noise[i])
    found = fc.holt_grid(df).first()
    y = np.array([r["value"] for r in df.orderBy("month").collect()])
    best = {}
    for a, b in ((a / 10, b / 10) for a in range(1, 10) for b in range(1, 10)):
        zero = holt_by_hand(y, a, b, 0, 0)
        basis = np.column_stack([zero - holt_by_hand(y, a, b, *start) for start in ((1, 0), (0, 1))])
        best[a, b] = float(((zero - basis @ np.linalg.lstsq(basis, zero, rcond=None)[0]) ** 2).sum())
    point = min(best, key=best.get)
    assert found["sse"] == pytest.approx(best[point], rel=1e-9)
    assert (found["alpha"], found["beta"]) == point


def seasonal_by_hand(y, alpha, beta, gamma):
    """Final state and residuals of additive smoothing from the first two years' start values."""
    trend = (np.mean(y[12:24]) - np.mean(y[:12])) / 12
    level = np.mean(y[:12]) - 6.5 * trend
    seasons = [y[i] - level - trend * (i + 1) for i in range(12)]
    errors = []
    for t, seen in enumerate(y):
        carried, season = level + trend, seasons[t % 12]
        errors.append(seen - carried - season)
        new = alpha * (seen - season) + (1 - alpha) * carried
        seasons[t % 12] = gamma * (seen - carried) + (1 - gamma) * season
        level, trend = new, beta * (new - level) + (1 - beta) * trend
    return level, trend, seasons, np.array(errors)


def seasonal_search(y):
    best = (0.5, 0.5, 0.5)
    for width, count in ((0.4, 5), (0.1, 5), (0.025, 5)):
        moves = np.linspace(-width, width, count)
        axes = [sorted({round(min(max(round(c + m, 10), 0.01), 0.99), 10) for m in moves}) for c in best]
        sse = lambda p: (seasonal_by_hand(y, *p)[3] ** 2).sum() / (1 + (y**2).sum())
        best = min(itertools.product(*axes), key=lambda p: (round(sse(p), 12), p))  # the second year alone says nothing of gamma
    return best


@pytest.mark.parametrize("n", [24, 31, 60])
def test_seasonal_grid_against_plain_python(spark, n):
    rng = np.random.default_rng(n)
    noise = rng.normal(0, 30, n)
    df = series(spark, n, value=lambda i: 800 + 6 * i + 90 * np.cos(i * np.pi / 6) + noise[i])
    y = np.array([r["value"] for r in df.orderBy("month").collect()])
    found = fc.seasonal_grid(df).first()
    assert (found["alpha"], found["beta"], found["gamma"]) == pytest.approx(seasonal_search(y), abs=1e-9)
    level, trend, seasons, errors = seasonal_by_hand(y, found["alpha"], found["beta"], found["gamma"])
    assert (found["level"], found["trend"]) == pytest.approx((level, trend))
    assert found["seasons"] == pytest.approx([seasons[(n + h) % 12] for h in range(12)])
    assert found["spread"] == pytest.approx(errors.std(ddof=1))
    points = [r["value"] for r in fc.forecast(df, 14).orderBy("month").collect()]
    assert points == pytest.approx([level + h * trend + seasons[(n + h - 1) % 12] for h in range(1, 15)])


def ridge_by_hand(y, first, horizon):
    n = len(y)
    scale = np.abs(y).max() or 1.0
    t = np.arange(n + horizon) / (n - 1)
    last = int(np.floor(n * 0.8)) - 1
    count = min(25, last)
    bends = t[np.rint(np.arange(1, count + 1) * (last / count)).astype(int)]
    columns = [np.ones_like(t), t, *[np.maximum(t - c, 0) for c in bends]]
    prior = [5.0, 5.0] + [0.05] * count
    if n >= 12:
        angle = 2 * np.pi * ((first + np.arange(n + horizon)) % 12) / 12
        columns += [f(k * angle) for k in range(1, 6) for f in (np.sin, np.cos)]
        prior += [10.0] * 10
    x, target = np.column_stack(columns), y / scale
    noise = max(np.var(np.diff(target)) / 2, 1e-6)
    weights = np.linalg.solve(x[:n].T @ x[:n] + np.diag(noise / np.array(prior) ** 2), x[:n].T @ target)
    estimate = x @ weights * scale
    return estimate[n:], np.std(y - estimate[:n], ddof=1), weights


@pytest.mark.parametrize("n, start", [(6, 1), (11, 4), (12, 1), (40, 7)])
def test_regression_against_numpy(spark, n, start):
    rng = np.random.default_rng(n)
    y = 400 + 3 * np.arange(n) + 40 * np.sin(np.arange(n) / 2) + rng.normal(0, 9, n)
    rows = [("s", datetime.date.fromisoformat(d), float(v)) for d, v in zip(month_days(n, (2021, start)), y)]
    found = fc.seasonal_regression(spark.createDataFrame(rows, "series_key string, month date, value double"), 9).first()
    estimates, spread, weights = ridge_by_hand(y, start - 1, 9)
    assert found["estimates"] == pytest.approx(list(estimates), rel=1e-7)
    assert found["spread"] == pytest.approx(spread, rel=1e-7)
    assert found["weights"] == pytest.approx(list(weights), rel=1e-6, abs=1e-9)


def test_constant_and_zero_series(spark):
    both = series(spark, 30, "same", lambda i: 7).unionByName(series(spark, 30, "zero", lambda i: 0))
    for method in fc.METHODS:
        rows = fc.forecast(both, 3, method).collect()
        assert sorted((r["series_key"], round(r["value"], 4)) for r in rows) == [("same", 7)] * 3 + [("zero", 0)] * 3


def test_no_python_in_built_in_methods(spark):
    for method in fc.METHODS:
        plan = fc.forecast(series(spark, 30), 3, method)._jdf.queryExecution().toString()
        assert "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_a_forecaster_of_ones_own(spark):
    def drift(history, horizon):
        slope = (history["value"].iloc[-1] - history["value"].iloc[0]) / (len(history) - 1)
        steps = np.arange(1, horizon + 1)
        return pd.DataFrame({"step": steps, "point": history["value"].iloc[-1] + slope * steps, "spread": 2.0})

    fc.register_forecaster("drift", drift)
    both = series(spark, 12, "long", lambda i: 10 * i).unionByName(series(spark, 3, "short"))
    rows = fc.forecast(both, 4, "drift").orderBy("month").collect()
    built_in = fc.forecast(both, 4, "holt").orderBy("month").collect()
    assert [(r["series_key"], r["month"], r["kind"]) for r in rows] == [(r["series_key"], r["month"], r["kind"]) for r in built_in]
    assert [r["value"] for r in rows] == pytest.approx([120, 130, 140, 150])
    assert [r["upper"] - r["value"] for r in rows] == pytest.approx([2.0 * 1.282 * np.sqrt(h) for h in range(1, 5)])
    assert {r["backend"] for r in rows} == {"drift"}
    with pytest.raises(ValueError):
        fc.register_forecaster("holt", drift)


@pytest.mark.parametrize(
    "result, why",
    [
        (lambda h: [1.0] * h, "must return a DataFrame"),
        (lambda h: pd.DataFrame({"step": range(1, h + 1), "value": 1.0, "spread": 1.0}), "must return a DataFrame"),
        (lambda h: pd.DataFrame({"step": range(h), "point": 1.0, "spread": 1.0}), "each step from 1 to 3"),
        (lambda h: pd.DataFrame({"step": range(1, h + 1), "point": float("nan"), "spread": 1.0}), "no finite numbers"),
        (lambda h: pd.DataFrame({"step": range(1, h + 1), "point": "many", "spread": 1.0}), "no finite numbers"),
        (lambda h: pd.DataFrame({"step": range(1, h + 1), "point": 1.0, "spread": -1.0}), "negative spread"),
    ],
)
def test_a_wrong_result_is_a_clear_error(spark, result, why):
    fc.register_forecaster("wrong", lambda history, horizon: result(horizon))
    with pytest.raises(Exception, match=f"forecaster 'wrong' .*{why}"):
        fc.forecast(series(spark, 12), 3, "wrong").collect()


def test_history_joins_forecast(spark):
    df = series(spark, 12)
    both = fc.history_and_forecast(df, fc.forecast_holt(df, 3))
    kinds = {r["kind"]: r["count"] for r in both.groupBy("kind").count().collect()}
    assert kinds == {"historical": 12, "anchor": 1, "forecast": 3}
    anchor = both.where("kind = 'anchor'").first()
    assert anchor["month"] == "2023-12" and anchor["lower"] == anchor["upper"] == anchor["value"]
    summary = fc.forecast_summary(fc.forecast_holt(df, 3)).first()
    assert summary["horizon"] == 3
