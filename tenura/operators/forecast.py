"""Monthly forecasts for any number of series.

Input everywhere: ``(series_key, month, value)`` with one row per observed
month. Observed months count as equally spaced.
"""

import math
from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.errors import ForecasterError, InsufficientDataError
from tenura.fixed_values import (
    MIN_MONTHS_FORECAST,
    MIN_MONTHS_SEASONAL,
    SEASON_MONTHS,
    Z80,
)
from tenura.functions.dates import month_label
from tenura.operators.kpis import kpi_by_dimension, monthly_totals



def as_series(monthly: DataFrame, dimension: str | None = None) -> DataFrame:
    """Revenue and active customers of a monthly table as a long table of series."""
    if dimension is None:
        key = lambda metric: F.lit(metric)
    else:
        key = lambda metric: F.concat(F.lit(f"{metric}|"), F.coalesce(dimension, F.lit("")))
    pair = F.array(
        F.struct(key("revenue").alias("series_key"), F.col("revenue").alias("value")),
        F.struct(key("subscribers").alias("series_key"), F.col("active").cast("double").alias("value")),
    )
    return monthly.select("month", F.inline(pair)).select("series_key", "month", "value")


def series_input(
    tx: DataFrame, dimension: str | None = None, customers: DataFrame | None = None
) -> DataFrame:
    """The series to forecast; with a dimension, one pair per value of it (see ``kpi_by_dimension``)."""
    monthly = monthly_totals(tx) if dimension is None else kpi_by_dimension(tx, dimension, customers)
    return as_series(monthly, dimension)


def history_status(series: DataFrame) -> DataFrame:
    """``(series_key, n_months, last_month, status)``; short series are ``insufficient``."""
    enough = F.col("n_months") >= MIN_MONTHS_FORECAST
    return (
        series.groupBy("series_key")
        .agg(F.count("*").alias("n_months"), F.max("month").alias("last_month"))
        .withColumn("status", F.when(enough, F.lit("ok")).otherwise(F.lit("insufficient")))
    )


def require_history(series: DataFrame) -> DataFrame:
    """Raise if any series is too short (for callers with a single series)."""
    shortest = history_status(series).agg(F.min("n_months")).first()[0] or 0
    if shortest < MIN_MONTHS_FORECAST:
        raise InsufficientDataError(f"a forecast takes {MIN_MONTHS_FORECAST} months of history; the shortest series has {shortest}")
    return series


def forecast_calendar(status: DataFrame, horizon: int = 12) -> DataFrame:
    """``(series_key, step, month)`` for the months after the last observed one."""
    ahead = F.sequence(
        F.add_months("last_month", 1),
        F.add_months("last_month", horizon),
        F.expr("interval 1 month"),
    )
    return status.select("series_key", F.posexplode(ahead).alias("step", "month")).select(
        "series_key", (F.col("step") + 1).alias("step"), "month"
    )


def gathered(series: DataFrame) -> DataFrame:
    """One row per series with its values in month order; a series has one value per month."""
    pairs = F.array_sort(F.collect_list(F.struct("month", "value")))
    return series.groupBy("series_key").agg(
        F.transform(pairs, lambda p: p["value"].cast("double")).alias("y"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
    )


# --- Holt's linear trend on a parameter grid, in Catalyst ---------------------------


def _holt_state(state: Column, y: Column, alpha: Column, beta: Column) -> Column:
    """One step for three inputs at once: the data with zero start (a), a unit
    start level (p) and a unit start trend (q). Any start is a combination of them."""
    moved, sums = {}, {}
    for name, seen in (("a", y), ("p", F.lit(0.0)), ("q", F.lit(0.0))):
        level, trend = state[f"l{name}"], state[f"b{name}"]
        predicted = level + trend
        new_level = alpha * seen + (1 - alpha) * predicted
        moved[f"l{name}"] = new_level
        moved[f"b{name}"] = beta * (new_level - level) + (1 - beta) * trend
        sums[name] = predicted
    e, p, q = y - sums["a"], sums["p"], sums["q"]
    products = {"ee": e * e, "ep": e * p, "eq": e * q, "pp": p * p, "pq": p * q, "qq": q * q, "e": e, "p": p, "q": q}
    return F.struct(
        *[v.alias(k) for k, v in moved.items()],
        *[(state[f"s{k}"] + v).alias(f"s{k}") for k, v in products.items()],
    )


def _holt_start() -> Column:
    start = {"la": 0.0, "ba": 0.0, "lp": 1.0, "bp": 0.0, "lq": 0.0, "bq": 1.0}
    sums = ("ee", "ep", "eq", "pp", "pq", "qq", "e", "p", "q")
    return F.struct(
        *[F.lit(v).alias(k) for k, v in start.items()], *[F.lit(0.0).alias(f"s{k}") for k in sums]
    )


def holt_grid(series: DataFrame, step: float = 0.1, longest: int | None = None) -> DataFrame:
    """Best (alpha, beta) of a grid per series (of at most ``longest`` months), start values by least squares.

    ``(series_key, last_month, n, alpha, beta, sse, level, trend, spread)`` where
    level and trend are the final states and spread the residual deviation.
    The recurrence is linear in the start values, so the squared error has a
    closed-form minimum for every grid point. Runs without Python.
    """
    ticks = [round(step * i, 10) for i in range(1, int(round(1 / step)))]
    grid = F.array(
        *[
            F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"))
            for a, b in product(ticks, ticks)
        ]
    )
    runs = (
        gathered(series)
        .where(F.size("y").between(MIN_MONTHS_FORECAST, longest or (1 << 30)))
        .withColumn("g", F.explode(grid))
        .withColumn(
            "s",
            F.aggregate(
                "y", _holt_start(), lambda s, y: _holt_state(s, y, F.col("g.alpha"), F.col("g.beta"))
            ),
        )
    )
    det = F.col("s.spp") * F.col("s.sqq") - F.col("s.spq") * F.col("s.spq")
    solved = runs.withColumns(
        {
            "l0": (F.col("s.sep") * F.col("s.sqq") - F.col("s.seq") * F.col("s.spq")) / det,
            "b0": (F.col("s.seq") * F.col("s.spp") - F.col("s.sep") * F.col("s.spq")) / det,
        }
    ).withColumn("sse", F.col("s.see") - F.col("l0") * F.col("s.sep") - F.col("b0") * F.col("s.seq"))
    final = lambda x: F.col(f"s.{x}a") + F.col("l0") * F.col(f"s.{x}p") + F.col("b0") * F.col(f"s.{x}q")
    n = F.size("y")
    total = F.col("s.se") - F.col("l0") * F.col("s.sp") - F.col("b0") * F.col("s.sq")
    spread = F.sqrt(F.greatest((F.col("sse") - total * total / n) / (n - 1), F.lit(0.0)))
    best = F.min_by(
        F.struct(
            n.alias("n"),
            F.col("g.alpha").alias("alpha"),
            F.col("g.beta").alias("beta"),
            "sse",
            final("l").alias("level"),
            final("b").alias("trend"),
            spread.alias("spread"),
        ),
        F.struct(F.round("sse", 6), "g.alpha", "g.beta"),
    )
    return solved.groupBy("series_key").agg(
        F.max("last_month").alias("last_month"), best.alias("best")
    ).select("series_key", "last_month", "best.*")


def forecast_holt(series: DataFrame, horizon: int = 12, step: float = 0.1) -> DataFrame:
    """Trend-only forecast from :func:`holt_grid`."""
    return with_intervals(_trend_points(series, horizon, step), "holt")


# --- Exponential smoothing with a yearly season on a refined grid, in Catalyst -------------------

# Half-width and step of the grid around the best point so far, round by round.
_ROUNDS = ((0.4, 0.2), (0.1, 0.05), (0.025, 0.0125))
_LEAST_SHARE = 0.01


def _seasonal_start(y: Column) -> dict[str, Column]:
    """Level before the first month, trend and seasons from the first two years.

    The trend is the difference of the two years' means; the seasons are the
    first year without the line that has this trend through its mean.
    """
    m = SEASON_MONTHS
    mean = lambda first: F.aggregate(F.slice(y, first, m), F.lit(0.0), lambda a, x: a + x) / m
    trend = (mean(m + 1) - mean(1)) / m
    level = mean(1) - trend * ((m + 1) / 2)
    seasons = F.transform(F.slice(y, 1, m), lambda x, i: x - level - trend * (i + 1))
    return {"level": level, "trend": trend, "seasons": seasons}


def _seasonal_step(state: Column, y: Column, g: Column) -> Column:
    """One month; ``seasons`` begins with the one that comes next."""
    carried = state.level + state.trend
    season = F.get(state.seasons, F.lit(0))
    error = y - carried - season
    level = g.alpha * (y - season) + (1 - g.alpha) * carried
    return F.struct(
        level.alias("level"),
        (g.beta * (level - state.level) + (1 - g.beta) * state.trend).alias("trend"),
        F.array_append(
            F.slice(state.seasons, 2, SEASON_MONTHS - 1), g.gamma * (y - carried) + (1 - g.gamma) * season
        ).alias("seasons"),
        (state.sse + error * error).alias("sse"),
        (state.errors + error).alias("errors"),
    )


def seasonal_grid(series: DataFrame) -> DataFrame:
    """Additive smoothing with trend and yearly season: the best (alpha, beta, gamma) per series.

    ``(series_key, last_month, n, alpha, beta, gamma, sse, level, trend,
    seasons, spread)`` for series of at least two years. Start values follow a
    rule from the first two years; the parameters come from a grid that is
    refined twice around its best point. Runs without Python.
    """
    found = (
        gathered(series)
        .where(F.size("y") >= MIN_MONTHS_SEASONAL)
        .select("series_key", "last_month", "y", F.struct(*[v.alias(k) for k, v in _seasonal_start(F.col("y")).items()]).alias("start"))
        .withColumn("best", F.struct(*[F.lit(0.5).alias(c) for c in ("alpha", "beta", "gamma")]))
    )
    power = F.aggregate("y", F.lit(1.0), lambda a, x: a + x * x)
    for width, step in _ROUNDS:
        moves = F.lit([round(-width + step * i, 10) for i in range(int(round(2 * width / step)) + 1)])
        held = lambda centre, move: F.greatest(F.least(F.round(centre + move, 10), F.lit(1 - _LEAST_SHARE)), F.lit(_LEAST_SHARE))
        grid = F.flatten(
            F.transform(
                moves,
                lambda a: F.flatten(
                    F.transform(
                        moves,
                        lambda b: F.transform(
                            moves,
                            lambda c: F.struct(
                                held(F.col("best.alpha"), a).alias("alpha"),
                                held(F.col("best.beta"), b).alias("beta"),
                                held(F.col("best.gamma"), c).alias("gamma"),
                            ),
                        ),
                    )
                ),
            )
        )
        runs = found.select("series_key", "last_month", "y", "start", F.explode(grid).alias("g")).withColumn(
            "s",
            F.aggregate(
                "y",
                F.struct("start.*", F.lit(0.0).alias("sse"), F.lit(0.0).alias("errors")),
                lambda state, y: _seasonal_step(state, y, F.col("g")),
            ),
        )
        # differences in the last digits do not decide
        order = F.struct(F.round(F.col("s.sse") / power, 12), "g.alpha", "g.beta", "g.gamma")
        found = runs.groupBy("series_key").agg(
            F.first("last_month").alias("last_month"),
            F.first("y").alias("y"),
            F.first("start").alias("start"),
            F.min_by("g", order).alias("best"),
            F.min_by("s", order).alias("state"),
        )
    n = F.size("y")
    variance = (F.col("state.sse") - F.col("state.errors") * F.col("state.errors") / n) / (n - 1)
    return found.select(
        "series_key",
        "last_month",
        n.alias("n"),
        "best.*",
        "state.sse",
        "state.level",
        "state.trend",
        "state.seasons",
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("spread"),
    )


def _trend_points(series: DataFrame, horizon: int, step: float = 0.1, longest: int | None = None) -> DataFrame:
    return holt_grid(series, step, longest).select(
        "series_key",
        "last_month",
        "spread",
        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"),
        (F.col("level") + F.col("step") * F.col("trend")).alias("point"),
    )


def _seasonal_points(series: DataFrame, horizon: int) -> DataFrame:
    """Smoothing with a season for series of two years and more, with a trend only for shorter ones."""
    season = F.get("seasons", (F.col("step") - 1) % SEASON_MONTHS)
    points = seasonal_grid(series).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    ).select(
        "series_key",
        "last_month",
        "spread",
        "step",
        (F.col("level") + F.col("step") * F.col("trend") + season).alias("point"),
    )
    # both parts gather the months in the same way, once
    return points.unionByName(_trend_points(series, horizon, longest=MIN_MONTHS_SEASONAL - 1))


# --- Ridge regression on trend, changepoints and yearly waves, in Catalyst -----------------------

_MAX_BENDS = 25
_WAVES = SEASON_MONTHS // 2 - 1  # pairs of sine and cosine
# Prior scales: level and trend, slope changes (held close to 0), waves (held loosely).
_PRIOR_TREND, _PRIOR_BEND, _PRIOR_WAVE = 5.0, 0.05, 10.0


def _design_row(i: Column, n: Column, first: Column, bends: Column) -> Column:
    """The regression's columns for month number ``i`` of a series that starts in calendar month ``first``."""
    t = i / F.greatest(n - 1, F.lit(1))
    angle = (first + i) % SEASON_MONTHS * (2 * math.pi / SEASON_MONTHS)
    waves = [f(angle * k) for k in range(1, _WAVES + 1) for f in (F.sin, F.cos)]
    bent = F.transform(bends, lambda c: F.greatest(t - c, F.lit(0.0)))
    none = F.array().cast("array<double>")
    return F.concat(F.array(F.lit(1.0), t), bent, F.when(n >= SEASON_MONTHS, F.array(*waves)).otherwise(none))


def _solved(system: Column) -> Column:
    """The solution of linear equations, rows of coefficients with the right side last, by elimination.

    For systems that are positive definite, which need no exchange of rows.
    """

    def eliminate(m: Column, p: Column) -> Column:
        pivot = F.get(m, p)
        return F.transform(
            m,
            lambda row, i: F.when(i == p, F.transform(row, lambda x: x / F.get(pivot, p))).otherwise(
                F.zip_with(row, pivot, lambda x, y: x - F.get(row, p) / F.get(pivot, p) * y)
            ),
        )

    solved = F.aggregate(F.sequence(F.lit(0), F.size(system) - 1), system, eliminate)
    return F.transform(solved, lambda row: F.element_at(row, -1))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each worked out once per row.

    The optimizer would move a column that is used once into its use, also
    into a lambda, where it would be worked out for every element; a generated
    row stays where it is.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def seasonal_regression(series: DataFrame, horizon: int = 12) -> DataFrame:
    """``(series_key, last_month, weights, spread, estimates)``: a regression per series.

    Ridge regression on a trend with changepoints and yearly waves.
    Changepoints lie in the first four fifths; their slope changes are held
    close to 0, the waves loosely. Less than a year cannot tell waves from
    trend and gets none. ``estimates`` has the months of the horizon. Moments,
    their linear system and the estimates are folds over arrays of at most
    ``2 + 25 + 10`` columns; no Python runs.
    """
    n = F.col("n")
    given = gathered(series).where(F.size("y") >= MIN_MONTHS_FORECAST).select(
        "series_key",
        "last_month",
        "y",
        F.size("y").alias("n"),
        (F.month("first_month") - 1).alias("first"),
        F.coalesce(F.nullif(F.array_max(F.transform("y", F.abs)), F.lit(0.0)), F.lit(1.0)).alias("scale"),
        (F.floor(F.size("y") * 0.8).cast("int") - 1).alias("most"),
    )
    count = F.least(F.lit(_MAX_BENDS), F.col("most"))
    bends = F.transform(F.sequence(F.lit(1), count), lambda i: F.rint(i * (F.col("most") / count)) / (n - 1))
    target = _once(given, bends=bends, target=F.transform("y", lambda v: v / F.col("scale")))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    deviations = lambda values, mean: total(F.transform(values, lambda x: (x - F.col(mean)) * (x - F.col(mean))))
    steps = F.zip_with(F.slice("target", 2, n - 1), F.slice("target", 1, n - 1), lambda a, b: a - b)
    rows = F.transform(
        F.sequence(F.lit(0), n + (horizon - 1)), lambda i: _design_row(i, n, F.col("first"), F.col("bends"))
    )
    prior = F.concat(
        F.array_repeat(F.lit(_PRIOR_TREND), 2),
        F.array_repeat(F.lit(_PRIOR_BEND), F.size("bends")),
        F.array_repeat(F.lit(_PRIOR_WAVE), F.when(n >= SEASON_MONTHS, 2 * _WAVES).otherwise(0)),
    )
    made = _once(target, steps=steps, x=rows, prior=prior)
    made = _once(made, mean=total("steps") / (n - 1))
    made = _once(made, noise=F.greatest(deviations("steps", "mean") / (n - 1) / 2, F.lit(1e-6)))
    held = F.transform(
        "prior",
        lambda p, i: F.transform(
            F.sequence(F.lit(0), F.size("prior")),
            lambda j: F.when(i == j, F.col("noise") / (p * p)).otherwise(F.lit(0.0)),
        ),
    )
    pairs = F.zip_with(F.slice("x", 1, n), "target", lambda x, y: F.struct(x.alias("x"), F.array_append(x, y).alias("xy")))
    made = _once(made, held=held, pairs=pairs)
    moments = F.aggregate(
        "pairs",
        F.col("held"),
        lambda m, row: F.zip_with(m, row.x, lambda sums, a: F.zip_with(sums, row.xy, lambda total, b: total + a * b)),
    )
    made = _once(_once(made, moments=moments), weights=_solved(F.col("moments")))
    dot = lambda x: total(F.zip_with(x, "weights", lambda a, b: a * b)) * F.col("scale")
    made = _once(made, fitted=F.transform("x", dot))
    made = _once(made, misses=F.zip_with("y", F.slice("fitted", 1, n), lambda a, b: a - b))
    made = _once(made, middle=total("misses") / n)
    return made.select(
        "series_key",
        "last_month",
        "weights",
        F.sqrt(deviations("misses", "middle") / (n - 1)).alias("spread"),
        F.slice("fitted", n + 1, F.lit(horizon)).alias("estimates"),
    )


def _regression_points(series: DataFrame, horizon: int) -> DataFrame:
    return seasonal_regression(series, horizon).select(
        "series_key", "last_month", "spread", F.posexplode("estimates").alias("step", "point")
    ).withColumn("step", F.col("step") + 1)


# --- Forecasters of one's own --------------------------------------------------------------------

_OWN: dict[str, Callable[[pd.DataFrame, int], pd.DataFrame]] = {}
_BUILT_IN = {"holt_winters": _seasonal_points, "holt": _trend_points, "seasonal_regression": _regression_points}
METHODS = tuple(_BUILT_IN)


def register_forecaster(name: str, fit: Callable[[pd.DataFrame, int], pd.DataFrame]) -> None:
    """Make ``fit(history, horizon)`` available to :func:`forecast` under a name.

    ``history`` has the columns month and value of one series, in order, at
    least ``MIN_MONTHS_FORECAST`` rows. The result has exactly the columns
    step (1 to ``horizon``, each once), point and spread (the deviation of the
    residuals, which sets the intervals). Series run in parallel, one group
    each; intervals and calendar are those of the other methods.
    """
    if name in _BUILT_IN:
        raise ValueError(f"{name!r} is a method of the library")
    _OWN[name] = fit


def _checked(name: str, found, horizon: int) -> pd.DataFrame:
    """What a registered function returned, if it has the agreed form."""

    def refuse(why: str):
        raise ForecasterError(f"forecaster {name!r} {why}")

    if not isinstance(found, pd.DataFrame) or set(found.columns) != {"step", "point", "spread"}:
        refuse("must return a DataFrame with the columns step, point and spread")
    numeric = found.apply(pd.to_numeric, errors="coerce")
    if not np.isfinite(numeric.to_numpy(dtype=float)).all():
        refuse("returned values that are no finite numbers")
    if sorted(numeric["step"]) != list(range(1, horizon + 1)):
        refuse(f"must return each step from 1 to {horizon} once")
    if (numeric["spread"] < 0).any():
        refuse("returned a negative spread")
    return numeric


def _own_points(name: str, fit, series: DataFrame, horizon: int) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("month")
        if len(group) < MIN_MONTHS_FORECAST:
            return pd.DataFrame(columns=["series_key", "last_month", "spread", "step", "point"])
        found = _checked(name, fit(group[["month", "value"]].reset_index(drop=True), horizon), horizon)
        return pd.DataFrame(
            {
                "series_key": group["series_key"].iloc[0],
                "last_month": group["month"].iloc[-1],
                "spread": found["spread"].astype(float),
                "step": found["step"].astype(int),
                "point": found["point"].astype(float),
            }
        )

    chosen = series.select("series_key", "month", F.col("value").cast("double").alias("value"))
    return chosen.groupBy("series_key").applyInPandas(
        run, "series_key string, last_month date, spread double, step int, point double"
    )


def with_intervals(points: DataFrame, backend: str) -> DataFrame:
    """80 % intervals around ``(series_key, last_month, step, point, spread)``.

    Points and lower bounds are not below 0. Smoothing intervals widen with
    the root of the step around the clipped point; regression intervals have
    constant width around the unclipped one.
    """
    clipped = F.greatest(F.col("point"), F.lit(0.0))
    if backend == "seasonal_regression":
        centre, width = F.col("point"), F.col("spread") * Z80
    else:
        centre, width = clipped, F.col("spread") * Z80 * F.sqrt(F.col("step").cast("double"))
    return points.select(
        "series_key",
        month_label(F.add_months("last_month", F.col("step").cast("int"))).alias("month"),
        F.lit("forecast").alias("kind"),
        clipped.alias("value"),
        F.greatest(centre - width, F.lit(0.0)).alias("lower"),
        (centre + width).alias("upper"),
        F.lit(backend).alias("backend"),
    )


def forecast(series: DataFrame, horizon: int = 12, method: str = "holt_winters") -> DataFrame:
    """``(series_key, month, kind, value, lower, upper, backend)`` for all series.

    ``holt_winters`` adds a yearly season to series of at least 24 months and
    is a plain trend below that; ``holt`` never uses a season. Other names are
    those of :func:`register_forecaster`. Series with less than 6 months give no
    rows (see :func:`history_status`). A series is one group of at most one row
    per calendar month.
    """
    given = series.select("series_key", "month", "value")
    if method in _BUILT_IN:
        points = _BUILT_IN[method](given, horizon)
    elif method in _OWN:
        points = _own_points(method, _OWN[method], given, horizon)
    else:
        raise ValueError(f"unknown forecast method {method!r}; choose from {(*METHODS, *_OWN)}")
    return with_intervals(points, method)


def history_and_forecast(series: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Observed and forecast months in one table, joined at the last actual value.

    The anchor row repeats the last observation as a forecast without width,
    so that the two parts of each series connect.
    """
    history = series.select(
        "series_key",
        month_label("month").alias("month"),
        F.lit("historical").alias("kind"),
        F.col("value").cast("double").alias("value"),
    )
    last = history.groupBy("series_key").agg(F.max_by("value", "month").alias("value"), F.max("month").alias("month"))
    anchor = last.select(
        "series_key",
        "month",
        F.lit("anchor").alias("kind"),
        "value",
        F.col("value").alias("lower"),
        F.col("value").alias("upper"),
    )
    return history.unionByName(anchor, allowMissingColumns=True).unionByName(
        forecasts, allowMissingColumns=True
    )


def forecast_summary(forecasts: DataFrame) -> DataFrame:
    """Per series: sum, mean and last value of the horizon."""
    return forecasts.groupBy("series_key").agg(
        F.sum("value").alias("total"),
        F.avg("value").alias("mean"),
        F.max_by("value", "month").alias("last_value"),
        F.count("*").alias("horizon"),
    )
