"""Forecasts of several days ahead by rolling a fitted lag model forward.

The model is linear in the last 28 days of a series and in the weekday, so the state
of a series is one array of 28 values.  A day is forecast from the state and joins
it; the whole horizon is one fold over the days, without a join, a loop on the
driver or one job per day.  Limits are split-conformal: on days before the cut the
model is rolled forward from many origins, and for each step the quantile of its
absolute errors, in units of the recent deviation of the series, sets the width.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.quantiles import exact_quantiles
from stockloom.operators.features import add_lags, add_rolling_mean
from stockloom.operators.linear_models import LinearModel, ridge
from stockloom.schemas import SERIES_KEY

STATE_DAYS = 28
LAGS, MEANS = [1, 7, 14, 28], [7, 14, 28]


def _weekdays(day: Column) -> dict[str, Column]:
    """Six weekday indicators (Monday is the base)."""
    return {f"_dow{d}": (F.weekday(day) == d).cast("double") for d in range(1, 7)}


@dataclass(frozen=True)
class LagModel:
    """A linear model on lags, rolling means and weekdays."""

    linear: LinearModel

    def next_value(self, state: Column, day: Column) -> Column:
        """Forecast of ``day`` from the values before it, the newest last."""
        w = self.linear.weights
        out = F.lit(self.linear.intercept)
        for n in LAGS:
            out = out + F.element_at(state, -n) * F.lit(w[f"lag_{n}"])
        for n in MEANS:
            newest = F.slice(state, F.size(state) - n + 1, F.lit(n))
            out = out + F.aggregate(newest, F.lit(0.0), lambda a, x: a + x) * F.lit(w[f"rolling_mean_{n}"] / n)
        # Weights by weekday, Monday first, looked up instead of multiplied.
        by_day = F.array(F.lit(0.0), *[F.lit(w[f"_dow{d}"]) for d in range(1, 7)])
        return F.greatest(out + F.get(by_day, F.weekday(day)), F.lit(0.0))

    def roll(self, state: Column, first: Column, days: int) -> Column:
        """Forecasts of ``days`` days from ``first`` on, as an array."""
        rolled = F.aggregate(
            F.sequence(F.lit(0), F.lit(days - 1)),
            state,
            lambda values, step: F.concat(values, F.array(self.next_value(values, F.date_add(first, step)))),
        )
        return F.slice(rolled, F.size(state) + 1, F.lit(days))


def fit_lag_model(grid: DataFrame, cut: str, alpha: float = 1.0, keys: list[str] = SERIES_KEY) -> LagModel:
    """The model fitted on the days of a dense grid that lie before ``cut``."""
    before = grid.where(F.col("date_") < F.lit(cut).cast("date"))
    rows = add_rolling_mean(add_lags(before, LAGS, keys=keys), MEANS, keys=keys, full=True)
    rows = rows.withColumns(_weekdays(F.col("date_")))
    names = [f"lag_{n}" for n in LAGS] + [f"rolling_mean_{n}" for n in MEANS] + [f"_dow{d}" for d in range(1, 7)]
    return LagModel(ridge(rows.dropna(subset=names), names, alpha=alpha))


def recent_states(demand: DataFrame, cut: str, keys: list[str] = SERIES_KEY) -> DataFrame:
    """(keys, state): the last 28 days before ``cut`` of every series, the oldest first.

    ``demand`` has one row per series and day; days without one are zero.
    """
    last = F.lit(cut).cast("date")
    recent = (F.col("date_") < last) & (F.col("date_") >= F.date_sub(last, STATE_DAYS))
    entry = F.when(recent, F.struct(F.datediff("date_", F.date_sub(last, STATE_DAYS)).alias("k"), F.col("daily_quantity").cast("double").alias("v")))
    own = demand.groupBy(*keys).agg(F.collect_list(entry).alias("_own"))
    values = F.map_from_entries("_own")
    filled = F.transform(F.sequence(F.lit(0), F.lit(STATE_DAYS - 1)), lambda k: F.coalesce(F.element_at(values, k), F.lit(0.0)))
    return own.select(*keys, filled.alias("state"))


def _spread(state: Column) -> Column:
    """Deviation of the state, at least a tenth of its mean and never zero."""
    mean = F.aggregate(state, F.lit(0.0), lambda a, x: a + x) / F.size(state)
    squares = F.aggregate(state, F.lit(0.0), lambda a, x: a + x * x) / F.size(state)
    return F.greatest(F.sqrt(F.greatest(squares - mean * mean, F.lit(0.0))), mean * 0.1, F.lit(1e-6))


def conformal_widths(
    grid: DataFrame, model: LagModel, first: str, cut: str, days: int, coverage: float = 0.95, keys: list[str] = SERIES_KEY
) -> list[float]:
    """Half widths per step, in deviations of the state, from all origins in [first, cut - days].

    With n errors of a step the width is their ceil((n + 1) coverage)-th smallest.
    """
    w = Window.partitionBy(*keys).orderBy("date_")
    value = F.col("daily_quantity").cast("double")
    rows = grid.where(F.col("date_") < F.lit(cut).cast("date")).select(
        *keys,
        "date_",
        F.collect_list(value).over(w.rowsBetween(-STATE_DAYS, -1)).alias("state"),
        F.collect_list(value).over(w.rowsBetween(0, days - 1)).alias("actual"),
    )
    whole = (F.size("state") == STATE_DAYS) & (F.size("actual") == days) & (F.col("date_") >= F.lit(first).cast("date"))
    rolled = rows.where(whole).withColumns({"yhat": model.roll(F.col("state"), F.col("date_"), days), "spread": _spread(F.col("state"))})
    errors = rolled.select("spread", F.posexplode(F.arrays_zip("yhat", "actual")).alias("step", "pair")).select(
        "step", (F.abs(F.col("pair.yhat") - F.col("pair.actual")) / F.col("spread")).alias("error")
    )
    n = errors.where(F.col("step") == 0).count()
    if not n:
        raise ValueError("no origin with a whole horizon before the cut")
    place = min(1.0, (math.ceil((n + 1) * coverage) - 1) / max(n - 1, 1))
    found = {r["step"]: r["q"] for r in exact_quantiles(errors, ["step"], "error", {"q": place}).collect()}  # one row per step
    return [found[k] for k in range(days)]


def recursive_horizon(
    demand: DataFrame, model: LagModel, widths: list[float], cut: str, keys: list[str] = SERIES_KEY
) -> DataFrame:
    """(keys, forecast_date, step, yhat, yhat_lower, yhat_upper) for the days from ``cut`` on."""
    days = len(widths)
    width = F.array(*[F.lit(float(x)) for x in widths])
    start = F.lit(cut).cast("date")
    rolled = recent_states(demand, cut, keys).select(
        *keys, _spread(F.col("state")).alias("spread"), F.posexplode(model.roll(F.col("state"), start, days)).alias("step", "yhat")
    )
    half = F.col("spread") * F.get(width, F.col("step"))
    return rolled.select(
        *keys,
        F.date_add(start, F.col("step")).alias("forecast_date"),
        (F.col("step") + 1).alias("step"),
        F.col("yhat"),
        F.greatest(F.lit(0.0), F.col("yhat") - half).alias("yhat_lower"),
        (F.col("yhat") + half).alias("yhat_upper"),
    )
