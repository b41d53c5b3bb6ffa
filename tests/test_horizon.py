"""Recursive forecasts and their conformal limits."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators import features, horizon

START = dt.date(2022, 1, 3)  # a Monday
WEEK = np.array([10, 12, 14, 20, 35, 60, 55])


def sales(spark, series=12, days=300, noise=4.0, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(series):
        for i in range(days):
            v = WEEK[(START + dt.timedelta(days=i)).weekday()] * (1 + 0.1 * p) + rng.normal(0, noise)
            if v > 0 and rng.random() > 0.05:
                rows.append((START + dt.timedelta(days=i), p, "Delhi", float(v)))
    return spark.createDataFrame(rows, "date_ date, product_id long, city_name string, daily_quantity double").cache()


def day(i):
    return str(START + dt.timedelta(days=i))


@pytest.fixture(scope="module")
def demand(spark):
    return sales(spark)


@pytest.fixture(scope="module")
def model(demand):
    return horizon.fit_lag_model(features.calendar_grid(demand, day(0), day(299)), day(240))


def plain_roll(model, values, first, days):
    w = model.linear.weights
    values = list(values)
    for step in range(days):
        p = model.linear.intercept
        p += sum(values[-n] * w[f"lag_{n}"] for n in horizon.LAGS)
        p += sum(np.mean(values[-n:]) * w[f"rolling_mean_{n}"] for n in horizon.MEANS)
        weekday = (first + dt.timedelta(days=step)).weekday()
        p += w[f"_dow{weekday}"] if weekday else 0.0
        values.append(max(p, 0.0))
    return values[-days:]


def test_fold_equals_a_plain_loop(demand, model):
    cut = START + dt.timedelta(days=260)
    got = {}
    for r in horizon.recursive_horizon(demand, model, [0.0] * 21, str(cut)).collect():
        got.setdefault(r["product_id"], {})[r["step"]] = (r["forecast_date"], r["yhat"])
    own = {(r["product_id"], r["date_"]): r["daily_quantity"] for r in demand.collect()}
    assert len(got) == 12
    for p, steps in got.items():
        before = [own.get((p, cut - dt.timedelta(days=k)), 0.0) for k in range(28, 0, -1)]
        want = plain_roll(model, before, cut, 21)
        assert [steps[k + 1][1] for k in range(21)] == pytest.approx(want, rel=1e-9)
        assert [steps[k + 1][0] for k in range(21)] == [cut + dt.timedelta(days=k) for k in range(21)]


def test_a_series_without_recent_sales_and_one_that_starts_late(spark, model):
    rows = [(START, 1, "c", 5.0), (START + dt.timedelta(days=99), 2, "c", 70.0), (START + dt.timedelta(days=120), 3, "c", 9.0)]
    df = spark.createDataFrame(rows, "date_ date, product_id long, city_name string, daily_quantity double")
    got = horizon.recursive_horizon(df, model, [1.0] * 3, day(100)).collect()
    assert len(got) == 9 and all(r["yhat"] >= 0 and r["yhat_lower"] >= 0 and r["yhat_upper"] >= r["yhat"] for r in got)


def test_coverage_is_near_the_nominal_one(spark):
    demand = sales(spark, series=120, days=260, seed=5)
    grid = features.calendar_grid(demand, day(0), day(259)).cache()
    model = horizon.fit_lag_model(grid, day(170))
    for coverage in (0.8, 0.95):
        widths = horizon.conformal_widths(grid, model, day(170), day(230), 7, coverage)
        assert len(widths) == 7 and min(widths) > 0
        hit = total = 0
        for origin in range(230, 253, 7):
            rows = horizon.recursive_horizon(demand, model, widths, day(origin))
            joined = rows.join(grid.withColumnRenamed("date_", "forecast_date"), ["product_id", "city_name", "forecast_date"])
            inside = F.col("daily_quantity").between(F.col("yhat_lower"), F.col("yhat_upper"))
            found = joined.agg(F.count_if(inside), F.count(F.lit(1))).first()
            hit, total = hit + found[0], total + found[1]
        assert hit / total == pytest.approx(coverage, abs=0.02)


def test_too_short_a_history_is_refused(demand, model):
    grid = features.calendar_grid(demand, day(0), day(40))
    with pytest.raises(ValueError):
        horizon.conformal_widths(grid, model, day(30), day(35), 14)
