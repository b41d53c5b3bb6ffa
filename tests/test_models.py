"""Forecast models and the isolation forest."""

import datetime as dt
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators import boosted, features, forecasting, isolation
from stockloom.operators import linear_models as lm

START = dt.date(2022, 1, 3)  # a Monday


@pytest.fixture(scope="module")
def seasonal(spark):
    """Series with a strong weekly pattern, so that yesterday predicts badly."""
    rng = np.random.default_rng(0)
    week = np.array([10, 12, 14, 20, 35, 60, 55])
    data = []
    for p in range(6):
        for i in range(180):
            day = START + dt.timedelta(days=i)
            data.append((day, p, "Delhi", float(week[day.weekday()] * (1 + 0.2 * p) + rng.normal(0, 1))))
    return spark.createDataFrame(data, "date_ date, product_id long, city_name string, daily_quantity double").cache()


@pytest.fixture(scope="module")
def split(seasonal):
    frame = features.feature_frame(features.calendar_grid(seasonal, "2022-01-03", "2022-07-01")).cache()
    return features.split_by_date(frame, "2022-06-15")


def wape(df, pred):
    return forecasting.evaluate(df, {pred: "m"}).first()["wape_pct"]


def recurrence(values, alpha):
    z = p = None
    q = 1.0
    for t, y in enumerate(values):
        if z is None:
            if y > 0:
                z, p = y, t + 1.0
        elif y > 0:
            z, p, q = z + alpha * (y - z), p + alpha * (q - p), 1.0
        else:
            q += 1
    return 0.0 if z is None else z / p


@pytest.mark.parametrize("alpha", [0.1, 0.4])
def test_croston_equals_the_recurrence(spark, alpha):
    rng = np.random.default_rng(4)
    series = {k: np.where(rng.random(120) < share, rng.integers(1, 50, 120), 0) for k, share in [(1, 0.05), (2, 0.3), (3, 1.0), (4, 0.0)]}
    data = [(dt.date(2022, 1, 1) + dt.timedelta(days=i), k, "c", float(y)) for k, v in series.items() for i, y in enumerate(v)]
    data.append((dt.date(2022, 6, 1), 9, "c", 5.0))  # sells only after the cut
    df = spark.createDataFrame(data, "date_ date, product_id long, city_name string, daily_quantity double")
    got = {r["product_id"]: r for r in forecasting.croston(df, "2022-01-01", "2022-05-01", alpha).collect()}
    for k, values in series.items():
        expected = recurrence(values, alpha)
        assert got[k]["pred_croston"] == pytest.approx(expected, rel=1e-12)
        assert got[k]["pred_sba"] == pytest.approx(expected * (1 - alpha / 2), rel=1e-12)
    assert got[9]["pred_croston"] == 0.0


def test_fixed_origin(spark):
    data = [(dt.date(2022, 1, d), 1, "c", float(d)) for d in range(1, 11) if d != 10]
    df = spark.createDataFrame(data, "date_ date, product_id long, city_name string, daily_quantity double")
    row = forecasting.fixed_origin(df, "2022-01-01", "2022-01-11").first()
    assert row["pred_naive"] == 0.0 and row["pred_mean"] == 4.5
    assert row["pred_ma7"] == pytest.approx((4 + 5 + 6 + 7 + 8 + 9 + 0) / 7)
    short = forecasting.fixed_origin(df, "2022-01-01", "2022-01-04").first()
    assert short["pred_ma7"] == 2.0


def test_ridge_equals_the_normal_equations(split):
    train, _ = split
    model = lm.ridge(train, features.FEATURES, alpha=3.0)
    pdf = train.toPandas()
    x, y = pdf[features.FEATURES].to_numpy(float), pdf["daily_quantity"].to_numpy()
    xc = x - x.mean(axis=0)
    w = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(x.shape[1]), xc.T @ (y - y.mean()))
    assert list(model.weights.values()) == pytest.approx(w.tolist(), rel=1e-6, abs=1e-8)
    assert model.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ w, rel=1e-6)


def test_seasonal_models_beat_naive(split):
    train, later = split
    rows = lm.additive_seasonal(train, forecasting.naive(later), "2022-01-03")
    rows = lm.predict_ridge(rows, lm.ridge(train, features.FEATURES))
    rows = boosted.gbt(train, features.FEATURES, rounds=30, rate=0.2, min_rows=20).predict(rows).cache()
    base = wape(rows, "pred_naive_lag1")
    for pred in ("pred_prophet", "pred_ridge", "pred_hist_gbt"):
        assert wape(rows, pred) < base / 2, pred
        assert rows.where(F.col(pred) < 0).count() == 0


def test_tuning_keeps_the_best_setting(split):
    train, later = split
    earlier, tune = features.split_by_date(train, "2022-05-15")
    grid = [boosted.Settings(rounds=1, depth=1), boosted.Settings(rounds=8, depth=4, rate=0.3)]
    _, best, scores = boosted.tune_gbt(earlier, tune, features.FEATURES, grid)
    assert best == min(scores, key=lambda s: s[1])[0]
    assert len(scores) == 2


def test_early_stopping_uses_the_later_period(split):
    train, later = split
    earlier, held = features.split_by_date(train, "2022-05-15")
    model = boosted.gbt_early_stop(earlier, held, features.FEATURES, rounds=12, rate=0.3)
    assert 1 <= len(model.trees) <= 12
    assert model.predict(later).where("pred_hist_gbt is null").count() == 0


def test_stack_is_the_non_negative_optimum(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(50, 10, 400)
    preds = {f"pred_{i}": y * c + rng.normal(0, s, 400) for i, (c, s) in enumerate([(1, 5), (1.1, 8), (-0.5, 3), (0.9, 20)])}
    data = [tuple(map(float, t)) for t in zip(y, *preds.values())]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in ["daily_quantity", *preds]))
    model, shares = lm.stack(df, list(preds), alpha=0.5)
    w = np.array(list(model.weights.values()))
    assert (w >= 0).all() and sum(shares.values()) == pytest.approx(1.0)
    x = np.column_stack(list(preds.values()))

    def loss(v):
        return ((y - x @ v) ** 2).sum() + 0.5 * (v**2).sum()

    best = loss(np.zeros(4))
    for size in range(1, 5):
        for active in combinations(range(4), size):
            a = x[:, active]
            v = np.zeros(4)
            v[list(active)] = np.linalg.solve(a.T @ a + 0.5 * np.eye(size), a.T @ y)
            if (v >= 0).all():
                best = min(best, loss(v))
    assert loss(w) == pytest.approx(best, rel=1e-9)


@pytest.mark.parametrize("seed", range(6))
def test_active_sets_meet_the_optimality_conditions(seed):
    rng = np.random.default_rng(seed)
    k = 30
    x = rng.normal(size=(200, k)) @ rng.normal(size=(k, k)) * 0.3 + rng.normal(size=(200, 1))
    w = np.where(rng.random(k) < 0.4, rng.random(k), -0.2 * rng.random(k))
    y = x @ w + rng.normal(0, 0.1, 200)
    a, b = x.T @ x + 0.1 * np.eye(k), x.T @ y
    found = lm.non_negative(a, b)
    slope, size = b - a @ found, np.abs(b).max()
    assert (found >= 0).all() and 0 < (found > 0).sum() < k
    assert (np.abs(slope[found > 0]) < 1e-7 * size).all() and (slope[found == 0] < 1e-7 * size).all()


def test_active_sets_on_odd_systems():
    assert lm.non_negative(np.eye(3), -np.ones(3)).tolist() == [0, 0, 0]
    assert lm.non_negative(np.zeros((2, 2)), np.zeros(2)).tolist() == [0, 0]
    twin = np.array([[2.0, 2.0], [2.0, 2.0]])  # the same column twice
    assert twin @ lm.non_negative(twin, np.array([4.0, 4.0])) == pytest.approx([4, 4])


def trend_frame(spark, slopes, days=720, noise=2.0, seed=0):
    """Daily totals with a weekly pattern and the given (day, change of slope) pairs."""
    rng = np.random.default_rng(seed)
    t = np.arange(days)
    y = 500 + 0.3 * t + sum(c * np.maximum(t - at, 0) for at, c in slopes)
    y = y + 20 * np.sin(2 * np.pi * t / 7) + 8 * np.cos(4 * np.pi * t / 7) + rng.normal(0, noise, days)
    rows = [(START + dt.timedelta(days=int(i)), float(v)) for i, v in zip(t, y)]
    return spark.createDataFrame(rows, "date_ date, _y double"), y


@pytest.mark.parametrize("slopes", [[(150, 1.0), (400, -1.5)], [(300, -0.8)], []], ids=str)
def test_planted_changes_are_found(spark, slopes):
    daily, y = trend_frame(spark, slopes)
    model, inputs, changes, mean = lm.trend_model(daily, str(START), 720)
    spacing = 0.9 * 720 / 26
    assert mean == pytest.approx(y.mean())
    for at, _ in slopes:
        assert min(abs(at - c) for c in changes) <= spacing
    assert len(changes) <= 3 * len(slopes)
    fitted = np.array([r["p"] for r in daily.withColumns(inputs).withColumn("p", model.expression()).orderBy("date_").collect()])
    assert np.sqrt(((fitted - y) ** 2).mean()) < (4.0 if slopes else 2.3)
    if slopes:
        t = np.arange(720)
        line = np.column_stack([np.ones(720), t, *[f(2 * np.pi * k * t / 7) for k in (1, 2, 3) for f in (np.sin, np.cos)]])
        straight = y - line @ np.linalg.lstsq(line, y, rcond=None)[0]
        assert ((fitted - y) ** 2).mean() < 0.05 * (straight**2).mean()


def test_changed_trend_forecasts_better(spark):
    daily, y = trend_frame(spark, [(350, -1.2)])
    rows = daily.select("date_", F.lit(1).alias("product_id"), F.lit("c").alias("city_name"), F.col("_y").alias("daily_quantity"))
    train, later = features.split_by_date(rows, str(START + dt.timedelta(days=690)))
    scored = lm.trend_with_changes(train, later, str(START), 690)
    scored = lm.additive_seasonal(train, scored, str(START)).cache()
    assert wape(scored, "pred_trend") < 2.0 < wape(scored, "pred_prophet")


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0.0, 2.0), (10.0, 7.0), (10.0, -4.0)], "daily_quantity double, pred_x double")
    row = forecasting.evaluate(df, {"pred_x": "X"}).first()
    # The negative forecast counts as zero.
    assert (row["mae"], row["wape_pct"], row["zero_days_overprediction"]) == (5.0, 75.0, 2.0)
    assert row["rmse"] == round(float(np.sqrt((4 + 9 + 100) / 3)), 4)
    empty = df.withColumn("daily_quantity", F.lit(0.0))
    assert forecasting.evaluate(empty, {"pred_x": "X"}).first()["wape_pct"] == 0.0


def test_horizon(spark):
    data = [(dt.date(2022, 1, 28), 1, "c", 28.0), (dt.date(2022, 1, 1), 2, "c", 99.0)]
    df = spark.createDataFrame(data, "date_ date, product_id long, city_name string, daily_quantity double")
    got = forecasting.forecast_horizon(df, "2022-01-31", 7).collect()
    assert len(got) == 14
    one = [r for r in got if r["product_id"] == 1]
    assert {r["yhat"] for r in one} == {1.0} and {r["yhat_lower"] for r in one} == {0.0}
    assert one[0]["yhat_upper"] == pytest.approx(1 + 1.96 * np.std([28.0] + [0.0] * 27, ddof=1), abs=1e-3)
    assert {r["yhat"] for r in got if r["product_id"] == 2} == {0.0}
    assert min(r["forecast_date"] for r in got) == dt.date(2022, 1, 31)


def test_isolation_forest(spark):
    rng = np.random.default_rng(6)
    points = rng.normal(0, 1, (3000, 3))
    points[:15] += 12
    data = [(i, *map(float, p)) for i, p in enumerate(points)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double")
    got = isolation.isolation_forest(df, ["a", "b", "c"], ["id"], contamination=0.03).cache()
    flagged = {r["id"] for r in got.where("is_isolation_anomaly").collect()}
    assert set(range(15)) <= flagged
    assert len(flagged) == pytest.approx(90, abs=3)
    span = got.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert (span[0], span[1]) == (0.0, 1.0)
    again = isolation.isolation_forest(df.repartition(9), ["a", "b", "c"], ["id"], contamination=0.03)
    assert {r["id"]: r["anomaly_score"] for r in again.collect()} == {r["id"]: r["anomaly_score"] for r in got.collect()}


def test_isolation_forest_on_constant_rows(spark):
    df = spark.range(50).selectExpr("id", "1.0D as a", "2.0D as b")
    got = isolation.isolation_forest(df, ["a", "b"], ["id"])
    assert got.where("is_isolation_anomaly").count() == 0
