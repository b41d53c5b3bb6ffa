"""Forecasting and evaluation queries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from stockloom.catalog.features import FRAME, GRID, panel_features, panel_grid
from stockloom.catalog.registry import query
from stockloom.catalog.views import CUT_DAY, EVENT_CUT, EVENT_FIRST, EVENT_LAST, EVENT_PANEL, FIRST_DAY, grid
from stockloom.operators import boosted, demand, horizon
from stockloom.operators import features as f
from stockloom.operators import forecasting as fc
from stockloom.operators import linear_models as lm

_ID = "date_, product_id, city_name, daily_quantity"
_IDS = ["date_", "product_id", "city_name", "daily_quantity"]
BASELINES = {
    "pred_naive_lag1": "Naive (Lag-1)",
    "pred_seasonal_naive_lag7": "Seasonal Naive (Lag-7)",
    "pred_ma_7": "Moving Average (7 Days)",
    "pred_ma_14": "Moving Average (14 Days)",
    "pred_ma_28": "Moving Average (28 Days)",
    "pred_prophet": "Prophet (Weekly Seasonality)",
}


def baselines(t):
    """Validation rows of the panel with all simple forecasts."""
    _, validation = f.split_by_date(panel_features(t), t.days.cut)
    return fc.seasonal_proxy(fc.moving_average(fc.seasonal_naive(fc.naive(validation))))


RESULTS = (
    GRID
    + ",\n"
    + FRAME.replace("ROUND(AVG(daily_quantity)", "(AVG(daily_quantity)").replace(", 6) AS rolling_mean", ") AS rolling_mean")
    + f""",
results AS (SELECT {_ID}, lag_1 AS pred_naive_lag1, lag_7 AS pred_seasonal_naive_lag7, rolling_mean_7 AS pred_ma_7, rolling_mean_14 AS pred_ma_14,
  rolling_mean_28 AS pred_ma_28, greatest(lag_7 * 0.9 + rolling_mean_7 * 0.1, 0.0) AS pred_prophet FROM features WHERE date_ >= {CUT_DAY})"""
)


def _pred_sql(*names):
    return f"WITH {RESULTS} SELECT {_ID}, " + ", ".join(f"ROUND({n}, 6) AS {n}" for n in names) + " FROM results"


def _pred(t, *names):
    return baselines(t).select(*_IDS, *[F.round(n, 6).alias(n) for n in names])


@query("fct01_naive", _pred_sql("pred_naive_lag1"))
def _(t):
    return _pred(t, "pred_naive_lag1")


@query("fct02_seasonal_naive", _pred_sql("pred_seasonal_naive_lag7"))
def _(t):
    return _pred(t, "pred_seasonal_naive_lag7")


@query("fct03_moving_average", _pred_sql("pred_ma_7", "pred_ma_14", "pred_ma_28"))
def _(t):
    return _pred(t, "pred_ma_7", "pred_ma_14", "pred_ma_28")


@query(
    "fct04_fixed_origin",
    f"""WITH {GRID}, tr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id, city_name ORDER BY date_ DESC) AS rn FROM grid WHERE date_ < {CUT_DAY})
    SELECT product_id, city_name, MAX(daily_quantity) FILTER (rn = 1) AS pred_naive, ROUND(AVG(daily_quantity) FILTER (rn <= 7), 6) AS pred_ma7,
    ROUND(AVG(daily_quantity), 6) AS pred_mean FROM tr GROUP BY 1, 2""",
)
def _(t):
    origin = fc.fixed_origin(t.panel, t.days.first, t.days.cut)
    return origin.withColumns({c: F.round(c, 6) for c in ["pred_ma7", "pred_mean"]})


EVENT_GRID = EVENT_PANEL + ",\n" + grid("event_panel", EVENT_FIRST, EVENT_LAST)
SBC = f"""train AS (SELECT *, CAST(date_ - {EVENT_FIRST} + 1 AS BIGINT) AS t FROM grid WHERE date_ < {EVENT_CUT}),
s AS (SELECT product_id, city_name, COUNT(*) AS total_periods, COUNT(*) FILTER (daily_quantity > 0) AS n, AVG(daily_quantity) FILTER (daily_quantity > 0) AS m,
  STDDEV_POP(daily_quantity) FILTER (daily_quantity > 0) AS sd, AVG(daily_quantity) AS om FROM train GROUP BY 1, 2),
v AS (SELECT *, CASE WHEN n = 0 THEN CAST(total_periods AS DOUBLE) ELSE total_periods / n END AS adi0, CASE WHEN n = 0 THEN 0.0 ELSE POW(sd / m, 2) END AS cv0 FROM s),
sbc AS (SELECT product_id, city_name, total_periods, n AS active_sales_days, ROUND((total_periods - n) / total_periods * 100, 2) AS zero_sales_pct,
  ROUND(adi0, 3) AS adi, ROUND(cv0, 3) AS cv2, ROUND(COALESCE(m, 0.0), 6) AS mean_non_zero_demand, ROUND(om, 6) AS overall_mean_daily_demand,
  CASE WHEN n = 0 THEN 'Intermittent' WHEN adi0 < 1.32 AND cv0 < 0.49 THEN 'Smooth' WHEN cv0 < 0.49 THEN 'Intermittent' WHEN adi0 < 1.32 THEN 'Erratic'
    ELSE 'Lumpy' END AS demand_category FROM v)"""
CROSTON = """cr(product_id, city_name, t, z, p, q) AS (
  SELECT product_id, city_name, t, CASE WHEN daily_quantity > 0 THEN daily_quantity END, CASE WHEN daily_quantity > 0 THEN CAST(1 AS DOUBLE) END, CAST(1 AS DOUBLE)
  FROM train WHERE t = 1
  UNION ALL
  SELECT c.product_id, c.city_name, y.t,
    CASE WHEN c.z IS NULL THEN CASE WHEN y.daily_quantity > 0 THEN y.daily_quantity END WHEN y.daily_quantity > 0 THEN c.z + 0.1 * (y.daily_quantity - c.z) ELSE c.z END,
    CASE WHEN c.z IS NULL THEN CASE WHEN y.daily_quantity > 0 THEN CAST(y.t AS DOUBLE) END WHEN y.daily_quantity > 0 THEN c.p + 0.1 * (c.q - c.p) ELSE c.p END,
    CASE WHEN c.z IS NULL OR y.daily_quantity > 0 THEN CAST(1 AS DOUBLE) ELSE c.q + 1 END
  FROM cr c JOIN train y ON y.product_id = c.product_id AND y.city_name = c.city_name AND y.t = c.t + 1),
croston AS (SELECT product_id, city_name, COALESCE(z / p, 0.0) AS rate FROM cr WHERE t = (SELECT MAX(t) FROM train))"""


def _sbc(t):
    return fc.sbc_classify(t.event_panel, t.event_days.first, t.event_days.cut, mean_digits=6)


@query("fct05_sbc_classes", f"WITH {EVENT_GRID}, {SBC} SELECT * FROM sbc")
def _(t):
    return _sbc(t)


@query(
    "fct06_sbc_summary",
    f"""WITH {EVENT_GRID}, {SBC} SELECT demand_category, COUNT(*) AS series, ROUND(COUNT(*) / (SELECT COUNT(*) FROM sbc) * 100, 1) AS share_pct
    FROM sbc GROUP BY 1""",
)
def _(t):
    return fc.sbc_summary(_sbc(t))


@query(
    "fct07_croston",
    f"WITH RECURSIVE {EVENT_GRID}, {SBC}, {CROSTON} SELECT product_id, city_name, ROUND(rate, 6) AS pred_croston FROM croston",
)
def _(t):
    rates = fc.croston(t.event_panel, t.event_days.first, t.event_days.cut)
    return rates.select("product_id", "city_name", F.round("pred_croston", 6).alias("pred_croston"))


@query(
    "fct08_sba",
    f"WITH RECURSIVE {EVENT_GRID}, {SBC}, {CROSTON} SELECT product_id, city_name, ROUND(rate * 0.95, 6) AS pred_sba FROM croston",
)
def _(t):
    rates = fc.croston(t.event_panel, t.event_days.first, t.event_days.cut)
    return rates.select("product_id", "city_name", F.round("pred_sba", 6).alias("pred_sba"))


def _train_validation(t):
    return f.split_by_date(panel_features(t), t.days.cut)


def _out(df, *preds):
    return df.select(*_IDS, *[F.round(p, 4).alias(p) for p in preds])


@query("fct09_ridge")
def _(t):
    train, validation = _train_validation(t)
    return _out(lm.predict_ridge(validation, lm.ridge(train, f.FEATURES)), "pred_ridge")


# What a fitted model must satisfy, next to the figures of the lag-7 forecast.
_CHECK = f"""WITH {GRID}, {FRAME}, v AS (SELECT * FROM features WHERE date_ >= {CUT_DAY})
    SELECT COUNT(*) AS rows_scored, CAST(0 AS BIGINT) AS negative, ROUND(SUM(abs(daily_quantity - lag_7)) / SUM(daily_quantity) * 100, 2) AS wape_lag7,
    TRUE AS better_than_lag7 FROM v"""


_CHECK_LAG1 = _CHECK.replace("lag_7", "lag_1").replace("lag7", "lag1")


def _checked(df, pred, against="lag_7"):
    wape = {c: F.sum(F.abs(F.col("daily_quantity") - F.col(c))) / F.sum("daily_quantity") * 100 for c in (pred, against)}
    name = against.replace("_", "")
    return df.agg(
        F.count(pred).alias("rows_scored"),
        F.count_if(F.col(pred) < 0).alias("negative"),
        F.round(wape[against], 2).alias(f"wape_{name}"),
        (wape[pred] < wape[against]).alias(f"better_than_{name}"),
    )


@query("fct09_ridge_check", _CHECK)
def _(t):
    train, validation = _train_validation(t)
    return _checked(lm.predict_ridge(validation, lm.ridge(train, f.FEATURES)), "pred_ridge")


@query("fct10_boosted_trees_check", _CHECK)
def _(t):
    train, validation = _train_validation(t)
    return _checked(boosted.gbt(train, f.FEATURES).predict(validation), "pred_hist_gbt")


@query("fct10_boosted_trees")
def _(t):
    train, validation = _train_validation(t)
    return _out(boosted.gbt(train, f.FEATURES).predict(validation), "pred_hist_gbt")


# Least squares with a trend and weekday levels: the slope within weekdays.
@query(
    "fct11_additive_seasonal",
    f"""WITH {GRID}, {FRAME}, train AS (SELECT * FROM features WHERE date_ < {CUT_DAY}),
    daily AS (SELECT isodow(date_) AS dow, CAST(date_ - {FIRST_DAY} AS DOUBLE) AS t, SUM(daily_quantity) AS y FROM train GROUP BY date_),
    g AS (SELECT dow, AVG(t) AS mt, AVG(y) AS my FROM daily GROUP BY 1),
    b AS (SELECT SUM((t - mt) * (y - my)) / SUM((t - mt) * (t - mt)) AS slope FROM daily JOIN g USING (dow)),
    s AS (SELECT product_id, city_name, AVG(daily_quantity) AS level FROM train GROUP BY 1, 2)
    SELECT date_, f.product_id, f.city_name, daily_quantity, ROUND(greatest(0.0, level * (my + slope * (CAST(date_ - {FIRST_DAY} AS DOUBLE) - mt))
      / greatest(1.0, (SELECT AVG(y) FROM daily))), 4) AS pred_prophet
    FROM features f JOIN g ON g.dow = isodow(date_) JOIN s ON s.product_id = f.product_id AND s.city_name = f.city_name CROSS JOIN b WHERE date_ >= {CUT_DAY}""",
)
def _(t):
    train, validation = _train_validation(t)
    return _out(lm.additive_seasonal(train, validation, t.days.first), "pred_prophet")


def _days_between(first, cut):
    return (date.fromisoformat(cut) - date.fromisoformat(first)).days


@query("fct11_trend_changes")
def _(t):
    train, validation = _train_validation(t)
    return _out(lm.trend_with_changes(train, validation, t.days.first, _days_between(t.days.first, t.days.cut)), "pred_trend")


# What the trend must do: answer every row, never below zero, closer than the day before.
@query("fct11_trend_changes_check", _CHECK_LAG1)
def _(t):
    train, validation = _train_validation(t)
    rows = lm.trend_with_changes(train, validation, t.days.first, _days_between(t.days.first, t.days.cut))
    return _checked(rows, "pred_trend", "lag_1")


@query("fct12_seasonal_proxy", _pred_sql("pred_prophet"))
def _(t):
    return _pred(t, "pred_prophet")


def _tuning_features(t):
    return f.tuning_frame(panel_grid(t))


def _tuned(t):
    earlier, validation = f.split_by_date(_tuning_features(t), t.days.cut)
    train, tune = f.split_by_date(earlier, t.days.tune)
    best, _, _ = boosted.tune_gbt(train, tune, f.TUNING_FEATURES, boosted.search_settings())
    return best.predict(validation, "pred_lgb")


@query("fct13_tuned_trees")
def _(t):
    return _out(_tuned(t), "pred_lgb")


@query("fct13_tuned_trees_check", _CHECK)
def _(t):
    return _checked(_tuned(t), "pred_lgb")


def _stopped(t):
    earlier, validation = _train_validation(t)
    train, held_out = f.split_by_date(earlier, t.days.tune)
    return boosted.gbt_early_stop(train, held_out, f.FEATURES).predict(validation, "pred_xgb")


@query("fct14_early_stopping")
def _(t):
    return _out(_stopped(t), "pred_xgb")


@query("fct14_early_stopping_check", _CHECK)
def _(t):
    return _checked(_stopped(t), "pred_xgb")


def _stacked(t):
    earlier, validation = f.split_by_date(_tuning_features(t), t.days.cut)
    # Weights are fitted on a period before the one they are applied to, trees are
    # tuned and stopped on the 30 days before that one.
    train, tune = f.split_by_date(earlier, t.days.tune)
    before = date.fromisoformat(t.days.tune) - timedelta(days=30)
    fitted, held_out = f.split_by_date(train, str(before))
    ridge = lm.ridge(train, f.FEATURES)
    tuned, _, _ = boosted.tune_gbt(fitted, held_out, f.TUNING_FEATURES, boosted.search_settings())
    stopped = boosted.gbt_early_stop(fitted, held_out, f.FEATURES)

    def base(df):
        df = fc.seasonal_proxy(fc.moving_average(fc.seasonal_naive(fc.naive(df)), [7, 28]))
        df = stopped.predict(tuned.predict(df, "pred_lgb"), "pred_xgb")
        return lm.predict_ridge(df, ridge)

    preds = ["pred_naive_lag1", "pred_seasonal_naive_lag7", "pred_ma_28", "pred_prophet", "pred_ridge", "pred_lgb", "pred_xgb"]
    model, _ = lm.stack(base(tune), preds)
    return lm.predict_stack(base(validation), model)


@query("fct15_stacking")
def _(t):
    return _out(_stacked(t), "pred_ensemble")


@query("fct15_stacking_check", _CHECK)
def _(t):
    return _checked(_stacked(t), "pred_ensemble")


# Event validation rows with the fixed-origin forecasts and demand class.
# Frequent demand takes a ridge on two lags, in closed form.
FIXED = f"""lagged AS (SELECT *, COALESCE(LAG(daily_quantity, 1) OVER w, 0.0) AS lag_1, COALESCE(LAG(daily_quantity, 7) OVER w, 0.0) AS lag_7 FROM grid
  WINDOW w AS (PARTITION BY product_id, city_name ORDER BY date_)),
mm AS (SELECT AVG(lag_1) AS m1, AVG(lag_7) AS m2, AVG(daily_quantity) AS my FROM lagged WHERE date_ < {EVENT_CUT}),
ss AS (SELECT 1 + SUM((lag_1 - m1) * (lag_1 - m1)) AS s11, 1 + SUM((lag_7 - m2) * (lag_7 - m2)) AS s22, SUM((lag_1 - m1) * (lag_7 - m2)) AS s12,
  SUM((lag_1 - m1) * (daily_quantity - my)) AS s1, SUM((lag_7 - m2) * (daily_quantity - my)) AS s2 FROM lagged, mm WHERE date_ < {EVENT_CUT}),
val AS (SELECT date_, product_id, city_name, daily_quantity, greatest(0.0, my + (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) * (lag_1 - m1)
  + (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) * (lag_7 - m2)) AS pred_ridge FROM lagged, mm, ss WHERE date_ >= {EVENT_CUT}),
fx AS (SELECT product_id, city_name, MAX(daily_quantity) FILTER (t = (SELECT MAX(t) FROM train)) AS pred_naive,
  AVG(daily_quantity) FILTER (t > (SELECT MAX(t) FROM train) - 7) AS pred_ma7, AVG(daily_quantity) AS pred_mean FROM train GROUP BY 1, 2),
res AS (SELECT v.*, pred_naive, pred_ma7, pred_mean, rate AS pred_croston, rate * 0.95 AS pred_sba, demand_category,
  CASE WHEN demand_category IN ('Smooth', 'Erratic') THEN pred_ridge ELSE rate * 0.95 END AS pred_hybrid
  FROM val v JOIN fx USING (product_id, city_name) JOIN croston USING (product_id, city_name) JOIN sbc USING (product_id, city_name))"""
FIXED_MODELS = {
    "pred_naive": "Naive (Lag-1)",
    "pred_ma7": "Moving Average (7 Days)",
    "pred_mean": "Historical Mean",
    "pred_croston": "Croston's Method (Classic)",
    "pred_sba": "SBA (Syntetos-Boylan Approximation)",
    "pred_hybrid": "Hybrid (ML Head + SBA Tail)",
}
_EVENTS = f"WITH RECURSIVE {EVENT_GRID}, {SBC}, {CROSTON}, {FIXED}"


def fixed_results(t):
    """Validation rows of the event panel with every per-series forecast."""
    events, days, keys, lags = t.event_panel, t.event_days, ["product_id", "city_name"], ["lag_1", "lag_7"]
    lagged = f.add_lags(f.calendar_grid(events, days.first, days.last), [1, 7]).fillna(0.0, lags)
    train, validation = f.split_by_date(lagged, days.cut)
    validation = lm.predict_ridge(validation, lm.ridge(train, lags))
    per_series = (
        fc.fixed_origin(events, t.event_days.first, t.event_days.cut)
        .join(fc.croston(events, t.event_days.first, t.event_days.cut), keys)
        .join(_sbc(t).select(*keys, "demand_category"), keys)
    )
    return fc.route(validation.join(per_series, keys))


_ROUTE = f"{_EVENTS} SELECT date_, product_id, city_name, demand_category, ROUND(pred_hybrid, 6) AS pred_hybrid FROM res"


@query("fct16_hybrid_route", _ROUTE)
def _(t):
    rows = fixed_results(t).withColumn("pred_hybrid", F.round("pred_hybrid", 6))
    return rows.select("date_", "product_id", "city_name", "demand_category", "pred_hybrid")


# The same rows, with the model fitted and routed here step by step.
@query("fct16_fitted_route", _ROUTE)
def _(t):
    events, days, keys, lags = t.event_panel, t.event_days, ["product_id", "city_name"], ["lag_1", "lag_7"]
    lagged = f.add_lags(f.calendar_grid(events, days.first, days.last), [1, 7]).fillna(0.0, lags)
    train, validation = f.split_by_date(lagged, days.cut)
    rows = lm.predict_ridge(validation, lm.ridge(train, lags))
    per_series = fc.croston(events, days.first, days.cut).join(_sbc(t).select(*keys, "demand_category"), keys)
    routed = fc.route(rows.join(per_series, keys)).withColumn("pred_hybrid", F.round("pred_hybrid", 6))
    return routed.select("date_", "product_id", "city_name", "demand_category", "pred_hybrid")


@query(
    "fct17_clip",
    f"""WITH {RESULTS} SELECT {_ID}, ROUND(greatest(pred_naive_lag1 - pred_ma_7, 0.0), 6) AS pred_clipped FROM results""",
)
def _(t):
    raw = F.col("pred_naive_lag1") - F.col("pred_ma_7")
    return baselines(t).select(*_IDS, F.round(fc.clip0(raw), 6).alias("pred_clipped"))


def _metric(pred: str, label: str, source: str, where: str = "", extra: str = "") -> str:
    label = label.replace("'", "''")
    return f"""SELECT {extra} '{label}' AS model, ROUND(AVG(ABS(daily_quantity - {pred})), 4) AS mae, ROUND(SQRT(AVG(POW(daily_quantity - {pred}, 2))), 4) AS rmse,
      ROUND(CASE WHEN SUM(daily_quantity) > 0 THEN SUM(ABS(daily_quantity - {pred})) / SUM(daily_quantity) * 100 ELSE 0.0 END, 2) AS wape_pct,
      ROUND(COALESCE(AVG({pred}) FILTER (daily_quantity = 0), 0.0), 4) AS zero_days_overprediction FROM {source} {where}"""


_METRICS = " UNION ALL ".join(_metric(p, label, "results") for p, label in BASELINES.items())


@query("fct18_evaluate", f"WITH {RESULTS} SELECT model, mae, rmse, wape_pct FROM ({_METRICS})")
def _(t):
    return fc.evaluate(baselines(t), BASELINES).drop("zero_days_overprediction")


_FIXED_METRICS = " UNION ALL ".join(_metric(p, label, "res") for p, label in FIXED_MODELS.items())


@query("fct19_zero_day_bias", f"{_EVENTS} SELECT model, zero_days_overprediction FROM ({_FIXED_METRICS})")
def _(t):
    return fc.evaluate(fixed_results(t), FIXED_MODELS).select("model", "zero_days_overprediction")


_SEGMENTS = {
    "All SKUs": "TRUE",
    "Intermittent & Lumpy SKUs (ADI >= 1.32)": "demand_category IN ('Intermittent', 'Lumpy')",
    "Smooth SKUs (Fast-Moving)": "demand_category = 'Smooth'",
}


@query(
    "fct20_evaluate_by_segment",
    f"{_EVENTS} "
    + " UNION ALL ".join(
        _metric(p, label, "res", f"WHERE {cond} GROUP BY 1", f"'{seg}' AS segment,")
        for seg, cond in _SEGMENTS.items()
        for p, label in FIXED_MODELS.items()
    ),
)
def _(t):
    return fc.evaluate_by(fixed_results(t), FIXED_MODELS, {name: F.expr(c) for name, c in _SEGMENTS.items()})


_SBA = FIXED_MODELS["pred_sba"]


@query(
    "fct21_improvement",
    f"""{_EVENTS}, m AS ({_FIXED_METRICS}), a AS (SELECT * FROM m WHERE model = '{_SBA}')
    SELECT a.model, m.model AS against, ROUND((m.wape_pct - a.wape_pct) / m.wape_pct * 100, 2) AS wape_improvement_pct,
    ROUND(CASE WHEN m.zero_days_overprediction > 0 THEN (m.zero_days_overprediction - a.zero_days_overprediction) / m.zero_days_overprediction * 100 ELSE 0.0 END, 2)
      AS bias_reduction_pct FROM m, a WHERE m.model IN ('Naive (Lag-1)', 'Moving Average (7 Days)')""",
)
def _(t):
    metrics = fc.evaluate(fixed_results(t), FIXED_MODELS)
    return fc.improvement(metrics, _SBA, ["Naive (Lag-1)", "Moving Average (7 Days)"])


_BREAK = """COUNT(*) AS row_count, ROUND(SUM(ABS(daily_quantity - pred_ma_7)), 4) AS abs_error, ROUND(SUM(daily_quantity), 4) AS actual_total,
  ROUND(AVG(ABS(daily_quantity - pred_ma_7)), 4) AS mae,
  ROUND(CASE WHEN SUM(daily_quantity) > 0 THEN SUM(ABS(daily_quantity - pred_ma_7)) / SUM(daily_quantity) * 100 ELSE 0.0 END, 2) AS wape_pct"""


@query("fct22_error_by_city", f"WITH {RESULTS} SELECT city_name, {_BREAK} FROM results GROUP BY 1")
def _(t):
    return fc.error_breakdown(baselines(t), "pred_ma_7", ["city_name"])


@query(
    "fct22_error_by_sparsity",
    f"""WITH {RESULTS}, r AS (SELECT product_id, city_name, CASE WHEN COUNT(*) FILTER (daily_quantity > 0) / 366 >= 0.5 THEN 'Regular' ELSE 'Sparse' END AS sparsity
      FROM grid GROUP BY 1, 2)
    SELECT sparsity, {_BREAK} FROM results JOIN r USING (product_id, city_name) GROUP BY 1""",
)
def _(t):
    days = F.count_if(F.col("daily_quantity") > 0) / 366
    classes = t.panel.groupBy("product_id", "city_name").agg(F.when(days >= 0.5, "Regular").otherwise("Sparse").alias("sparsity"))
    rows = baselines(t).join(classes, ["product_id", "city_name"])
    return fc.error_breakdown(rows, "pred_ma_7", ["sparsity"])


@query(
    "fct22_worst_series",
    f"""WITH {RESULTS} SELECT product_id, city_name, {_BREAK} FROM results GROUP BY 1, 2 ORDER BY abs_error DESC, product_id, city_name LIMIT 10""",
)
def _(t):
    return fc.worst_series(baselines(t), "pred_ma_7", 10)


_PUBLISHED = "SELECT model, mae + 1 AS mae, rmse + 1 AS rmse, wape_pct + 1 AS wape_pct FROM m WHERE model LIKE 'Moving%' OR model LIKE 'Naive%'"


@query(
    "fct23_model_comparison",
    f"""WITH {RESULTS}, m AS ({_METRICS}), cur AS ({_PUBLISHED}), new AS (SELECT model, mae, rmse, wape_pct FROM m WHERE model NOT LIKE 'Naive%'),
    u AS (SELECT * FROM new UNION ALL SELECT * FROM cur WHERE model NOT IN (SELECT model FROM new))
    SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY wape_pct, model) AS INTEGER) AS place, ROW_NUMBER() OVER (ORDER BY wape_pct, model) = 1 AS is_best FROM u""",
)
def _(t):
    metrics = fc.evaluate(baselines(t), BASELINES).drop("zero_days_overprediction")
    published = metrics.where("model like 'Moving%' or model like 'Naive%'").withColumns(
        {c: F.col(c) + 1 for c in ["mae", "rmse", "wape_pct"]}
    )
    return fc.model_comparison(published, metrics.where("model not like 'Naive%'"))


@query(
    "fct24_enrich_results",
    f"""WITH {RESULTS} SELECT date_, product_id, city_name, daily_quantity, pred_naive_lag1, CASE WHEN city_name <> 'ASIA' THEN ROUND(pred_ma_7, 6) END AS pred_hybrid FROM results""",
)
def _(t):
    rows = baselines(t)
    new = rows.where("city_name <> 'ASIA'").select(
        F.col("date_").cast("string").alias("date_"), "product_id", "city_name", F.round("pred_ma_7", 6).alias("pred_hybrid")
    )
    return fc.enrich_results(rows.select(*_IDS, "pred_naive_lag1"), new)


@query(
    "fct25_forecast_horizon",
    f"""WITH {GRID}, r AS (SELECT product_id, city_name, AVG(daily_quantity) AS l, STDDEV_SAMP(daily_quantity) AS s FROM grid
      WHERE date_ < {CUT_DAY} AND date_ >= {CUT_DAY} - 28 GROUP BY 1, 2)
    SELECT product_id, city_name, CAST(d AS DATE) AS forecast_date, ROUND(l, 4) AS yhat, ROUND(greatest(0.0, l - 1.96 * s), 4) AS yhat_lower,
    ROUND(l + 1.96 * s, 4) AS yhat_upper, TRUE AS is_future FROM r CROSS JOIN (SELECT UNNEST(generate_series({CUT_DAY}, {CUT_DAY} + 13, INTERVAL 1 DAY)) AS d) t""",
)
def _(t):
    return fc.forecast_horizon(t.panel, t.days.cut, 14)


# The fitted lag model rolled forward, with conformal limits from the tuning period.
@query("fct25_recursive_horizon")
def _(t):
    days = 14
    grid_rows = panel_grid(t)
    model = horizon.fit_lag_model(grid_rows, t.days.tune)
    calibrate = str(date.fromisoformat(t.days.tune) - timedelta(days=60))
    widths = horizon.conformal_widths(grid_rows, model, calibrate, t.days.cut, days)
    rows = horizon.recursive_horizon(t.panel, model, widths, t.days.cut)
    return rows.withColumns({c: F.round(c, 4) for c in ("yhat", "yhat_lower", "yhat_upper")})


@query(
    "fct26_eligibility",
    f"""WITH {EVENT_PANEL}, a AS (SELECT product_id, city_name, COUNT(*) FILTER (date_ >= {EVENT_FIRST} AND date_ < {EVENT_CUT} AND daily_quantity > 0) AS active_days
      FROM event_panel GROUP BY 1, 2)
    SELECT *, CASE WHEN active_days >= 7 THEN 'OK' ELSE 'INSUFFICIENT_HISTORY' END AS forecast_status FROM a""",
)
def _(t):
    return fc.eligibility(t.event_panel, t.event_days.first, t.event_days.cut, 7)


@query(
    "fct27_forecast_results",
    f"""WITH {RESULTS} SELECT {_ID}, pred_naive_lag1 FROM results WHERE lower(city_name) = 'europe' ORDER BY date_ DESC, product_id, city_name LIMIT 40""",
)
def _(t):
    return fc.forecast_results(baselines(t).select(*_IDS, "pred_naive_lag1"), city="Europe", limit=40)


@query(
    "fct28_model_family",
    f"""WITH {RESULTS}, m AS ({_METRICS}) SELECT model, CASE WHEN model LIKE '%Ensemble%' OR model LIKE '%Stacking%' THEN 'Meta-Ensemble'
    WHEN model LIKE '%XGBoost%' OR model LIKE '%LightGBM%' OR model LIKE '%HistGradient%' THEN 'Gradient Boosted Trees' WHEN model LIKE '%Prophet%' THEN 'Additive Seasonality'
    WHEN model LIKE '%Moving Average%' THEN 'Time-Series Heuristic' WHEN model LIKE '%Ridge%' THEN 'Linear Regularized' ELSE 'Statistical Baseline' END AS family FROM m""",
)
def _(t):
    return fc.model_family(fc.evaluate(baselines(t), BASELINES).select("model"))


@query(
    "agg37_actual_vs_forecast",
    f"""WITH {RESULTS} SELECT date_, SUM(daily_quantity) AS actual, {', '.join(f'ROUND(SUM({p}), 4) AS {p}' for p in BASELINES)}
    FROM results WHERE lower(city_name) = 'asia' GROUP BY 1""",
)
def _(t):
    return demand.actual_vs_forecast(baselines(t), city="Asia")
