"""Baselines, intermittent-demand methods, horizons and model evaluation.

Everything that depends only on the days with sales is computed from the
sparse daily demand and the period limits; no calendar grid is built for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.scalars import clip0, equals_ignore_case
from stockloom.schemas import GRAIN, SERIES_KEY

# Cut-offs of the demand classes (interval, squared variation).
ADI_CUT, CV2_CUT = 1.32, 0.49


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def _train_days(first: str, cut: str) -> Column:
    return F.datediff(_day(cut), _day(first))


def _in_train(first: str, cut: str) -> Column:
    return (F.col("date_") >= _day(first)) & (F.col("date_") < _day(cut))


# ---- baselines ------------------------------------------------------------


def naive(features: DataFrame) -> DataFrame:
    return features.withColumn("pred_naive_lag1", clip0("lag_1"))


def seasonal_naive(features: DataFrame) -> DataFrame:
    return features.withColumn("pred_seasonal_naive_lag7", clip0("lag_7"))


def moving_average(features: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    return features.withColumns({f"pred_ma_{n}": clip0(f"rolling_mean_{n}") for n in sizes or [7, 14, 28]})


def seasonal_proxy(features: DataFrame) -> DataFrame:
    blend = F.col("lag_7") * 0.9 + F.col("rolling_mean_7") * 0.1
    return features.withColumn("pred_prophet", clip0(blend))


def fixed_origin(demand: DataFrame, first: str, cut: str, keys: list[str] = SERIES_KEY) -> DataFrame:
    """Last value, mean of the last 7 days and overall mean at the cut, per series."""
    days = _train_days(first, cut)
    train = _in_train(first, cut)
    q = F.col("daily_quantity")

    def total(condition):
        return F.coalesce(F.sum(F.when(train & condition, q)), F.lit(0.0))

    last_days = F.least(F.lit(7), days)
    return demand.groupBy(*keys).agg(
        total(F.col("date_") == F.date_sub(_day(cut), 1)).alias("pred_naive"),
        (total(F.col("date_") >= F.date_sub(_day(cut), 7)) / last_days).alias("pred_ma7"),
        (total(F.lit(True)) / days).alias("pred_mean"),
    )


# ---- intermittent demand --------------------------------------------------


def sbc_classify(
    demand: DataFrame, first: str, cut: str, keys: list[str] = SERIES_KEY, mean_digits: int = 2
) -> DataFrame:
    """Demand class of each series by interval between sales and size variation.

    A series without sales before the cut counts as intermittent.
    """
    days = _train_days(first, cut)
    sold = F.when(_in_train(first, cut) & (F.col("daily_quantity") > 0), F.col("daily_quantity"))
    stats = demand.groupBy(*keys).agg(
        F.count(sold).alias("n"), F.avg(sold).alias("mean"), F.stddev_pop(sold).alias("std"), F.sum(sold).alias("total")
    )
    none = F.col("n") == 0
    adi = F.when(none, days.cast("double")).otherwise(days / F.col("n"))
    cv2 = F.when(none, F.lit(0.0)).otherwise(F.pow(F.col("std") / F.col("mean"), 2))
    smooth_sizes, frequent = cv2 < CV2_CUT, adi < ADI_CUT
    return stats.select(
        *keys,
        days.cast("bigint").alias("total_periods"),
        F.col("n").alias("active_sales_days"),
        F.round((days - F.col("n")) / days * 100, 2).alias("zero_sales_pct"),
        F.round(adi, 3).alias("adi"),
        F.round(cv2, 3).alias("cv2"),
        F.round(F.coalesce("mean", F.lit(0.0)), mean_digits).alias("mean_non_zero_demand"),
        F.round(F.coalesce("total", F.lit(0.0)) / days, mean_digits).alias("overall_mean_daily_demand"),
        F.when(none, "Intermittent")
        .when(frequent & smooth_sizes, "Smooth")
        .when(smooth_sizes, "Intermittent")
        .when(frequent, "Erratic")
        .otherwise("Lumpy")
        .alias("demand_category"),
    )


def sbc_summary(classes: DataFrame) -> DataFrame:
    """Series per class; at most four rows, so the share uses a plain window."""
    everything = Window.partitionBy(F.lit(0))
    counts = classes.groupBy("demand_category").agg(F.count(F.lit(1)).alias("series"))
    return counts.withColumn("share_pct", F.round(F.col("series") / F.sum("series").over(everything) * 100, 1))


def croston(demand: DataFrame, first: str, cut: str, alpha: float = 0.1, keys: list[str] = SERIES_KEY) -> DataFrame:
    """Croston's rate and its bias-corrected form (SBA) per series.

    Exponential smoothing from the first sale on is a weighted sum: with m
    sales the j-th newest of the later ones weighs alpha (1-alpha)^(j-1) and
    the first sale (1-alpha)^(m-1).  Sizes and intervals are smoothed alike,
    so one window over the sale days of a series and one aggregation do it.
    """
    decay = 1.0 - alpha
    sales = demand.where(_in_train(first, cut) & (F.col("daily_quantity") > 0))
    oldest = Window.partitionBy(*keys).orderBy("date_")
    newest = Window.partitionBy(*keys).orderBy(F.desc("date_"))
    from_start = F.datediff("date_", _day(first)) + 1
    weighted = sales.withColumns(
        {
            "_interval": F.coalesce(F.datediff("date_", F.lag("date_").over(oldest)), from_start),
            "_first": F.lag("date_").over(oldest).isNull(),
            "_age": F.row_number().over(newest) - 1,
        }
    ).withColumn("_w", F.pow(F.lit(decay), F.col("_age")) * F.when(F.col("_first"), 1.0).otherwise(alpha))
    rates = weighted.groupBy(*keys).agg(
        (F.sum(F.col("_w") * F.col("daily_quantity")) / F.sum(F.col("_w") * F.col("_interval"))).alias("_rate")
    )
    every = demand.select(*keys).distinct().join(rates, keys, "left")
    rate = clip0(F.coalesce("_rate", F.lit(0.0)))
    return every.select(*keys, rate.alias("pred_croston"), (rate * (1 - alpha / 2)).alias("pred_sba"))


def route(df: DataFrame, machine: str = "pred_ridge", tail: str = "pred_sba") -> DataFrame:
    """Frequent demand takes the learned forecast, sporadic demand the SBA rate."""
    frequent = F.col("demand_category").isin("Smooth", "Erratic")
    return df.withColumn("pred_hybrid", F.when(frequent, F.col(machine)).otherwise(F.col(tail)))


# ---- evaluation -----------------------------------------------------------


def _metrics(actual: str, pred: str, label: str) -> Column:
    """All metrics of one prediction column as an aggregate struct."""
    y, p = F.col(actual), clip0(pred)
    error, total = F.abs(y - p), F.sum(y)
    return F.struct(
        F.lit(label).alias("model"),
        F.round(F.avg(error), 4).alias("mae"),
        F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
        F.round(F.when(total > 0, F.sum(error) / total * 100).otherwise(0.0), 2).alias("wape_pct"),
        F.round(F.coalesce(F.avg(F.when(y == 0, p)), F.lit(0.0)), 4).alias("zero_days_overprediction"),
    )


def evaluate(df: DataFrame, preds: dict[str, str], actual: str = "daily_quantity", by: list[str] | None = None) -> DataFrame:
    """Error metrics per model, all models in one pass over the rows.

    ``preds`` maps prediction columns to model names.
    """
    keys = by or []
    wide = df.groupBy(*keys).agg(*[_metrics(actual, c, label).alias(f"m{i}") for i, (c, label) in enumerate(preds.items())])
    return wide.select(*keys, F.inline(F.array(*[f"m{i}" for i in range(len(preds))])))


def evaluate_by(
    df: DataFrame, preds: dict[str, str], segments: dict[str, Column], actual: str = "daily_quantity"
) -> DataFrame:
    """Metrics per model and per (possibly overlapping) segment."""
    labels = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in segments.items()]))
    return evaluate(df.withColumn("segment", F.explode(labels)), preds, actual, ["segment"])


def improvement(metrics: DataFrame, model: str, against: list[str]) -> DataFrame:
    """WAPE improvement and zero-day bias reduction of ``model`` in percent."""

    def value(name: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == name, F.col(column)))

    rows = []
    for i, base in enumerate(against):
        wape, bias = value(base, "wape_pct"), value(base, "zero_days_overprediction")
        rows.append(
            F.struct(
                F.lit(model).alias("model"),
                F.lit(base).alias("against"),
                F.round(F.when(wape > 0, (wape - value(model, "wape_pct")) / wape * 100), 2).alias("wape_improvement_pct"),
                F.round(
                    F.when(bias > 0, (bias - value(model, "zero_days_overprediction")) / bias * 100).otherwise(0.0), 2
                ).alias("bias_reduction_pct"),
            ).alias(f"r{i}")
        )
    return metrics.agg(*rows).select(F.inline(F.array(*[f"r{i}" for i in range(len(against))])))


def error_breakdown(df: DataFrame, pred: str, by: list[str], actual: str = "daily_quantity") -> DataFrame:
    """Absolute error, actual volume and WAPE per city, class or series."""
    error = F.abs(F.col(actual) - clip0(pred))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.round(F.sum(error), 4).alias("abs_error"),
        F.round(F.sum(actual), 4).alias("actual_total"),
        F.round(F.avg(error), 4).alias("mae"),
        F.round(F.when(F.sum(actual) > 0, F.sum(error) / F.sum(actual) * 100).otherwise(0.0), 2).alias("wape_pct"),
    )


def worst_series(df: DataFrame, pred: str, n: int = 10) -> DataFrame:
    return error_breakdown(df, pred, SERIES_KEY).orderBy(F.desc("abs_error"), *SERIES_KEY).limit(n)


def model_comparison(current: DataFrame, new: DataFrame) -> DataFrame:
    """Comparison table with new rows replacing those of the same model.

    A handful of models, so ranking uses a plain window.
    """
    merged = current.join(new.select("model"), "model", "left_anti").unionByName(new)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("wape_pct", "model"))
    return merged.withColumn("place", place).withColumn("is_best", F.col("place") == 1)


def enrich_results(results: DataFrame, new: DataFrame) -> DataFrame:
    """Add prediction columns to a results table, matched on the daily grain."""
    preds = [c for c in new.columns if c.startswith("pred_") and c not in results.columns]

    def normal(df: DataFrame) -> DataFrame:
        return df.withColumns({"date_": F.col("date_").cast("date"), "product_id": F.col("product_id").cast("string")})

    return normal(results).join(normal(new).select(*GRAIN, *preds), GRAIN, "left")


# ---- horizons and listings ------------------------------------------------


def eligibility(demand: DataFrame, first: str, cut: str, min_active_days: int, keys: list[str] = SERIES_KEY) -> DataFrame:
    """Which series have enough history to be forecast."""
    active = F.count_if(_in_train(first, cut) & (F.col("daily_quantity") > 0))
    return (
        demand.groupBy(*keys)
        .agg(active.alias("active_days"))
        .withColumn(
            "forecast_status",
            F.when(F.col("active_days") >= min_active_days, "OK").otherwise("INSUFFICIENT_HISTORY"),
        )
    )


def forecast_horizon(
    demand: DataFrame, cut: str, horizon: int, window: int = 28, z: float = 1.96, keys: list[str] = SERIES_KEY
) -> DataFrame:
    """Level forecast for the days from the cut on, with limits from the recent spread.

    Level and deviation cover the last ``window`` days including days without
    sales, which enter by arithmetic.
    """
    recent = (F.col("date_") < _day(cut)) & (F.col("date_") >= F.date_sub(_day(cut), window))
    q = F.when(recent, F.col("daily_quantity"))
    n, w = F.count(q), F.lit(window)
    mean_sold = F.coalesce(F.avg(q), F.lit(0.0))
    spread = F.coalesce(F.var_pop(q), F.lit(0.0)) * n + mean_sold * mean_sold * n * (w - n) / w
    stats = demand.groupBy(*keys).agg(
        (F.coalesce(F.sum(q), F.lit(0.0)) / w).alias("_level"), F.sqrt(spread / (w - 1)).alias("_std")
    )
    days = F.sequence(_day(cut), F.date_add(_day(cut), horizon - 1))
    return stats.select(
        *keys,
        F.explode(days).alias("forecast_date"),
        F.round("_level", 4).alias("yhat"),
        F.round(F.greatest(F.lit(0.0), F.col("_level") - z * F.col("_std")), 4).alias("yhat_lower"),
        F.round(F.col("_level") + z * F.col("_std"), 4).alias("yhat_upper"),
        F.lit(True).alias("is_future"),
    )


def forecast_results(results: DataFrame, product_id=None, city: str | None = None, limit: int = 100) -> DataFrame:
    """Newest forecast rows of a product and city."""
    rows = results.where(equals_ignore_case("city_name", city))
    if product_id is not None:
        rows = rows.where(F.col("product_id").cast("string") == str(product_id))
    return rows.orderBy(F.desc("date_"), *SERIES_KEY).limit(limit)


def model_family(df: DataFrame, column: str = "model") -> DataFrame:
    """Family label from words in the model name, first match wins."""
    # Words and their family.
    families = [
        (["Ensemble", "Stacking"], "Meta-Ensemble"),
        (["XGBoost", "LightGBM", "HistGradient"], "Gradient Boosted Trees"),
        (["Prophet"], "Additive Seasonality"),
        (["Moving Average"], "Time-Series Heuristic"),
        (["Ridge"], "Linear Regularized"),
    ]
    name = F.col(column)
    label = F.when(F.coalesce(name, F.lit("")) == "", F.lit("Model"))
    for words, family in families:
        label = label.when(reduce(lambda a, b: a | b, [name.contains(w) for w in words]), F.lit(family))
    return df.withColumn("family", label.otherwise(F.lit("Statistical Baseline")))
