"""End-to-end jobs: each returns its result tables by name, all lazy.

``write_outputs`` stores them; stages that several outputs share are written
once to the scratch area and read from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.operators import anomalies as an
from stockloom.operators import boosted, cleaning, demand, features, forecasting, inventory, isolation, segments, validation
from stockloom.operators import linear_models as lm
from stockloom.schemas import GRAIN, SERIES_KEY
from stockloom.session import materialize
from stockloom.sources.sinks import write_table

Outputs = dict[str, DataFrame]


def write_outputs(outputs: Outputs, target: str, fmt: str = "parquet") -> None:
    for name, df in outputs.items():
        write_table(df, f"{target.rstrip('/')}/{name}", fmt)


def upload_job(raw: DataFrame, products: DataFrame) -> Outputs:
    """Validate an uploaded text table and split it."""
    validated = materialize(validation.validate_rows(raw, products))
    good, bad = validation.split_valid(validated)
    return {
        "accepted": good,
        "rejected": bad,
        "error_counts": validation.error_counts(validated),
        "checks": validation.check_summary(validated),
        "job": validation.job_status(validated),
        "unmatched_products": validation.unmatched_sample(validated),
    }


def cleaning_job(sales: DataFrame, products: DataFrame) -> Outputs:
    """Recover costs, attach products, aggregate to daily demand."""
    lookup = materialize(cleaning.cost_recovery_lookup(sales))
    filled = cleaning.apply_cost_recovery(sales, lookup)
    return {
        "cost_lookup": lookup,
        "cost_tiers": cleaning.recovery_summary(lookup),
        "sales_master": cleaning.enrich(filled, products),
        "daily_demand": demand.named_daily_demand(sales, products),
    }


def profile_job(sales: DataFrame, products: DataFrame, first: str, last: str) -> Outputs:
    """Business figures and product segments."""
    segmented = materialize(segments.segment(segments.product_stats(sales, first, last)))
    curve = demand.pareto(sales)
    return {
        "overview": demand.overview(sales, products),
        "cities": demand.city_kpis(sales),
        "categories": demand.category_kpis(sales, products),
        "daily": demand.daily_trend(sales),
        "prices": demand.price_discount_stats(sales),
        "concentration": demand.concentration(curve),
        "segments": segmented,
        "segment_summary": segments.segment_summary(segmented),
    }


# Prediction columns of the forecast job and their model names.
MODELS = {
    "pred_naive_lag1": "Naive (Lag-1)",
    "pred_seasonal_naive_lag7": "Seasonal Naive (Lag-7)",
    "pred_ma_7": "Moving Average (7 Days)",
    "pred_ma_14": "Moving Average (14 Days)",
    "pred_ma_28": "Moving Average (28 Days)",
    "pred_prophet": "Prophet (Weekly Seasonality)",
    "pred_ridge": "Ridge Regression",
    "pred_hist_gbt": "HistGradientBoosting (GBT)",
    "pred_croston": "Croston's Method (Classic)",
    "pred_sba": "SBA (Syntetos-Boylan)",
    "pred_hybrid": "Hybrid (ML Head + SBA Tail)",
}


def forecast_job(daily: DataFrame, first: str, cut: str, last: str, boost: bool = True) -> Outputs:
    """Features, all models on data before ``cut``, scores on the days after."""
    rows = materialize(features.feature_frame(features.calendar_grid(daily, first, last)))
    train, validation_rows = features.split_by_date(rows, cut)
    results = forecasting.moving_average(forecasting.seasonal_naive(forecasting.naive(validation_rows)))
    results = lm.additive_seasonal(train, results, first)
    results = lm.predict_ridge(results, lm.ridge(train, features.FEATURES))
    models = dict(MODELS)
    if boost:
        results = boosted.gbt(train, features.FEATURES).predict(results)
    else:
        models.pop("pred_hist_gbt")
    classes = forecasting.sbc_classify(daily, first, cut)
    rates = forecasting.croston(daily, first, cut)
    results = results.join(rates, SERIES_KEY, "left").join(
        classes.select(*SERIES_KEY, "demand_category"), SERIES_KEY, "left"
    )
    results = materialize(
        forecasting.route(results).select(*GRAIN, "daily_quantity", "demand_category", *models)
    )
    metrics = forecasting.evaluate(results, models)
    sporadic = F.col("demand_category").isin("Intermittent", "Lumpy")
    return {
        "forecast_results": results,
        "model_comparison": forecasting.model_comparison(metrics.limit(0), metrics),
        "segment_metrics": forecasting.evaluate_by(
            results,
            models,
            {"All": F.lit(True), "Sporadic": sporadic, "Smooth": F.col("demand_category") == "Smooth"},
        ),
        "demand_classes": classes,
        "horizon": forecasting.forecast_horizon(daily, cut, 14),
    }


def anomaly_job(daily: DataFrame, forecast: DataFrame, contamination: float = 0.03) -> Outputs:
    """Z-score and forest outliers with severity and action."""
    expected = an.pick_expected(forecast)
    joined = an.join_baseline(forecast, an.baseline(daily), expected)
    scored = an.zscore(an.residual_features(joined))
    flagged = isolation.isolation_forest(
        scored, ["residual", "rolling_volatility", "sales_volume"], GRAIN, contamination
    )
    alerts = materialize(an.export_anomalies(an.recommend(an.severity(an.classify(flagged)))))
    return {"demand_anomalies": alerts, "statistics": an.anomaly_stats(alerts), "summary": an.alert_summary(alerts)}


def inventory_job(
    daily: DataFrame, costs: DataFrame | None, stock: DataFrame, first: str, last: str, lead_time: int = 3
) -> Outputs:
    """Policy per series and order recommendations for the current stock."""
    policy = inventory.inventory_policy(inventory.demand_params(daily, first, last), costs, lead_time)
    orders = inventory.recommend_orders(policy, stock)
    return {
        "policy": policy,
        "recommendations": demand.order_cost(orders),
        "excess_stock": demand.excess_value(orders).where("excess_quantity > 0"),
    }
