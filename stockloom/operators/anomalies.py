"""Demand anomalies: rolling z-score, forest outliers, severity and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.scalars import equals_ignore_case
from stockloom.schemas import GRAIN, SERIES_KEY

# Forecast columns in order of preference.
EXPECTED_ORDER = [
    "pred_hybrid", "pred_ensemble", "pred_lgb", "pred_xgb", "pred_hist_gbt",
    "pred_prophet", "pred_ridge", "pred_sba", "pred_ma_7",
]
SPIKE, DROP, PRICE = "SPIKE_DEMAND", "DROP_STOCKOUT", "PRICE_ANOMALY"
SEVERITIES = ["CRITICAL", "MEDIUM", "LOW"]
# Suggested action per anomaly type.
ACTIONS = {
    SPIKE: "Review inventory availability and prepare replenishment.",
    DROP: "Check inventory, stock availability, and delivery/supply status.",
    PRICE: "Review recent price or discount changes.",
}
DEFAULT_ACTION = "Investigate demand deviation against operational baseline."


def pick_expected(forecast: DataFrame, preferred: str = "pred_hist_gbt") -> str:
    """The forecast column to compare with (metadata only)."""
    for column in [preferred, *EXPECTED_ORDER]:
        if column in forecast.columns:
            return column
    raise KeyError(f"no forecast column among {forecast.columns}")


def baseline(demand: DataFrame, n: int = 14) -> DataFrame:
    """Mean, deviation and count of the ``n`` rows before each day."""
    before = Window.partitionBy(*SERIES_KEY).orderBy("date_").rowsBetween(-n, -1)
    q = F.col("daily_quantity")
    return demand.select(
        *GRAIN,
        q.cast("double").alias("actual_demand"),
        F.avg(q).over(before).alias("rolling_mean_14"),
        F.coalesce(F.stddev_samp(q).over(before), F.lit(0.0)).alias("rolling_std_14"),
        F.count(q).over(before).alias("history_count"),
    )


def join_baseline(forecast: DataFrame, history: DataFrame, expected: str) -> DataFrame:
    """Forecast rows with their baseline; rows without a partner drop out."""
    wanted = forecast.select(*GRAIN, F.col(expected).cast("double").alias("expected_demand"))
    return wanted.join(history, GRAIN)


def match_stats(forecast: DataFrame, demand: DataFrame) -> DataFrame:
    """Matched rows and leftovers of both sides."""
    f = forecast.select(*GRAIN).withColumn("_f", F.lit(True))
    d = demand.select(*GRAIN).withColumn("_d", F.lit(True))
    return f.join(d, GRAIN, "full").agg(
        F.count_if(F.col("_f").isNotNull() & F.col("_d").isNotNull()).alias("matched"),
        F.count_if(F.col("_d").isNull()).alias("unmatched_forecast"),
        F.count_if(F.col("_f").isNull()).alias("unmatched_demand"),
    )


def residual_features(df: DataFrame) -> DataFrame:
    """Residual, relative residual, volatility and volume."""
    actual, expected = F.coalesce("actual_demand", F.lit(0.0)), F.coalesce("expected_demand", F.lit(0.0))
    df = df.withColumns({"actual_demand": actual, "expected_demand": expected})
    residual = F.col("actual_demand") - F.col("expected_demand")
    relative = (
        F.when(F.col("expected_demand") > 0, residual / F.col("expected_demand"))
        .when(F.col("actual_demand") > 0, 1.0)
        .otherwise(0.0)
    )
    return df.withColumns(
        {
            "residual": residual,
            "relative_residual": relative,
            "rolling_volatility": F.coalesce("rolling_std_14", F.lit(0.0)),
            "sales_volume": F.col("actual_demand"),
        }
    )


def zscore(df: DataFrame, threshold: float = 2.5, min_history: int = 7) -> DataFrame:
    """Distance from the rolling mean in deviations.

    After constant demand the jump is measured against the mean and capped at
    5; with too little history the score is 0.
    """
    gap = F.col("actual_demand") - F.col("rolling_mean_14")
    flat = F.signum(gap) * F.least(F.abs(gap) / (F.col("rolling_mean_14") + 1.0), F.lit(5.0))
    enough = F.col("history_count") >= min_history
    z = (
        F.when(enough & (F.col("rolling_volatility") > 1e-6), gap / F.col("rolling_volatility"))
        .when(enough, flat)
        .otherwise(0.0)
    )
    return df.withColumn("z_score", F.bround(z, 4)).withColumn("is_zscore_anomaly", F.abs("z_score") > threshold)


def classify(df: DataFrame, threshold: float = 2.5) -> DataFrame:
    """Keep rows that either method flags and name the direction."""
    spike = (F.col("residual") > 0) | (F.col("z_score") > threshold)
    return df.where(F.col("is_zscore_anomaly") | F.col("is_isolation_anomaly")).withColumn(
        "anomaly_type", F.when(spike, F.lit(SPIKE)).otherwise(F.lit(DROP))
    )


def severity(df: DataFrame) -> DataFrame:
    """First matching rule decides: critical, medium, else low."""
    z, gap = F.abs("z_score"), F.abs("residual")
    actual, expected = F.col("actual_demand"), F.col("expected_demand")
    both = F.col("is_zscore_anomaly") & F.col("is_isolation_anomaly")
    critical = (
        (z >= 4.0)
        | (both & (gap >= 100.0) & (z >= 3.0))
        | ((actual <= 10.0) & (expected >= 150.0))
        | ((F.col("residual") >= 300.0) & (z >= 3.5))
    )
    medium = (
        (z >= 2.8)
        | (F.col("is_isolation_anomaly") & (gap >= 75.0))
        | ((actual < 0.3 * expected) & (expected >= 100.0))
    )
    return df.withColumn("severity", F.when(critical, "CRITICAL").when(medium, "MEDIUM").otherwise("LOW"))


def recommend(df: DataFrame) -> DataFrame:
    actions = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return df.withColumn(
        "action_recommendation", F.coalesce(actions[F.col("anomaly_type")], F.lit(DEFAULT_ACTION))
    )


def severity_rank(c: Column | str = "severity") -> Column:
    name = F.col(c) if isinstance(c, str) else c
    rank = F.lit(len(SEVERITIES))
    for i, level in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(name == level, i).otherwise(rank)
    return rank


def export_anomalies(df: DataFrame) -> DataFrame:
    """The delivered table: one row per day and series, most severe first."""
    table = df.select(
        "date_",
        F.col("product_id").cast("string").alias("product_id"),
        "city_name",
        F.bround("actual_demand", 2).alias("actual_demand"),
        F.bround("expected_demand", 2).alias("expected_demand"),
        F.bround("anomaly_score", 4).alias("anomaly_score"),
        "anomaly_type",
        "severity",
        "action_recommendation",
    )
    others = [c for c in table.columns if c not in GRAIN]
    best = F.min_by(F.struct(*others), F.struct(severity_rank(), -F.col("anomaly_score")))
    unique = table.groupBy(*GRAIN).agg(best.alias("_row")).select(*GRAIN, "_row.*").select(*table.columns)
    return unique.orderBy(severity_rank(), F.desc("date_"), "product_id", "city_name")


def anomaly_stats(df: DataFrame) -> DataFrame:
    """Counts per type and severity of a run."""

    def n(column, value):
        return F.count_if(F.col(column) == value)

    return df.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        n("anomaly_type", SPIKE).alias("spike_count"),
        n("anomaly_type", DROP).alias("drop_count"),
        n("anomaly_type", PRICE).alias("price_count"),
        *[n("severity", level).alias(f"{level.lower()}_count") for level in SEVERITIES],
    )


def list_alerts(
    alerts: DataFrame,
    level: str | None = "CRITICAL",
    city: str | None = None,
    product_id=None,
    anomaly_type: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """Newest alerts that pass the filters, strongest first within a day."""
    rows = alerts.where(
        equals_ignore_case("severity", level)
        & equals_ignore_case("city_name", city)
        & equals_ignore_case("anomaly_type", anomaly_type)
    )
    if product_id is not None:
        rows = rows.where(F.col("product_id").cast("string") == str(product_id).strip())
    return rows.orderBy(F.desc("date_"), F.desc("anomaly_score"), *SERIES_KEY).limit(limit)


def alert_score(alerts: DataFrame) -> DataFrame:
    """Deviation of a stored alert relative to what was expected."""
    expected = F.coalesce("expected_demand", "actual_demand")
    score = F.abs(F.col("actual_demand") - expected) / F.greatest(F.lit(1.0), expected)
    return alerts.withColumn("alert_score", F.bround(score, 4))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Alert counts by severity and kind with the covered dates."""
    kind = F.col("anomaly_type")
    return alerts.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        *[F.count_if(F.col("severity") == level).alias(level.lower()) for level in SEVERITIES],
        F.count_if(kind.like("%SPIKE%")).alias("spike_demand"),
        F.count_if(kind.like("%DROP%")).alias("drop_stockout"),
        F.count_if(kind.like("%PRICE%")).alias("price_anomaly"),
        F.min("date_").alias("earliest_date"),
        F.max("date_").alias("latest_date"),
    )


def deviation(alerts: DataFrame) -> DataFrame:
    """Deviation from the expectation, absolute and in percent."""
    gap, expected = F.col("actual_demand") - F.col("expected_demand"), F.col("expected_demand")
    return alerts.withColumns(
        {
            "deviation": F.bround(gap, 1),
            "deviation_pct": F.bround(F.when(expected != 0, gap / expected * 100).otherwise(0.0), 1),
        }
    )
