"""Demand profile per product: volume, volatility, intermittency, segments.

Days without sales enter by arithmetic (number of days, sum and variance of
the active days), so no calendar grid is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.quantiles import quantile_values
from stockloom.operators.demand import abc_classify


def _daily(sales: DataFrame, value: str) -> DataFrame:
    return sales.groupBy("product_id", "date_").agg(F.sum(value).alias("_day"))


def _with_zeros(days: Column) -> dict[str, Column]:
    """Mean, sample deviation and cv over ``days`` days, most of them maybe zero."""
    m, mean, var = F.col("_m"), F.col("_mean"), F.col("_var")
    spread = var * m + mean * mean * m * (days - m) / days
    average = F.col("total_demand") / days
    std = F.when(days > 1, F.sqrt(spread / (days - 1)))
    return {
        "avg_daily_demand": average,
        "std_daily_demand": std,
        "cv": F.when(average > 0, std / average).otherwise(F.lit(0.0)),
    }


def _active_day_stats() -> list[Column]:
    return [
        F.sum("_day").alias("total_demand"),
        F.count(F.lit(1)).alias("_m"),
        F.avg("_day").alias("_mean"),
        F.var_pop("_day").alias("_var"),
        F.count_if(F.col("_day") > 0).alias("active_days"),
        F.count_if(F.col("_day") != 0).alias("_nonzero"),
    ]


def product_stats(sales: DataFrame, first: str, last: str, value: str = "procured_quantity") -> DataFrame:
    """Demand statistics of each product over one fixed calendar."""
    low, high = F.lit(first).cast("date"), F.lit(last).cast("date")
    days = F.datediff(high, low) + 1
    inside = _daily(sales, value).where(F.col("date_").between(low, high))
    stats = inside.groupBy("product_id").agg(*_active_day_stats())
    return stats.select(
        "product_id",
        "total_demand",
        *[c.alias(name) for name, c in _with_zeros(days).items()],
        "active_days",
        (days - F.col("_nonzero")).alias("zero_days"),
        (F.col("active_days") / days).alias("demand_day_ratio"),
    )


def product_stats_own_span(sales: DataFrame, value: str = "procured_quantity") -> DataFrame:
    """The same over each product's own first to last day."""
    stats = (
        _daily(sales.where(F.col("date_").isNotNull()), value)
        .groupBy("product_id")
        .agg(*_active_day_stats(), (F.datediff(F.max("date_"), F.min("date_")) + 1).alias("_days"))
    )
    days = F.col("_days")
    return stats.select(
        "product_id",
        "total_demand",
        *[c.alias(name) for name, c in _with_zeros(days).items()],
        F.col("active_days").alias("active_demand_days"),
        (days - F.col("_nonzero")).alias("zero_demand_days"),
    )


def volume_class(stats: DataFrame) -> DataFrame:
    """High from the upper quartile of mean demand on, Medium from the median on."""
    q = quantile_values(stats, "avg_daily_demand", {"p50": 0.5, "p75": 0.75})
    v = F.col("avg_daily_demand")
    return stats.withColumn(
        "demand_volume", F.when(v >= q["p75"], "High").when(v >= q["p50"], "Medium").otherwise("Low")
    )


def cv_class(low: str, middle: str, high: str, cv: Column | None = None) -> Column:
    c = F.col("cv") if cv is None else cv
    return F.when(c < 0.5, low).when(c < 1.0, middle).otherwise(high)


def volatility_class(stats: DataFrame) -> DataFrame:
    return stats.withColumn("volatility", cv_class("Stable", "Moderate", "Volatile"))


def pattern_class(stats: DataFrame) -> DataFrame:
    """How often the product sells at all."""
    r = F.col("demand_day_ratio")
    return stats.withColumn(
        "demand_pattern",
        F.when(r < 0.25, "Highly Intermittent").when(r < 0.50, "Intermittent").otherwise("Regular"),
    )


def segment(stats: DataFrame) -> DataFrame:
    """All four classes and the combined label."""
    classed = abc_classify(pattern_class(volatility_class(volume_class(stats))), "total_demand")
    return classed.withColumn(
        "segment", F.concat_ws(" | ", "abc_class", "demand_volume", "volatility", "demand_pattern")
    )


def segment_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(
        F.count(F.lit(1)).alias("products"),
        F.sum("total_demand").alias("total_demand"),
        F.round(F.avg("avg_daily_demand"), 6).alias("avg_daily_demand"),
    )


def class_counts(segments: DataFrame, columns: list[str]) -> DataFrame:
    return segments.groupBy(*columns).agg(F.count(F.lit(1)).alias("products"))


def high_priority(segments: DataFrame, n: int = 20) -> DataFrame:
    """Important, busy and not stable: the products to watch."""
    return (
        segments.where(
            (F.col("abc_class") == "A")
            & (F.col("demand_volume") == "High")
            & F.col("volatility").isin("Moderate", "Volatile")
        )
        .orderBy(F.desc("total_demand"), "product_id")
        .limit(n)
    )


def slow_movers(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("demand_pattern").isin("Intermittent", "Highly Intermittent"))


def slow_mover_share(segments: DataFrame) -> DataFrame:
    slow = F.count_if(F.col("demand_pattern") != "Regular")
    return segments.agg(
        slow.alias("slow_products"),
        F.count(F.lit(1)).alias("products"),
        F.round(slow / F.count(F.lit(1)) * 100, 2).alias("slow_share_pct"),
    )


def volatility_report(stats: DataFrame) -> DataFrame:
    """Products, mean demand and mean cv per volatility class."""
    classed = stats.withColumn("volatility_class", cv_class("Low", "Medium", "High"))
    return classed.groupBy("volatility_class").agg(
        F.count(F.lit(1)).alias("products"),
        F.round(F.avg("avg_daily_demand"), 6).alias("avg_demand"),
        F.round(F.avg("cv"), 6).alias("avg_cv"),
    )


def top_by(stats: DataFrame, column: str, n: int = 20) -> DataFrame:
    return stats.orderBy(F.desc(column), "product_id").limit(n)


def zero_day_counts(stats: DataFrame) -> DataFrame:
    zero, active = F.col("zero_demand_days"), F.col("active_demand_days")
    return stats.agg(
        F.count_if(zero > 0).alias("with_zero_day"), F.count_if(zero / (zero + active) > 0.5).alias("mostly_zero")
    )


def busy_and_volatile(stats: DataFrame) -> DataFrame:
    """In the upper quartile of both mean demand and cv."""
    demand = quantile_values(stats, "avg_daily_demand", {"p75": 0.75})["p75"]
    cv = quantile_values(stats, "cv", {"p75": 0.75})["p75"]
    return stats.where((F.col("avg_daily_demand") >= demand) & (F.col("cv") >= cv))
