"""Inventory policy, stock roll-forward and order recommendations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.scalars import equals_ignore_case, is_any_of
from stockloom.schemas import SERIES_KEY

# Standard normal factor per service level.
Z_SCORES = {0.90: 1.282, 0.95: 1.645, 0.98: 2.054, 0.99: 2.326}
DEFAULT_Z = 1.645
# Where lead time and service level come from, and the cost label.
PARAMETER_SOURCE = "NOT_AVAILABLE_IN_SOURCE (Configured Parameter)"
DEFAULT_COST_STATUS = "ORIGINAL_VALID_IN_MASTER"
CRITICAL, REORDER, OVERSTOCK, OPTIMAL = "CRITICAL_STOCKOUT", "REORDER_RECOMMENDED", "OVERSTOCK", "OPTIMAL"


def demand_params(demand: DataFrame, first: str, last: str) -> DataFrame:
    """Mean and deviation of the existing daily rows of a recent window."""
    return (
        demand.where(F.col("date_").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        .groupBy(*SERIES_KEY)
        .agg(
            F.round(F.avg("daily_quantity"), 2).alias("mean_daily_demand"),
            F.round(F.coalesce(F.stddev_samp("daily_quantity"), F.lit(0.0)), 2).alias("std_daily_demand"),
            F.count(F.lit(1)).alias("active_days_in_window"),
        )
    )


def _whole(c: Column) -> Column:
    """Round up, without lifting whole numbers that carry float noise."""
    return F.ceil(F.round(c, 9)).cast("bigint")


def _levels(df: DataFrame, lead_time: int, service_level: float, review: int) -> DataFrame:
    z = Z_SCORES.get(round(service_level, 2), DEFAULT_Z)
    mean, std = F.col("mean_daily_demand"), F.col("std_daily_demand")
    return (
        df.withColumn("lead_time_days_param", F.lit(lead_time))
        .withColumn("target_service_level_param", F.lit(service_level))
        .withColumn("lead_time_demand", F.round(mean * lead_time, 9))
        .withColumn("safety_stock", _whole(F.lit(z) * std * math.sqrt(lead_time)))
        .withColumn("reorder_point", _whole(F.col("lead_time_demand") + F.col("safety_stock")))
        .withColumn("target_stock_level", _whole(mean * (lead_time + review) + F.col("safety_stock")))
    )


def inventory_policy(
    params: DataFrame,
    costs: DataFrame | None = None,
    lead_time: int = 3,
    service_level: float = 0.95,
    review: int = 7,
) -> DataFrame:
    """Safety stock, reorder point and target level per series.

    ``costs`` has the recovered unit cost and its tier per series.
    """
    df = params
    if costs is None:
        df = df.withColumns({"unit_cost": F.lit(None).cast("double"), "cost_data_status": F.lit(DEFAULT_COST_STATUS)})
    else:
        tier = costs.select(
            *SERIES_KEY,
            F.col("recovered_landing_price").alias("unit_cost"),
            F.col("recovery_tier").alias("cost_data_status"),
        )
        df = df.join(tier, SERIES_KEY, "left").withColumn(
            "cost_data_status", F.coalesce("cost_data_status", F.lit(DEFAULT_COST_STATUS))
        )
    return _levels(df, lead_time, service_level, review).withColumns(
        {"lead_time_source": F.lit(PARAMETER_SOURCE), "service_level_source": F.lit(PARAMETER_SOURCE)}
    )


def recompute(
    policy: DataFrame,
    lead_time: int,
    service_level: float,
    review: int = 7,
    city: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The policy under other parameters, optionally for one city."""
    df = _levels(policy.where(equals_ignore_case("city_name", city)), lead_time, service_level, review)
    return df if limit is None else df.orderBy(F.desc("mean_daily_demand"), *SERIES_KEY).limit(limit)


def roll_forward(movements: DataFrame, opening: DataFrame | float) -> DataFrame:
    """Daily opening and closing stock, never below zero.

    The recursion close = max(0, open + received - sold) has the closed form
    S_t - min(0, min S_s for s <= t), with S the running balance, so two
    windows over the days of one series replace a day-by-day loop.
    """
    if isinstance(opening, DataFrame):
        df = movements.join(opening.select(*SERIES_KEY, F.col("opening_stock").alias("_start")), SERIES_KEY, "left")
        df = df.withColumn("_start", F.coalesce("_start", F.lit(0.0)))
    else:
        df = movements.withColumn("_start", F.lit(float(opening)))
    by_day = Window.partitionBy(*SERIES_KEY).orderBy("snapshot_date")
    upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn("_balance", F.col("_start") + F.sum(F.col("stock_received") - F.col("sales_quantity")).over(upto))
        .withColumn("closing_stock", F.col("_balance") - F.least(F.lit(0.0), F.min("_balance").over(upto)))
        .withColumn("opening_stock", F.coalesce(F.lag("closing_stock").over(by_day), F.col("_start")))
        .drop("_start", "_balance")
    )


def days_of_cover(ledger: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Days the closing stock lasts at the expected (else the day's) demand."""
    expected = recommendations.groupBy(*SERIES_KEY).agg(F.max("avg_daily_demand").alias("_expected"))
    daily = F.coalesce("_expected", F.greatest(F.lit(1.0), F.col("sales_quantity")))
    return (
        ledger.join(expected, SERIES_KEY, "left")
        .withColumn("days_of_cover", F.bround(F.col("closing_stock") / F.greatest(F.lit(1.0), daily), 1))
        .drop("_expected")
    )


def cover_risk(df: DataFrame) -> DataFrame:
    """Risk, urgency and action by days of cover."""
    cover = F.col("days_of_cover")

    def band(critical, reorder, over, fine):
        return (
            F.when(cover <= 2.0, F.lit(critical))
            .when(cover <= 4.0, F.lit(reorder))
            .when(cover > 15.0, F.lit(over))
            .otherwise(F.lit(fine))
        )

    return df.withColumns(
        {
            "stockout_risk": band(CRITICAL, REORDER, OVERSTOCK, OPTIMAL),
            "reorder_urgency": band("HIGH", "MEDIUM", "LOW", "NONE"),
            "action_text": band(
                "Trigger Emergency Replenishment",
                "Issue Supplier Reorder",
                "Surplus Inventory - Pause PO",
                "Stock Buffer Adequate",
            ),
        }
    )


def recommend_orders(policy: DataFrame, stock: DataFrame) -> DataFrame:
    """Compare current stock with the policy and size the order."""
    current = F.col("current_stock")
    low, reorder = current < F.col("safety_stock"), current <= F.col("reorder_point")
    over = current > F.col("target_stock_level") * 1.4
    gap = F.bround(F.col("target_stock_level") - current, 1)
    return policy.join(stock.select(*SERIES_KEY, "current_stock"), SERIES_KEY).select(
        *SERIES_KEY,
        "current_stock",
        F.col("mean_daily_demand").alias("avg_daily_demand"),
        F.col("lead_time_days_param").alias("lead_time_days"),
        "safety_stock",
        "reorder_point",
        "target_stock_level",
        "unit_cost",
        F.when(low | reorder, gap).otherwise(F.lit(0.0)).alias("recommended_order_qty"),
        F.when(low, CRITICAL).when(reorder, REORDER).when(over, OVERSTOCK).otherwise(OPTIMAL).alias("risk_status"),
        F.when(low, "HIGH").when(reorder, "MEDIUM").otherwise("LOW").alias("priority"),
    )


def inventory_status(
    ledger: DataFrame,
    recommendations: DataFrame,
    products: DataFrame,
    product_id=None,
    city: str | None = None,
    snapshot_date: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Newest ledger rows with cover, risk and product name.

    Filter and limit come first, so the joins see only the listed rows.
    """
    rows = ledger.where(equals_ignore_case("city_name", city))
    if product_id is not None:
        rows = rows.where(F.col("product_id") == F.lit(product_id))
    if snapshot_date is not None:
        rows = rows.where(F.col("snapshot_date") == F.lit(snapshot_date).cast("date"))
    rows = rows.orderBy(F.desc("snapshot_date"), "product_id", "city_name").limit(limit)
    named = cover_risk(days_of_cover(rows, recommendations)).join(
        products.select("product_id", "product_name"), "product_id", "left"
    )
    stocks = ["opening_stock", "stock_received", "sales_quantity", "closing_stock"]
    return named.withColumn(
        "product_name", F.coalesce("product_name", F.concat(F.lit("SKU #"), F.col("product_id").cast("string")))
    ).withColumns({c: F.bround(c, 1) for c in stocks})


def list_recommendations(
    recommendations: DataFrame, product_id=None, city: str | None = None, limit: int = 100
) -> DataFrame:
    rows = recommendations.where(equals_ignore_case("city_name", city))
    if product_id is not None:
        rows = rows.where(F.col("product_id") == F.lit(product_id))
    return rows.orderBy(F.desc("avg_daily_demand"), *SERIES_KEY).limit(limit)


def volatility_status(policy: DataFrame) -> DataFrame:
    """Traffic light by relative deviation and size of the reorder point."""
    cv = F.when(F.col("mean_daily_demand") > 0, F.col("std_daily_demand") / F.col("mean_daily_demand")).otherwise(0.0)
    rop = F.col("reorder_point")
    return policy.withColumns(
        {
            "cv": F.round(cv, 6),
            "status": F.when((cv > 0.35) | (rop > 20000), "HIGH_VOLATILITY")
            .when((cv > 0.20) | (rop > 10000), "ATTENTION_NEEDED")
            .otherwise("SAFE"),
        }
    )


def volatility_counts(statuses: DataFrame) -> DataFrame:
    return statuses.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "HIGH_VOLATILITY").alias("high_volatility"),
        F.count_if(F.col("status") == "ATTENTION_NEEDED").alias("attention_needed"),
        F.count_if(F.col("status") == "SAFE").alias("safe"),
        F.round(F.avg("safety_stock")).cast("bigint").alias("avg_safety_stock"),
    )


def at_risk(
    recommendations: DataFrame, product_ids: list | None = None, cities: list | None = None, n: int = 5
) -> DataFrame:
    """Largest orders among the series at risk, or among given products."""
    wanted = is_any_of("product_id", product_ids) if product_ids else F.col("risk_status").isin(CRITICAL, REORDER)
    return (
        recommendations.where(wanted & is_any_of("city_name", cities))
        .orderBy(F.desc("recommended_order_qty"), *SERIES_KEY)
        .limit(n)
    )


def prefer_actual(actual: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """Counted stock where it exists, derived stock elsewhere, each labelled."""
    counted = actual.withColumn("stock_source", F.lit("actual_inventory"))
    missing = derived.join(actual.select(*keys), keys, "left_anti")
    return counted.unionByName(missing.withColumn("stock_source", F.lit("model_derived_inventory")))


def eoq(df: DataFrame) -> DataFrame:
    """Economic order quantity; null unless demand, order and holding cost exist."""
    d, s, h = F.col("annual_demand"), F.col("ordering_cost"), F.col("holding_cost")
    usable = (d > 0) & (s > 0) & (h > 0)
    return df.withColumn("eoq", F.round(F.when(usable, F.sqrt(2 * d * s / h)), 2))


def top_policies(
    policy: DataFrame, product_ids: list | None = None, cities: list | None = None, n: int = 5
) -> DataFrame:
    return (
        policy.where(is_any_of("product_id", product_ids) & is_any_of("city_name", cities))
        .orderBy(F.desc("safety_stock"), F.desc("mean_daily_demand"), *SERIES_KEY)
        .limit(n)
    )
