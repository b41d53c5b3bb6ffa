"""Growth, movers and price association.  Associations are not causes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.scalars import pct_change
from stockloom.operators.demand import UNMATCHED, period_change

ALL = "ALL"


def weekly_growth(table: DataFrame, products: DataFrame) -> DataFrame:
    """Volume per week with growth over the week before, overall and per category.

    Products are summed per week before their category is looked up.
    """
    week = F.date_trunc("week", F.col("date_")).cast("date")
    weekly = table.groupBy("product_id", week.alias("week")).agg(F.sum("total_quantity").alias("volume"))
    named = weekly.join(products.select("product_id", "l0_category"), "product_id", "left")
    labels = F.array(F.lit(ALL), F.coalesce("l0_category", F.lit(UNMATCHED)))
    volumes = (
        named.select("week", "volume", F.explode(labels).alias("category"))
        .groupBy("category", "week")
        .agg(F.sum("volume").alias("volume"))
    )
    by_week = Window.partitionBy("category").orderBy("week")
    follows = F.lag("week").over(by_week) == F.date_sub("week", 7)
    before = F.coalesce(F.when(follows, F.lag("volume").over(by_week)), F.lit(0.0))
    return volumes.withColumn("previous_volume", before).withColumn(
        "wow_growth_volume_pct", pct_change(F.col("volume"), F.col("previous_volume"), 2)
    )


def movers(
    table: DataFrame, by: str, current: tuple[str, str], previous: tuple[str, str], n: int = 10, products=None
) -> DataFrame:
    """The ``n`` strongest gains and losses of revenue by product, brand or city."""
    if by in table.columns:
        change = period_change(table, current, previous, [by])
    else:
        per_product = period_change(table, current, previous, ["product_id"]).join(
            products.select("product_id", by), "product_id", "left"
        )
        sums = per_product.groupBy(F.coalesce(by, F.lit(UNMATCHED)).alias(by)).agg(
            *[
                F.sum(c).alias(c)
                for c in ["current_revenue", "previous_revenue", "current_volume", "previous_volume"]
            ]
        )
        change = sums.withColumns(
            {
                "revenue_change_pct": pct_change(F.col("current_revenue"), F.col("previous_revenue")),
                "volume_change_pct": pct_change(F.col("current_volume"), F.col("previous_volume")),
            }
        )
    delta = F.round(F.col("current_revenue") - F.col("previous_revenue"), 2)
    change = change.withColumn("revenue_delta", delta)
    up = change.orderBy(F.desc("revenue_delta"), by).limit(n).withColumn("direction", F.lit("up"))
    down = change.orderBy("revenue_delta", by).limit(n).withColumn("direction", F.lit("down"))
    return up.unionByName(down)


def _discount_rate(df: DataFrame) -> DataFrame:
    gross = F.col("procured_quantity") * F.col("unit_selling_price")
    return df.withColumn("discount_rate", F.when(gross > 0, F.col("total_discount_amount") / gross))


def discount_correlation(enriched: DataFrame) -> DataFrame:
    """Correlation of discount rate and quantity, overall and per category."""
    named = _discount_rate(enriched).withColumn("category", F.coalesce("l0_category", F.lit(UNMATCHED)))
    return (
        named.rollup("category")
        .agg(
            F.round(F.corr("discount_rate", "procured_quantity"), 6).alias("discount_correlation"),
            F.count("discount_rate").alias("observations"),
        )
        .withColumn("category", F.coalesce("category", F.lit(ALL)))
    )


def discount_bands(sales: DataFrame, edges: list[float]) -> DataFrame:
    """Demand per band of the discount rate; ``edges`` are upper limits."""
    rate = F.round("discount_rate", 6)
    band = F.lit(None).cast("string")
    lower = None
    conditions = []
    for edge in edges:
        label = f"<= {edge:g}" if lower is None else f"{lower:g} - {edge:g}"
        conditions.append((rate <= edge, label))
        lower = edge
    conditions.append((rate > lower, f"> {lower:g}"))
    for condition, label in reversed(conditions):
        band = F.when(condition, F.lit(label)).otherwise(band)
    return (
        _discount_rate(sales)
        .groupBy(band.alias("discount_band"))
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum("procured_quantity").alias("total_quantity"),
            F.round(F.avg("procured_quantity"), 6).alias("avg_quantity"),
            F.round(F.sum(F.col("procured_quantity") * F.col("unit_selling_price")), 2).alias("total_revenue"),
        )
    )


def elasticity(table: DataFrame, by: list[str], min_days: int = 3) -> DataFrame:
    """Slope of log quantity on log price; an association, not an effect."""
    usable = table.where((F.col("total_quantity") > 0) & (F.col("avg_unit_price") > 0))
    q, p = F.log("total_quantity"), F.log("avg_unit_price")
    return (
        usable.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.round(F.regr_slope(q, p), 6).alias("elasticity"),
            F.round(F.regr_r2(q, p), 6).alias("r_squared"),
        )
        .where(F.col("days") >= min_days)
    )


def fast_selling(
    table: DataFrame, current: tuple[str, str], previous: tuple[str, str], factor: float = 1.5, min_volume: float = 0
) -> DataFrame:
    """Products that now sell at least ``factor`` times their earlier volume per day."""

    def days(period):
        return F.datediff(F.lit(period[1]).cast("date"), F.lit(period[0]).cast("date")) + 1

    change = period_change(table, current, previous, ["product_id"])
    now, before = F.col("current_volume") / days(current), F.col("previous_volume") / days(previous)
    return (
        change.withColumns({"daily_now": F.round(now, 6), "daily_before": F.round(before, 6)})
        .where((F.col("current_volume") >= min_volume) & (before > 0) & (now >= before * factor))
        .select("product_id", "current_volume", "previous_volume", "daily_now", "daily_before")
    )


def mismatch(recommendations: DataFrame, growth: DataFrame) -> DataFrame:
    """Series whose stock does not fit where their demand is heading.

    ``growth`` has volume_change_pct per series.
    """
    change = F.col("volume_change_pct")
    low = F.col("risk_status").isin("CRITICAL_STOCKOUT", "REORDER_RECOMMENDED")
    return (
        recommendations.join(growth.select("product_id", "city_name", "volume_change_pct"), ["product_id", "city_name"])
        .withColumn(
            "mismatch",
            F.when(low & (change > 0), "RISING_DEMAND_LOW_STOCK").when(
                (F.col("risk_status") == "OVERSTOCK") & (change < 0), "FALLING_DEMAND_OVERSTOCK"
            ),
        )
        .where("mismatch is not null")
    )
