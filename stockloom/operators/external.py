"""External features: holidays, weather bands, commodity prices, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.scalars import day_of_week, is_weekend

SUMMER_MONTHS = (4, 5)


def season(c: Column | str) -> Column:
    month = F.month(c)
    return F.when(month.isin(*SUMMER_MONTHS), F.lit("Summer")).otherwise(F.lit("Monsoon"))


def holiday_features(dates: DataFrame, holidays: DataFrame, regions: list[str]) -> DataFrame:
    """Calendar with holiday type and name.

    ``holidays`` has (date_, scope, region, holiday_name) with scope national,
    restricted or state.  National names come first, then restricted ones, then
    those of the ``regions`` in the given order.
    """
    scope, name = F.col("scope"), F.col("holiday_name")

    def first_of(condition):
        return F.min(F.when(condition, name))

    state_columns = [f"_state_{i}" for i in range(len(regions))]
    per_day = holidays.groupBy("date_").agg(
        first_of(scope == "national").alias("_national"),
        first_of(scope == "restricted").alias("_restricted"),
        *[
            first_of((scope == "state") & (F.col("region") == region)).alias(column)
            for column, region in zip(state_columns, regions)
        ],
    )
    any_state = F.coalesce(*state_columns)
    primary = F.coalesce("_national", "_restricted", any_state)
    return dates.join(per_day, "date_", "left").select(
        *dates.columns,
        day_of_week("date_").alias("day_of_week"),
        F.month("date_").alias("month"),
        F.quarter("date_").alias("quarter"),
        F.year("date_").alias("year"),
        is_weekend("date_").alias("is_weekend"),
        F.col("_national").isNotNull().cast("int").alias("is_holiday_national"),
        F.when(F.col("_national").isNotNull(), F.lit("Gazetted"))
        .when(F.col("_restricted").isNotNull(), F.lit("Restricted"))
        .when(any_state.isNotNull(), F.lit("State"))
        .otherwise(F.lit("None"))
        .alias("holiday_type"),
        primary.isNotNull().cast("int").alias("is_holiday"),
        F.coalesce(primary, F.lit("None")).alias("holiday_name"),
        season("date_").alias("season"),
    )


def weather_condition(weather: DataFrame) -> DataFrame:
    """Band of the day by rain, then heat, then humidity."""
    rain, hot, damp = F.col("rainfall_mm"), F.col("temperature_max"), F.col("humidity")
    return weather.withColumn(
        "weather_condition",
        F.when(rain >= 35.0, "Heavy Rain")
        .when(rain >= 5.0, "Rain / Monsoon Shower")
        .when(rain > 0.0, "Light Rain")
        .when(hot >= 40.0, "Extreme Heatwave")
        .when(hot >= 35.0, "Hot / Sunny")
        .when(damp >= 75.0, "Humid / Overcast")
        .otherwise("Clear / Pleasant"),
    )


def city_commodity(prices: DataFrame, market_city: dict[str, str], first: str, last: str) -> DataFrame:
    """Market prices of the mapped cities inside a period.

    ``market_city`` maps lower-case market names to cities (a short list).
    """
    pairs = [F.lit(x) for pair in market_city.items() for x in pair]
    city = F.create_map(*pairs)[F.lower("market")]
    return (
        prices.where(F.col("date_").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        .withColumn("project_city", city)
        .where("project_city is not null")
        .select(
            "date_",
            "project_city",
            F.col("commodity").alias("commodity_name"),
            "category",
            F.col("price").alias("price_per_kg"),
            F.format_string("INR %.2f per %s", "price", "unit").alias("price_per_unit"),
            F.concat(F.col("market"), F.lit(" ("), F.col("project_city"), F.lit(")")).alias("market_name"),
        )
    )


def benchmark_long(wide: DataFrame, meta: DataFrame, month: str = "month_code") -> DataFrame:
    """Wide monthly benchmark table to (month, commodity, price) with metadata.

    Month codes look like 2022M04; columns without metadata are dropped.
    """
    series = [c for c in wide.columns if c != month]
    long_ = wide.unpivot([month], series, "commodity_name", "benchmark_price_usd").where(
        "benchmark_price_usd is not null"
    )
    code = F.col(month)
    first_day = F.to_date(F.concat(F.replace(code, F.lit("M"), F.lit("-")), F.lit("-01")))
    return long_.join(meta, "commodity_name").select(
        first_day.alias("date_"),
        month,
        "commodity_name",
        "category",
        F.round("benchmark_price_usd", 4).alias("benchmark_price_usd"),
        "unit",
    )


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], value: str, time: str = "date_") -> DataFrame:
    """Last known ``value`` at or before each row's day.

    Only the distinct (key, day) pairs of ``left`` and the quotes are ordered,
    never the rows themselves; the result joins back by equality.
    """
    days = left.select(*keys, time).distinct().withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    quotes = right.groupBy(*keys, time).agg(F.max(value).alias(value))
    upto = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = (
        days.unionByName(quotes)
        .groupBy(*keys, time)
        .agg(F.max(value).alias(value))
        .withColumn(value, F.last(value, ignorenulls=True).over(upto))
    )
    return left.join(known, [*keys, time], "left")


def join_external(
    demand: DataFrame,
    calendar: DataFrame | None = None,
    weather: DataFrame | None = None,
    commodity: DataFrame | None = None,
) -> DataFrame:
    """Attach daily calendar, city weather and the last known city price level."""
    df = demand
    if calendar is not None:
        df = df.join(calendar, "date_", "left")
    if weather is not None:
        df = df.join(weather, ["date_", "city_name"], "left")
    if commodity is not None:
        df = as_of_join(df, commodity, ["city_name"], "price_level")
    return df
