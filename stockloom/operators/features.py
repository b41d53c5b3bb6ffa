"""Dense calendar, lags, rolling statistics and calendar columns per series.

A series is one (product, city).  All windows partition by the series, so they
share one shuffle and one sort; a series has at most one row per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.sampling import hash_sample
from stockloom.functions.scalars import day_of_week, is_weekend
from stockloom.schemas import SERIES_KEY

FEATURES = [
    "lag_1", "lag_7", "lag_14", "lag_28",
    "rolling_mean_7", "rolling_mean_14", "rolling_mean_28", "rolling_std_7",
    "day_of_week", "is_weekend",
]

TUNING_FEATURES = [*FEATURES, "rolling_std_14", "rolling_std_28", "day_of_month"]


def calendar_grid(
    demand: DataFrame,
    first: str,
    last: str,
    value: str = "daily_quantity",
    keys: list[str] = SERIES_KEY,
    skip_unobserved: bool = False,
) -> DataFrame:
    """Every existing series on every day, zero where nothing was sold.

    ``demand`` has one row per series and day.  The days of a series travel as
    one short array, the calendar is generated beside them, and both are summed
    where they already are: one shuffle, and no join or cross join.
    ``skip_unobserved`` leaves out days on which no series at all has a row.
    """
    low, high = F.lit(first).cast("date"), F.lit(last).cast("date")
    inside = F.col("date_").between(low, high)
    own = F.collect_list(F.when(inside, F.struct(F.col("date_").alias("d"), F.col(value).cast("double").alias("v"))))
    days = F.sequence(low, high)
    zeros = F.transform(days, lambda d: F.struct(d.alias("d"), F.lit(0.0).alias("v")))
    grid = (
        demand.groupBy(*keys)
        .agg(own.alias("_own"))
        .select(*keys, F.explode(F.concat("_own", zeros)).alias("_e"))
        .groupBy(*keys, F.col("_e.d").alias("date_"))
        .agg(F.sum("_e.v").alias(value))
    )
    if skip_unobserved:
        grid = grid.join(demand.select("date_").distinct(), "date_", "left_semi")
    return grid.select("date_", *keys, value)


def series_pool(demand: DataFrame, n: int, keys: list[str] = SERIES_KEY) -> DataFrame:
    """The ``n`` series with the most active days."""
    return (
        demand.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("active_days"), F.sum("daily_quantity").alias("total_qty"))
        .orderBy(F.desc("active_days"), F.desc("total_qty"), *keys)
        .limit(n)
    )


def _by_day(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("date_")


def add_lags(df: DataFrame, lags: list[int], value: str = "daily_quantity", keys: list[str] = SERIES_KEY) -> DataFrame:
    w = _by_day(keys)
    return df.withColumns({f"lag_{n}": F.lag(value, n).over(w) for n in lags})


def _earlier(n: int, keys: list[str]):
    """The ``n`` rows before the current one: never today, never later."""
    return _by_day(keys).rowsBetween(-n, -1)


def _only_full(result: Column, value: str, n: int, keys: list[str], full: bool) -> Column:
    return F.when(F.count(value).over(_earlier(n, keys)) == n, result) if full else result


def add_rolling_mean(
    df: DataFrame, sizes: list[int], value: str = "daily_quantity", keys: list[str] = SERIES_KEY, full: bool = False
) -> DataFrame:
    """Mean of the preceding ``n`` rows; ``full`` leaves shorter histories null."""
    return df.withColumns(
        {f"rolling_mean_{n}": _only_full(F.avg(value).over(_earlier(n, keys)), value, n, keys, full) for n in sizes}
    )


def add_rolling_std(
    df: DataFrame, sizes: list[int], value: str = "daily_quantity", keys: list[str] = SERIES_KEY, full: bool = False
) -> DataFrame:
    """Sample deviation of the preceding ``n`` rows; 0 where undefined."""
    return df.withColumns(
        {
            f"rolling_std_{n}": F.coalesce(
                _only_full(F.stddev_samp(value).over(_earlier(n, keys)), value, n, keys, full), F.lit(0.0)
            )
            for n in sizes
        }
    )


def add_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "day_of_week": day_of_week("date_"),
            "is_weekend": is_weekend("date_"),
            "day_of_month": F.dayofmonth("date_"),
        }
    )


def drop_warmup(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose history is long enough for every feature."""
    return df.dropna(subset=columns)


def feature_frame(grid: DataFrame, keys: list[str] = SERIES_KEY) -> DataFrame:
    """All model features on a dense grid, warm-up removed."""
    df = add_lags(grid, [1, 7, 14, 28], keys=keys)
    df = add_rolling_mean(df, [7, 14, 28], keys=keys)
    df = add_rolling_std(df, [7], keys=keys)
    return drop_warmup(add_calendar(df), ["lag_28", "rolling_mean_28"])


def tuning_frame(grid: DataFrame, keys: list[str] = SERIES_KEY) -> DataFrame:
    """The feature frame with the wider deviations that the tuned model also sees."""
    df = add_lags(grid, [1, 7, 14, 28], keys=keys)
    df = add_rolling_mean(df, [7, 14, 28], keys=keys)
    df = add_rolling_std(df, [7, 14, 28], keys=keys)
    return drop_warmup(add_calendar(df), ["lag_28", "rolling_mean_28"])


def observation_features(demand: DataFrame, keys: list[str] = SERIES_KEY) -> DataFrame:
    """Features over existing rows only ("n-th previous observation"), sold days only."""
    df = add_lags(demand, [1, 7, 14, 28], keys=keys)
    df = add_rolling_mean(df, [7, 14, 28], keys=keys)
    df = add_rolling_std(df, [7, 14, 28], keys=keys)
    return drop_warmup(add_calendar(df), ["lag_28"]).where("daily_quantity > 0")


def split_by_date(df: DataFrame, cut: str) -> tuple[DataFrame, DataFrame]:
    """Chronological split: before the cut, and from the cut on."""
    day = F.lit(cut).cast("date")
    return df.where(F.col("date_") < day), df.where(F.col("date_") >= day)


def feature_audit(grid: DataFrame, first: str, last: str, keys: list[str] = SERIES_KEY) -> DataFrame:
    """Expected against actual grid rows, zero rows and nulls."""
    per_series = grid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("daily_quantity") == 0).alias("zeros"),
        F.count_if(F.col("daily_quantity").isNull()).alias("nulls"),
        F.min("date_").alias("lo"),
        F.max("date_").alias("hi"),
    )
    days = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) + 1
    return per_series.agg(
        F.count(F.lit(1)).alias("series"),
        (F.count(F.lit(1)) * days).cast("bigint").alias("expected_rows"),
        F.sum("n").alias("actual_rows"),
        F.sum("zeros").alias("zero_rows"),
        F.sum("nulls").alias("null_rows"),
        F.min("lo").alias("first_date"),
        F.max("hi").alias("last_date"),
        F.count_if(F.col("n") != days).alias("incomplete_series"),
    )


def cap_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """A repeatable sample of at most ``n`` rows, the same on any partitioning."""
    return hash_sample(df, n, keys, seed)
