"""Exact, interpolated quantiles that never gather one group in one task.

``percentile`` keeps every distinct value of a group in the memory of one
task, which a hot group (or no grouping at all) would overload.  Here equal
values are first counted and the counts are summed into value buckets whose
borders grow with the value.  The few buckets that hold a requested position
are split once more, evenly between their own smallest and largest value, so
that values crowded into a narrow range are spread as well; only the parts that
hold a position are ranked, each part on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.relations import join_same_keys

# Buckets per doubling of the value: about 1.1 % wide.
BUCKETS_PER_OCTAVE = 64
# Equal parts of a bucket that holds a requested position.
PARTS = 4096
_LOWEST, _HIGHEST = -(1 << 30), 1 << 30


def _value_bucket(v: Column) -> Column:
    """Ascending with the value; the infinities and NaN have buckets of their own."""
    finite = (F.signum(v) * F.floor(F.log2(F.abs(v) + 1) * BUCKETS_PER_OCTAVE)).cast("int")
    return (
        F.when(F.isnan(v), _HIGHEST + 1)
        .when(v == float("inf"), _HIGHEST)
        .when(v == float("-inf"), _LOWEST)
        .otherwise(finite)
    )


def _part(v: Column, low: Column, high: Column) -> Column:
    # Halves keep the width finite for any two finite values.
    share = (v / 2 - low / 2) / (high / 2 - low / 2)
    return F.when(high > low, F.least(F.floor(share * PARTS), F.lit(PARTS - 1))).otherwise(0).cast("int")


def _holding(rows: DataFrame, by: list[str], bucket: str, positions: list[Column]) -> DataFrame:
    """The rows of the buckets that hold a position, ``_offset`` values before each bucket."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sums = rows.groupBy(*by, bucket).agg(
        F.sum("_n").alias("_in"),
        F.max("_offset").alias("_offset"),
        F.max("_total").alias("_total"),
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
    )
    sums = sums.withColumns(
        {
            "_offset": F.col("_offset") + F.sum("_in").over(group.orderBy(bucket)) - F.col("_in"),
            "_total": F.coalesce("_total", F.sum("_in").over(group)),
        }
    )
    wanted = F.lit(False)
    for pos in positions:
        for rank in (F.floor(pos), F.ceil(pos)):
            wanted = wanted | ((rank >= F.col("_offset")) & (rank < F.col("_offset") + F.col("_in")))
    chosen = sums.where(wanted).drop("_in")
    return join_same_keys(rows.drop("_offset", "_total", "_low", "_high"), chosen, [*by, bucket])


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    count_name: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One row per group with a column per entry of ``probs``.

    Nulls are ignored.  ``count_name`` adds the number of values used.  Groups
    without any value do not appear, so callers left-join the result.
    ``weight`` names a column with the number of times a row counts.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(n.alias("_n"))
        .withColumn("_b", _value_bucket(F.col("_v")))
        .withColumns({"_offset": F.lit(0).cast("bigint"), "_total": F.lit(None).cast("bigint")})
    )
    position = {name: (F.col("_total") - 1) * F.lit(float(p)) for name, p in probs.items()}
    # At most a few thousand buckets exist per group, whatever its row count.
    near = _holding(counted, keys, "_b", list(position.values()))
    near = near.withColumn("_p", _part(F.col("_v"), F.col("_low"), F.col("_high")))
    nearest = _holding(near, [*keys, "_b"], "_p", list(position.values()))
    in_part = Window.partitionBy(*keys, "_b", "_p").orderBy("_v")
    ranked = nearest.withColumn("_end", F.col("_offset") + F.sum("_n").over(in_part))
    aggs = []
    for name, pos in position.items():
        low = F.min(F.when(F.col("_end") > F.floor(pos), F.col("_v")))
        high = F.min(F.when(F.col("_end") > F.ceil(pos), F.col("_v")))
        share = F.max(pos - F.floor(pos))
        aggs.append((low + (high - low) * share).alias(name))
    if count_name:
        aggs.append(F.max("_total").alias(count_name))
    return ranked.groupBy(*keys).agg(*aggs)


def quantile_values(df: DataFrame, value: str, probs: dict[str, float], weight: str | None = None) -> Column:
    """All-row quantiles as one struct column, evaluated once per query."""
    row = exact_quantiles(df, [], value, probs, weight=weight)
    return row.select(F.struct(*probs).alias("q")).scalar()
