"""Running computations over keys that may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.relations import join_same_keys
from stockloom.session import materialize


def ordered_totals(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Global rank and running sums without a single-task window.

    Rows are range-partitioned by ``order`` (which must be a total order), each
    slice is ranked on its own, and the totals of the earlier slices - one
    small row per slice - are added.  ``sums`` maps output to input column.
    The slices are written once so that both steps see the same borders.

    Adds ``row_rank``, the ``sums`` outputs and, per sum, ``<input>_total``.
    """
    sliced = materialize(
        df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    )
    inputs = list(dict.fromkeys(sums.values()))
    per_slice = sliced.groupBy("_slice").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in inputs]
    )
    # One row per slice, so at most the shuffle parallelism.
    earlier = Window.partitionBy(F.lit(0)).orderBy("_slice")
    whole = Window.partitionBy(F.lit(0))
    offsets = per_slice.select(
        "_slice",
        (F.sum("_rows").over(earlier) - F.col("_rows")).alias("_rows_before"),
        F.sum("_rows").over(whole).alias("row_total"),
        *[(F.sum(f"_sum_{c}").over(earlier) - F.col(f"_sum_{c}")).alias(f"_before_{c}") for c in inputs],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"{c}_total") for c in inputs],
    )
    here = Window.partitionBy("_slice").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sliced.join(offsets, "_slice")
        .withColumn("row_rank", F.row_number().over(here) + F.col("_rows_before"))
        .withColumns({out: F.sum(c).over(upto) + F.col(f"_before_{c}") for out, c in sums.items()})
        .drop("_slice", "_rows_before", *[f"_before_{c}" for c in inputs])
    )


def carry_last(
    df: DataFrame, keys: list[str], order: str, columns: dict[str, str], block: int = 4096
) -> DataFrame:
    """Last non-null earlier value per key, also for very long keys.

    ``order`` is an integer sequence.  Rows are cut into blocks of ``block``
    sequence numbers; the last value of each block is carried over the blocks,
    and inside a block a window reads the nearer rows.  ``columns`` maps output
    to input column.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    ends = blocked.groupBy(*keys, "_block").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_end_{c}")
            for c in dict.fromkeys(columns.values())
        ]
    )
    before_block = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys,
        "_block",
        *[
            F.last(f"_end_{c}", ignorenulls=True).over(before_block).alias(f"_carry_{c}")
            for c in dict.fromkeys(columns.values())
        ],
    )
    before_row = (
        Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        join_same_keys(blocked, carried, [*keys, "_block"], "left")
        .withColumns(
            {
                out: F.coalesce(F.last(c, ignorenulls=True).over(before_row), F.col(f"_carry_{c}"))
                for out, c in columns.items()
            }
        )
        .drop("_block", *[f"_carry_{c}" for c in dict.fromkeys(columns.values())])
    )
