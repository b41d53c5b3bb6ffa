"""Repeatable samples that depend on row keys, not on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def hash_place(keys: list[str], seed: int) -> Column:
    """A fixed pseudo-random place in [0, 1) for each key: the first 32 bits of its MD5."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def hash_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42, rows: int | None = None) -> DataFrame:
    """At most ``n`` rows with the smallest hash places.

    The places a row must reach are set from the row count, so only slightly
    more than ``n`` rows are ever sorted.  Without ``rows`` they are counted.
    """
    total = df.count() if rows is None else rows
    share = min(1.0, (n + 10 * math.sqrt(n) + 50) / max(total, 1))
    placed = df.withColumn("_place", hash_place(keys, seed))
    return placed.where(F.col("_place") < share).orderBy("_place", *keys).limit(n).drop("_place")
