"""Writing results: tables, metrics, checked publication, upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.operators.audits import expectations, require
from stockloom.operators.validation import latest_per_key


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite"
) -> None:
    """One distributed write; CSV gets a header per part file."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def metrics_json(metrics: dict[str, DataFrame]) -> DataFrame:
    """One JSON line per row of each named (small) result."""
    parts = [
        df.select(F.lit(name).alias("metric"), F.to_json(F.struct("*")).alias("value")) for name, df in metrics.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def write_metrics(metrics: dict[str, DataFrame], path: str) -> None:
    metrics_json(metrics).write.mode("overwrite").json(path)


def publish(df: DataFrame, path: str, checks: dict[str, tuple[Column, float]]) -> None:
    """Write beside the target, verify what was written, then swap.

    Readers see the old table until the checks have passed.  Every rename is
    checked; when the new table cannot take the place, the old one is put back.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    if checks:
        require(expectations(spark.read.parquet(staged), checks))
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, source = hadoop.Path(path), hadoop.Path(staged)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        retired = hadoop.Path(f"{staged}.old")
        _rename(files, target, retired)
        try:
            _rename(files, source, target)
        except Exception:
            _rename(files, retired, target)
            raise
        files.delete(retired, True)
    else:
        _rename(files, source, target)


def _rename(files, source, target) -> None:
    if not files.rename(source, target):  # false, where other calls would raise
        raise OSError(f"could not rename {source} to {target}")


def upsert_table(path: str, updates: DataFrame, keys: list[str], order: str) -> None:
    """``upsert`` into the stored table at ``path``, published once it is whole."""
    target = updates.sparkSession.read.parquet(path)
    publish(upsert(target, updates, keys, order), path, {})


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Replace rows by key; of several updates of a key the latest wins."""
    latest = latest_per_key(updates, keys, order).select(*target.columns)
    return target.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def insert_missing(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Add rows whose key is not there yet; of several new rows of a key the smallest."""
    others = [c for c in target.columns if c not in keys]
    rows = new.groupBy(*keys).agg(F.min(F.struct(*others, F.lit(0).alias("_any"))).alias("_first"))
    rows = rows.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in others])
    return target.unionByName(rows.join(target.select(*keys), keys, "left_anti").select(*target.columns))
