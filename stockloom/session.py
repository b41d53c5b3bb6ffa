"""Session settings and the shared scratch area."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on.  Shuffle parallelism is left to the
# cluster; AQE coalesces small partitions and splits skewed ones.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even when that costs one more shuffle later on.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# Settings a session may have made itself.  Rows of the sale tables take some 25 times
# their shuffled bytes as groups in memory (1,620 MB a task at Spark's 64 MB), so a task
# reads 16 MB.
DEFAULT_CONF = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key, value in DEFAULT_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(
    cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8, conf: dict[str, str] | None = None
) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stockloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers a zip of this package, once per Spark context.

    They need it wherever the job was not started from an installed package.
    """
    context = spark.sparkContext
    if getattr(context, "_has_stockloom", False):
        return
    package = Path(__file__).resolve().parent
    base = os.path.join(os.path.realpath(tempfile.mkdtemp()), package.name)
    context.addPyFile(shutil.make_archive(base, "zip", package.parent, package.name))
    context._has_stockloom = True


def scratch_root(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    On a cluster this is the shared folder in ``spark.checkpoint.dir``; a
    machine-local folder is used only when Spark itself runs on one machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="stockloom-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch area."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the scratch area once and continue from the files.

    Cuts lineage, so several consumers read one consistent result and a lost
    executor costs re-reading files instead of recomputing the branch.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` written once for the several steps inside, and removed after them."""
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    try:
        with short_lived_shuffles(spark):
            df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write inside go when it ends, not when the driver collects its garbage.

    Spark makes them again if a plan that has lost them runs once more.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def enable_checkpoints(spark: SparkSession) -> None:
    """Let iterative algorithms checkpoint into the scratch area."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
