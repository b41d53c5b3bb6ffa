"""Session settings and small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.session import configure, ship_package

# Rows and bytes of one Arrow batch between the JVM and a Python worker: texts
# and pages are long, so batches are bounded by bytes as well.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def ready(spark: SparkSession) -> SparkSession:
    """The session with the library's settings, bounded Arrow batches and the package on its workers."""
    configure(spark)
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {name.lower() for name in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def text_or_empty(column: str | Column) -> Column:
    """Null texts are treated as empty everywhere in this package."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI as tasks reach it, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def in_slices(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield as_batch(held, schema)
            held = []
    if held:
        yield as_batch(held, schema)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(zip(*rows), schema)], schema=schema
    )
