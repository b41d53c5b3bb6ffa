"""Reading sale files, product masters and external tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.functions.relations import literal_table
from stockloom.operators.cleaning import clean_products
from stockloom.schemas import ALIAS_WORDS, ALIASES, EXTERNAL, SALES, STRAY_COLUMNS


def read_sales(spark: SparkSession, paths: str | list[str], fmt: str = "csv") -> DataFrame:
    """Sale lines with the declared schema; ``paths`` may be globs or a list.

    No inference pass: the header is only checked against the schema.
    """
    if fmt == "csv":
        return spark.read.schema(SALES).option("header", True).option("enforceSchema", False).csv(paths)
    return spark.read.schema(SALES).format(fmt).load(paths)


def read_raw_strings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A text table as it came: every column a string, index columns dropped."""
    df = (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .option("inferSchema", False)
        .option("escape", '"')
        .csv(paths)
    )
    return df.drop(*STRAY_COLUMNS)


def with_source_file(df: DataFrame, name: str = "source_file") -> DataFrame:
    """Tag each row with the file it was read from."""
    return df.select("*", F.col("_metadata.file_name").alias(name))


def file_manifest(expected: list[str], df: DataFrame, name: str = "source_file") -> DataFrame:
    """Row count and status of every expected file stem."""
    stem = F.lower(F.regexp_replace(F.col(name), r"\.[^.]*$", ""))
    found = df.groupBy(stem.alias("file")).agg(F.count(F.lit(1)).alias("row_count"))
    wanted = literal_table(df.sparkSession, [(e.lower(),) for e in expected], ["file"])
    return wanted.join(found, "file", "left").select(
        "file",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.when(F.col("row_count").isNull(), F.lit("FILE NOT FOUND")).otherwise(F.lit("FOUND")).alias("status"),
    )


def resolve_aliases(df: DataFrame) -> DataFrame:
    """Rename known spellings of the contract columns (metadata only).

    A column that already has the contract name is taken and no alias of it is.
    """
    renames: dict[str, str] = {}
    for target, names in ALIASES.items():
        if target in df.columns:
            continue
        match = next((c for c in df.columns if c.lower() in names), None)
        if match is not None and match != target:
            renames[match] = target
    for target, word in ALIAS_WORDS.items():
        if target in df.columns:
            continue
        match = next((c for c in df.columns if word in c.lower() and c not in renames), None)
        if match is not None and match != target:
            renames[match] = target
    return df.withColumnsRenamed(renames)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Typed product master; of repeated ids the last record in the file wins."""
    text = read_raw_strings(spark, path).withColumn(
        # Position inside the scan, taken before any shuffle.
        "_position",
        F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()),
    )
    return clean_products(text, "_position")


def read_external(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Calendar, weather or commodity features."""
    return spark.read.schema(EXTERNAL[kind]).option("header", True).option("enforceSchema", False).csv(path)


def jdbc_options(url: str, table: str, partition_column: str | None = None, bounds=None, partitions: int = 64) -> dict:
    """Options of a relational read, split over ``partitions`` key ranges."""
    options = {"url": url, "dbtable": table, "fetchsize": "10000"}
    if partition_column is not None:
        low, high = bounds
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(partitions),
        }
    return options


def read_relational(spark: SparkSession, url: str, table: str, **split) -> DataFrame:
    """A database table; credentials come from the driver's own configuration."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **split)).load()
