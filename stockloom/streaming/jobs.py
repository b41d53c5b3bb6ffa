"""Structured Streaming jobs over arriving sale files."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stockloom.operators.validation import accepted, rejected, validate_rows
from stockloom.schemas import SALES_COLUMNS, SERIES_KEY
from stockloom.session import ship_package, short_lived_shuffles, staged

# Digests share this many state groups: enough to spread, few enough to keep groups large.
STATE_GROUPS = 4096
# Size of a distinct-count sketch: 2^12 registers, a standard error of 1.6 %.
SKETCH_BITS = 12


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


# ---- validation -------------------------------------------------------------


class _SeenRows(StatefulProcessor):
    """Tells whether a row came before; counts are kept in the state store."""

    def __init__(self, keep_ms: int, digest: str):
        self.keep_ms = keep_ms
        self.digest = digest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", f"digest {self.digest}", "copies long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            new = [self._count(digest, copies) == 0 for digest, copies in zip(batch["digest"], batch["copies"])]
            yield batch.drop(columns="state_group").assign(new=new)

    def _count(self, digest: str | bytes, copies: int) -> int:
        found = self.seen.getValue((digest,))
        before = 0 if found is None else int(found[0])
        self.seen.updateValue((digest,), (before + int(copies),))
        return before

    def close(self) -> None:
        pass


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies of a row that stand in one Arrow batch as one row with their number."""
    for batch in batches:
        columns = batch.schema.names
        table = pa.Table.from_batches([batch]).group_by(columns).aggregate([([], "count_all")])
        yield from table.select([*columns, "count_all"]).rename_columns([*columns, "copies"]).to_batches()


def seen_before(rows: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """A stream of rows with their ``digest`` as (..., copies, new), to be summed within a batch.

    Per row of a batch ``copies`` adds up to how often it stands there, and one line
    has ``new`` if it came in no batch before.  The state store holds one entry per
    digest; a batch touches the entries of its own rows alone, whatever came before.
    Spark itself looks the digests up, as a call into Python per row takes longer than
    all the rest.  Copies in one Arrow batch become one row before the shuffle, so a
    row that comes very often is a few rows to its task.  Rows are dealt by digest once:
    the look-up and the counts read the same shuffle, and grouping by digest needs none.

    ``keep_ms`` forgets a digest that has not come for so long.  Spark's own repeats
    expire by their first arrival, so these counts are kept row by row in Python.
    """
    counted = rows.mapInArrow(_copies, T.StructType([*rows.schema.fields, T.StructField("copies", T.LongType())]))
    if keep_ms is None:
        dealt = counted.repartition("digest")
        # Read from the column, so that both sides have the same columns and share one shuffle.
        first = dealt.dropDuplicates(["digest"]).withColumn("copies", F.col("copies") * 0)
        return dealt.withColumn("new", F.lit(False)).unionByName(first.withColumn("new", F.lit(True)))
    return (
        counted.withColumn("state_group", F.pmod(F.xxhash64("digest"), F.lit(STATE_GROUPS)))
        .groupBy("state_group")
        .transformWithStateInPandas(
            _SeenRows(keep_ms, rows.schema["digest"].dataType.simpleString()),
            outputStructType=T.StructType([*counted.schema.fields, T.StructField("new", T.BooleanType())]),
            outputMode="Append",
            timeMode="ProcessingTime",
        )
    )


def use_state_store(spark: SparkSession) -> None:
    """Named state needs the RocksDB store; it also keeps state out of the executors' heap."""
    store = "spark.sql.streaming.stateStore"
    spark.conf.set(f"{store}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # Counting the entries would look every new one up a second time.
    spark.conf.set(f"{store}.rocksdb.trackTotalNumberOfRows", "false")


def stream_validate(
    raw: DataFrame, products: DataFrame, target: str, checkpoint: str, keep_ms: int | None = None
) -> StreamingQuery:
    """Split arriving text rows into accepted and rejected tables.

    The state store tells whether a row came in earlier batches, so a row seen
    before is a repeat however the files were dealt into batches, and the work of a
    batch depends on its own rows only.  Each micro-batch writes below its own batch
    number, so a batch repeated after a failure overwrites its first attempt; Spark
    commits the state with the batch.  Of a row the state keeps the 32 bytes of its digest.
    """
    spark = raw.sparkSession
    ship_package(spark)
    use_state_store(spark)
    text = F.to_json(F.struct(*SALES_COLUMNS), {"ignoreNullFields": "false"})
    rows = raw.select(*[F.col(c).cast("string").alias(c) for c in SALES_COLUMNS], F.unhex(F.sha2(text, 256)).alias("digest"))

    def split(batch: DataFrame, number: int) -> None:
        once = batch.groupBy("digest", *SALES_COLUMNS).agg(F.sum("copies").alias("_total"), F.max("new").alias("_new"))
        validated = validate_rows(once, products, by=["digest", "_total", "_new"])

        def copy(n: Column, repeated: bool) -> Column:
            return F.struct(n.alias("copies"), F.lit(repeated).alias("repeated"))

        new, total = F.col("_new"), F.col("_total")
        parts = F.array(F.when(new, copy(F.lit(1).cast("long"), False)), copy(F.when(new, total - 1).otherwise(total), True))
        parts = F.filter(parts, lambda p: p.isNotNull() & (p["copies"] > 0))
        validated = validated.drop("copies").withColumn("_c", F.explode(parts))
        errors = F.when(F.col("_c.repeated"), F.array_append("errors", F.lit("duplicate_row"))).otherwise(F.col("errors"))
        validated = validated.withColumn("errors", errors).withColumn("copies", F.col("_c.copies"))
        with staged(validated.drop("digest", "_total", "_new", "_c")) as validated:
            accepted(validated).write.mode("overwrite").parquet(f"{target}/accepted/batch={number}")
            rejected(validated).write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")

    writer = seen_before(rows, keep_ms).writeStream.foreachBatch(split).outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with short_lived_shuffles(spark):  # the stream keeps the settings it is started with
        return writer.start()


# ---- daily demand with mergeable counts --------------------------------------


def distinct_sketch(column: str, bits: int = SKETCH_BITS) -> Column:
    """Aggregate: a sketch of the distinct values of a column, to be stored and united later."""
    return F.hll_sketch_agg(F.col(column), F.lit(bits))


def unite_sketches(df: DataFrame, keys: list[str], sketch: str = "order_sketch") -> DataFrame:
    """(keys, sketch): stored sketches united over days, batches or series."""
    return df.groupBy(*keys).agg(F.hll_union_agg(sketch).alias(sketch))


def sketch_count(sketch: str = "order_sketch") -> Column:
    """The estimated number of distinct values in a sketch."""
    return F.hll_sketch_estimate(sketch)


def _daily(rows: DataFrame, day: Column, keys: list[str], order: str) -> DataFrame:
    return rows.groupBy(day, *keys).agg(
        F.sum("procured_quantity").alias("daily_quantity"),
        F.count(F.lit(1)).alias("line_count"),
        distinct_sketch(order).alias("order_sketch"),
    )


def stream_daily_demand(
    sales: DataFrame, delay: str = "2 days", time: str = "ts", keys: list[str] = SERIES_KEY, order: str = "order_id"
) -> DataFrame:
    """Demand per day and series; a day is final once the watermark has passed it.

    ``order_sketch`` can be united over days and series (``unite_sketches``), which
    an estimate alone could not.  State is bounded by the days that are still open.
    """
    days = _daily(sales.withWatermark(time, delay), F.window(time, "1 day"), keys, order)
    return days.select(F.to_date("window.start").alias("date_"), *keys, "daily_quantity", "line_count", "order_sketch")


@dataclass(frozen=True)
class Progress:
    """What a finished run of a stream says: its watermark and the rows that came too late."""

    watermark: str | None
    late_rows: int
    batches: int


def run_daily_demand(
    stream: DataFrame,
    arrived: DataFrame,
    path: str,
    checkpoint: str,
    delay: str = "2 days",
    time: str = "ts",
    keys: list[str] = SERIES_KEY,
    order: str = "order_id",
) -> Progress:
    """Append the days that the watermark has closed, and write the open ones beside them.

    ``arrived`` is the same source read as a table.  ``{path}/closed`` only grows and
    never changes what it has; ``{path}/open`` is replaced as a whole and holds the
    days from the watermark on.  Rows later than the watermark are counted, not
    added.
    """
    query = (
        stream_daily_demand(stream, delay, time, keys, order)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .format("parquet")
        .option("path", f"{path}/closed")
        .start()
    )
    query.awaitTermination()
    # One entry per batch of this run.
    reports = [json.loads(report.json) for report in query.recentProgress]
    marks = [r["eventTime"]["watermark"] for r in reports if "watermark" in r.get("eventTime", {})]
    late = sum(op.get("numRowsDroppedByWatermark", 0) for r in reports for op in r.get("stateOperators", []))
    watermark = max(marks, default=None)
    if watermark is not None and watermark.startswith("1970-01-01"):
        watermark = None
    still_open = arrived if watermark is None else arrived.where(F.window(time, "1 day")["end"] > F.lit(watermark).cast("timestamp"))
    days = _daily(still_open, F.to_date(time).alias("date_"), keys, order)
    days.write.mode("overwrite").parquet(f"{path}/open")
    return Progress(watermark, late, len(reports))


def read_daily_demand(spark: SparkSession, path: str) -> DataFrame:
    """Closed and open days, told apart by ``is_final``."""
    parts = [spark.read.parquet(f"{path}/{name}").withColumn("is_final", F.lit(name == "closed")) for name in ("closed", "open")]
    return parts[0].unionByName(parts[1])


# ---- repeats -------------------------------------------------------------------


def stream_dedup(source: DataFrame, keys: list[str], delay: str = "2 days", time: str = "ts") -> DataFrame:
    """Drop repeats of a key that arrive within the watermark delay."""
    return source.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything the stream gives to a table, then stop."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.format("parquet").option("path", path).start().awaitTermination()
