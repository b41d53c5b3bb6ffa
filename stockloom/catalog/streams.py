"""Streaming queries: files are processed to the end, then the result is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.catalog.quality import VALIDATED
from stockloom.catalog.registry import query
from stockloom.session import scratch_path, short_lived_shuffles
from stockloom.streaming import jobs


def _events(t):
    """The events as an arriving stream of sale lines."""
    schema = t.read("events").schema
    return _sale_lines(jobs.read_stream(t.spark, f"{t.directory}/event[s].parquet", schema))


def _sale_lines(events):
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("product_id"),
        (F.col("user_id") % 4).cast("string").alias("city_name"),
        F.col("value").alias("procured_quantity"),
        F.col("event_id").alias("order_id"),
        "user_id",
    )


@query(
    "str01_validate_stream",
    f"""WITH {VALIDATED} SELECT len(errors) = 0 AS is_valid, city_name, COUNT(*) AS row_count FROM validated GROUP BY 1, 2""",
)
def _(t):
    inbox, target = scratch_path(t.spark, "inbox"), scratch_path(t.spark, "validated")
    with short_lived_shuffles(t.spark):
        t.raw_sales.repartition(6).write.parquet(inbox)
    stream = jobs.read_stream(t.spark, inbox, t.raw_sales.schema, files_per_batch=2)
    jobs.stream_validate(stream, t.products, target, scratch_path(t.spark, "progress")).awaitTermination()
    good = t.spark.read.parquet(f"{target}/accepted").groupBy("city_name").agg(F.count(F.lit(1)).alias("row_count"))
    bad = t.spark.read.parquet(f"{target}/rejected").groupBy("city_name").agg(F.sum("copies").alias("row_count"))
    return good.withColumn("is_valid", F.lit(True)).unionByName(bad.withColumn("is_valid", F.lit(False)))


@query(
    "str02_daily_demand_stream",
    """SELECT CAST(ts AS DATE) AS date_, event_type AS product_id, CAST(user_id % 4 AS VARCHAR) AS city_name, ROUND(SUM(value), 4) AS daily_quantity, COUNT(*) AS line_count,
    abs(COUNT(*) - COUNT(DISTINCT event_id)) <= greatest(1, 0.08 * COUNT(DISTINCT event_id)) AS near_order_count,
    date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 2 DAY FROM events) AS is_final
    FROM events GROUP BY 1, 2, 3, 7""",
)
def _(t):
    rows = _daily_demand(t)
    # Every event is an order of its own, so the lines tell how far off the sketch is.
    off = F.abs(jobs.sketch_count() - F.col("line_count"))
    near = off <= F.greatest(F.lit(1.0), 0.08 * F.col("line_count"))
    rows = rows.withColumn("near_order_count", near).drop("order_sketch")
    return rows.withColumn("daily_quantity", F.round("daily_quantity", 4))


def _daily_demand(t):
    path = scratch_path(t.spark, "daily")
    arrived = _sale_lines(t.read("events"))
    jobs.run_daily_demand(_events(t), arrived, path, scratch_path(t.spark, "progress"))
    return jobs.read_daily_demand(t.spark, path)


@query(
    "str02_united_order_counts",
    """SELECT event_type AS product_id, COUNT(*) AS line_count, abs(COUNT(DISTINCT event_id) - COUNT(*)) <= 0.06 * COUNT(*) AS near_order_count
    FROM events GROUP BY 1""",
)
def _(t):
    rows = _daily_demand(t)
    lines = rows.groupBy("product_id").agg(F.sum("line_count").alias("line_count"))
    counts = jobs.unite_sketches(rows, ["product_id"]).select(F.col("product_id").alias("of"), jobs.sketch_count().alias("orders"))
    near = F.abs(F.col("orders") - F.col("line_count")) <= 0.06 * F.col("line_count")
    return lines.join(counts, F.col("product_id") == F.col("of")).select("product_id", "line_count", near.alias("near_order_count"))


@query("str03_dedup_stream", "SELECT DISTINCT event_type AS product_id, user_id FROM events")
def _(t):
    path = scratch_path(t.spark, "unique")
    unique = jobs.stream_dedup(_events(t), ["product_id", "user_id"], "60 days").select("product_id", "user_id")
    jobs.run_to_table(unique, path, scratch_path(t.spark, "progress"))
    return t.spark.read.parquet(path)
