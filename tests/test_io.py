"""Sources, sinks, scratch folder, streaming and the end-to-end jobs."""

import datetime as dt
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from stockloom.operators import validation
from stockloom.plans import jobs as plans
from stockloom.session import materialize, scratch_root, short_lived_shuffles, staged
from stockloom.sources import readers, sinks
from stockloom.streaming import jobs as streams


def test_raw_text_with_bom_and_index_columns(spark, tmp_path):
    path = tmp_path / "upload.csv"
    path.write_bytes("﻿date_,Unnamed: 0,city_name,note\n2022-04-01,1,Delhi,\"a, \"\"b\"\"\"\n".encode())
    raw = readers.read_raw_strings(spark, str(path))
    assert raw.columns == ["date_", "city_name", "note"]
    assert tuple(raw.first()) == ("2022-04-01", "Delhi", 'a, "b"')
    assert readers.with_source_file(raw).first()["source_file"] == "upload.csv"


def test_sales_with_another_header_are_refused(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text("day,city\n2022-04-01,Delhi\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_sales(spark, str(path)).collect()


def test_aliases(spark):
    df = spark.createDataFrame([(1,) * 6], "Date int, SKU int, qty int, Price int, Landing_Cost int, City int")
    assert readers.resolve_aliases(df).columns == [
        "date_", "product_id", "procured_quantity", "unit_selling_price", "total_weighted_landing_price", "city_name",
    ]


def test_last_product_record_in_the_file_wins(spark, tmp_path):
    path = tmp_path / "dim.csv"
    path.write_text("product_id,product_name,l0_category_id\n7.0,Old,1\n8,,2\n7,New,x\n,None,3\n")
    got = readers.read_products(spark, str(path)).collect()
    assert [(r["product_id"], r["product_name"], r["l0_category_id"]) for r in got] == [(7, "New", None)]


def test_relational_read_options():
    plain = readers.jdbc_options("jdbc:postgresql://host/db", "sales")
    assert "numPartitions" not in plain
    split = readers.jdbc_options("jdbc:postgresql://host/db", "sales", "id", (1, 100), 8)
    assert split["numPartitions"] == "8" and split["lowerBound"] == "1"


def test_publish_keeps_the_old_table_when_a_check_fails(spark, tmp_path):
    path = str(tmp_path / "table")
    checks = {"rows": (F.count(F.lit(1)), 5)}
    sinks.publish(spark.range(5), path, checks)
    with pytest.raises(ValueError, match="rows: expected 5.0, got 6.0"):
        sinks.publish(spark.range(6), path, checks)
    assert spark.read.parquet(path).count() == 5
    sinks.publish(spark.range(5, 10), path, checks)
    assert {r["id"] for r in spark.read.parquet(path).collect()} == set(range(5, 10))


def test_upsert_takes_the_latest_update(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, at int")
    assert sorted(tuple(r) for r in sinks.upsert(target, updates, ["k"], "at").collect()) == [(1, "a"), (2, "y"), (3, "z")]
    added = sinks.insert_missing(target, updates.where("at = 1").select("k", "v"), ["k"])
    assert sorted(tuple(r) for r in added.collect()) == [(1, "a"), (2, "b"), (3, "z")]


def test_scratch_folder_is_the_configured_one(spark):
    root = scratch_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
    df = materialize(spark.range(10))
    assert all(f.removeprefix("file://").startswith(root) for f in df.inputFiles())


def sale(minute, order, qty, day=1):
    return (dt.datetime(2022, 4, day, 10, minute), order, 1, "Delhi", qty)


SCHEMA = "ts timestamp, order_id string, product_id long, city_name string, procured_quantity double"


def write_batch(spark, rows, path, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{name}")


def test_streamed_days_equal_the_batch(spark, tmp_path):
    inbox = str(tmp_path / "in")
    batches = [
        [sale(0, "a", 2.0), sale(1, "b", 3.0)],
        [sale(2, "c", 5.0), sale(0, "d", 7.0, day=2)],
        [sale(0, "e", 1.0, day=9)],  # moves the watermark on
        [sale(0, "late", 100.0)],  # a day that is already final
        [sale(0, "f", 1.0, day=20)],
    ]
    for i, batch in enumerate(batches):
        write_batch(spark, batch, inbox, f"part={i}")
    stream = streams.read_stream(spark, f"{inbox}/*", SCHEMA, files_per_batch=1)
    out = str(tmp_path / "out")
    arrived = spark.read.schema(SCHEMA).parquet(f"{inbox}/*")
    progress = streams.run_daily_demand(stream, arrived, out, str(tmp_path / "progress"))
    got = {r["date_"].day: (r["daily_quantity"], r["line_count"]) for r in spark.read.parquet(f"{out}/closed").collect()}
    assert got[1] in ((10.0, 3), (110.0, 4)) and got[2] == (7.0, 1)
    assert 20 not in got  # still open
    still_open = {r["date_"].day: r["line_count"] for r in spark.read.parquet(f"{out}/open").collect()}
    assert still_open == {20: 1}
    # The late row is in neither table, but counted.
    assert progress.late_rows == (1 if got[1] == (10.0, 3) else 0) and progress.batches >= 5
    every = streams.read_daily_demand(spark, out)
    assert {(r["date_"].day, r["is_final"]) for r in every.collect()} == {(1, True), (2, True), (9, True), (20, False)}


def test_stored_sketches_unite_to_the_whole(spark):
    lines = spark.range(60_000).selectExpr(
        "id % 30 as day", "id % 3 as product_id", "'c' as city_name", "cast(pmod(hash(id), 20000) as string) as order_id"
    )
    daily = lines.groupBy("day", "product_id").agg(streams.distinct_sketch("order_id").alias("order_sketch"))
    for keys in (["product_id"], []):
        exact = {tuple(r[k] for k in keys): r["n"] for r in lines.groupBy(*keys).agg(F.countDistinct("order_id").alias("n")).collect()}
        united = streams.unite_sketches(daily, keys).withColumn("n", streams.sketch_count())
        for r in united.collect():
            want = exact[tuple(r[k] for k in keys)]
            assert abs(r["n"] - want) <= 0.05 * want  # three standard errors
    # United in two steps or one: the same sketch.
    twice = streams.unite_sketches(streams.unite_sketches(daily, ["product_id"]), []).select(streams.sketch_count()).first()[0]
    assert twice == streams.unite_sketches(daily, []).select(streams.sketch_count()).first()[0]


def validated_by_stream(tables, rows, tmp_path, files, name, per_batch=1, stop_after=None):
    spark = tables.spark
    inbox, target = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
    rows.repartition(files).write.parquet(inbox)
    stream = streams.read_stream(spark, inbox, rows.schema, files_per_batch=per_batch)
    streams.stream_validate(stream, tables.products, target, str(tmp_path / f"{name}-progress")).awaitTermination()
    return target, inbox


def read_split(spark, target):
    good = spark.read.parquet(f"{target}/accepted").drop("batch")
    bad = spark.read.parquet(f"{target}/rejected").withColumn("errors", F.concat_ws(",", "errors")).drop("batch")
    bad = bad.groupBy(*[c for c in bad.columns if c != "copies"]).agg(F.sum("copies").alias("copies"))
    return sorted(map(str, good.collect())), sorted(map(str, bad.collect()))


@pytest.mark.parametrize("files", [1, 3, 7])
def test_streamed_validation_equals_the_batch(tables, tmp_path, files):
    rows = tables.raw_sales.where("order_id < 400")
    rows = rows.union(rows.where("order_id < 20")).union(rows.where("order_id = 7"))
    target, _ = validated_by_stream(tables, rows, tmp_path, files, f"n{files}")
    whole = validation.validate_rows(rows, tables.products)
    bad = validation.rejected(whole).withColumn("errors", F.concat_ws(",", "errors"))
    bad = bad.groupBy(*[c for c in bad.columns if c != "copies"]).agg(F.sum("copies").alias("copies"))
    want = sorted(map(str, validation.accepted(whole).collect())), sorted(map(str, bad.collect()))
    assert read_split(tables.spark, target) == want


def test_streamed_validation_goes_on_after_a_restart(tables, tmp_path):
    spark = tables.spark
    rows = tables.raw_sales.where("order_id < 60")
    target, inbox = validated_by_stream(tables, rows, tmp_path, 2, "again")
    first = read_split(spark, target)
    # The same rows once more in new files: all of them are repeats now.
    rows.coalesce(1).write.mode("append").parquet(inbox)
    stream = streams.read_stream(spark, inbox, rows.schema, files_per_batch=1)
    streams.stream_validate(stream, tables.products, target, str(tmp_path / "again-progress")).awaitTermination()
    second = read_split(spark, target)
    assert second[0] == first[0]
    copies = spark.read.parquet(f"{target}/rejected").agg(F.sum("copies")).first()[0]
    assert copies + len(first[0]) == 2 * rows.count()


def test_stream_drops_repeats_across_batches(spark, tmp_path):
    inbox = str(tmp_path / "in")
    for i, batch in enumerate([[sale(0, "a", 2.0), sale(1, "b", 3.0)], [sale(0, "a", 2.0)], [sale(5, "c", 1.0)]]):
        write_batch(spark, batch, inbox, f"part={i}")
    stream = streams.read_stream(spark, f"{inbox}/*", SCHEMA, files_per_batch=1)
    out = str(tmp_path / "out")
    streams.run_to_table(streams.stream_dedup(stream, ["order_id"]), out, str(tmp_path / "progress"))
    assert sorted(r["order_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_upload_job(tables, tmp_path):
    outputs = plans.upload_job(tables.raw_sales, tables.products)
    plans.write_outputs(outputs, str(tmp_path))
    spark = tables.spark
    assert spark.read.parquet(str(tmp_path / "checks")).count() == 7
    job = spark.read.parquet(str(tmp_path / "job")).first()
    assert job["status"] == "COMPLETED"
    assert spark.read.parquet(str(tmp_path / "accepted")).count() == job["processed_rows"]


def test_forecast_and_anomaly_jobs(tables):
    forecast = plans.forecast_job(tables.panel, "2000-01-01", "2000-12-01", "2000-12-31", boost=False)
    comparison = forecast["model_comparison"].collect()
    assert len(comparison) == 10 and sum(r["is_best"] for r in comparison) == 1
    results = forecast["forecast_results"]
    assert results.where("pred_hybrid is null or pred_prophet is null").count() == 0
    anomalies = plans.anomaly_job(tables.panel, results, 0.05)
    stats = anomalies["statistics"].first()
    assert stats["total_anomalies"] == anomalies["demand_anomalies"].count() > 0
    assert stats["spike_count"] + stats["drop_count"] == stats["total_anomalies"]


def test_profile_cleaning_and_inventory_jobs(tables):
    profile = plans.profile_job(tables.sales, tables.products, "2000-01-01", "2000-12-31")
    assert profile["overview"].first()["total_rows"] == tables.sales.count()
    assert profile["segment_summary"].agg(F.sum("products")).first()[0] == profile["segments"].count()
    cleaned = plans.cleaning_job(tables.sales, tables.products)
    assert cleaned["sales_master"].count() == tables.sales.count()
    daily = cleaned["daily_demand"]
    stock = daily.select("product_id", "city_name").distinct().withColumn("current_stock", F.lit(5.0))
    inventory = plans.inventory_job(daily, cleaned["cost_lookup"], stock, "2000-01-01", "2000-12-31")
    assert inventory["recommendations"].count() == inventory["policy"].count() > 0


def test_repeats_are_looked_up_by_spark_itself(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    streams.ship_package(spark)
    streams.use_state_store(spark)
    columns = "digest string, text string"
    for i, digests in enumerate(["aab", "bbc", "ad"]):
        spark.createDataFrame([(d, None if d == "b" else f"row {d}") for d in digests], columns).coalesce(1).write.parquet(f"{inbox}/f={i}")
    rows = streams.read_stream(spark, f"{inbox}/*", spark.createDataFrame([], columns).schema, files_per_batch=1)
    seen = streams.seen_before(rows)
    # A call into Python per row would take longer than the limit at 1 GB.
    assert "TransformWithState" not in seen._jdf.queryExecution().logical().toString()

    def sums(batch, number):
        batch = batch.groupBy("digest", "text").agg(F.sum("copies").alias("copies"), F.max("new").alias("new"))
        batch.write.parquet(f"{out}/batch={number}")

    query = seen.writeStream.foreachBatch(sums).option("checkpointLocation", str(tmp_path / "progress"))
    query.trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["digest"], r["text"], r["copies"], r["new"]) for r in spark.read.parquet(out).where("copies > 0").collect())
    # Files of one moment may come in any order, so only what does not depend on it.
    assert sum(x[2] for x in got) == 8
    assert sorted(x[0] for x in got if x[3]) == ["a", "b", "c", "d"] and len(got) == 6


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString("\n").splitlines() if "/shuffle_" in f}


def left_after(spark, before, seconds=10):
    """Shuffle files beyond ``before``, once Spark had time to remove them."""
    until = time.time() + seconds
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    return left


def test_a_batch_of_the_validation_deals_its_rows_once_and_leaves_no_shuffle(tables, tmp_path, monkeypatch):
    spark, inbox = tables.spark, str(tmp_path / "in")
    rows = tables.raw_sales.where("order_id < 60")
    rows.union(rows.where("order_id < 20")).repartition(3).write.parquet(inbox)
    before, left, plans_, validate = shuffle_files(spark), [], [], streams.validate_rows

    def looked_at(once, *args, **named):
        left.append(left_after(spark, before))
        validated = validate(once, *args, **named)
        plans_.append(validated._jdf.queryExecution().executedPlan().toString())
        return validated

    monkeypatch.setattr(streams, "validate_rows", looked_at)
    stream = streams.read_stream(spark, inbox, rows.schema, files_per_batch=1)
    query = streams.stream_validate(stream, tables.products, str(tmp_path / "out"), str(tmp_path / "progress"))
    query.awaitTermination()
    assert len(left) == 3 and not any(left) and not left_after(spark, before)
    # Rows come dealt by digest; only the join with the products may deal them again.
    assert {key for p in plans_ for key in re.findall(r"Exchange hashpartitioning\((\w+)#", p)} <= {"parsed_product_id"}
    plan = query._jsq.explainInternal(False)
    assert plan.count("MapInArrow") == 1 and plan.count("ReusedExchange") == 1


def test_staged_rows_are_removed_and_settings_put_back(spark):
    key, paths = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(key)
    for fails in (False, True):
        try:
            with staged(spark.range(5).repartition(3)) as rows:
                paths += [f.removeprefix("file://") for f in rows.inputFiles()]
                assert rows.count() == 5 and all(map(os.path.exists, paths[-3:]))
                if fails:
                    raise KeyError
        except KeyError:
            assert fails
    assert paths and not any(os.path.exists(os.path.dirname(p)) for p in paths)
    with short_lived_shuffles(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before
