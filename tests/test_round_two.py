"""Edge cases of quantiles, sinks, readers, streams and the forest."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.functions.quantiles import _holding, _part, _value_bucket, exact_quantiles
from stockloom.functions.scalars import parse_double
from stockloom.operators import audits, isolation
from stockloom.sources import readers, sinks
from stockloom.streaming import jobs


@pytest.mark.parametrize(
    "values",
    [
        [random.Random(1).uniform(0.35, 0.9) for _ in range(3000)],
        [1e9 + k / 3 for k in range(2000)],
        [0.0, -0.0, 1e-300, -1e300, 1e300, 5.0, -5.0],
        [7.0] * 50,
    ],
)
def test_quantiles_of_crowded_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_quantiles(df, [], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    for name, q in (("a", 0.1), ("b", 0.5), ("c", 0.99)):
        assert math.isclose(row[name], np.quantile(values, q), rel_tol=1e-9, abs_tol=1e-300)


def test_quantiles_with_infinite_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(v,) for v in [-inf, 1.0, 2.0, 3.0, inf, nan, None]], "v double")
    row = exact_quantiles(df, [], "v", {"low": 0.2, "mid": 0.4}, count_name="n").first()
    assert (row["low"], row["mid"], row["n"]) == (1.0, 2.0, 6)


def test_no_part_is_large(spark):
    values = [0.35 + 0.55 * k / 20000 for k in range(20000)]
    counted = (
        spark.createDataFrame([(v,) for v in values], "_v double")
        .withColumns({"_n": F.lit(1), "_b": _value_bucket(F.col("_v")), "_offset": F.lit(0), "_total": F.lit(None).cast("long")})
    )
    median = [(F.col("_total") - 1) * 0.5]
    near = _holding(counted, [], "_b", median).withColumn("_p", _part(F.col("_v"), F.col("_low"), F.col("_high")))
    assert _holding(near, ["_b"], "_p", median).count() <= 4


def test_infinite_text_is_no_number(spark):
    df = spark.createDataFrame([(t,) for t in ["Infinity", "-inf", "1e400", "NaN", "1e3", " 2 ", "x"]], "t string")
    assert [r[0] for r in df.select(parse_double("t")).collect()] == [None, None, None, None, 1000.0, 2.0, None]


def test_insert_missing_takes_one_row_per_key(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(2, "y"), (2, "x"), (2, "x"), (1, "z")], "k int, v string")
    assert sorted(map(tuple, sinks.insert_missing(target, new, ["k"]).collect())) == [(1, "a"), (2, "x")]
    keys = sinks.insert_missing(target.select("k"), new.select("k"), ["k"])
    assert sorted(map(tuple, keys.collect())) == [(1,), (2,)]


def test_stored_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(path)
    updates = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, at int")
    sinks.upsert_table(path, updates, ["k"], "at")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_publish_puts_the_old_table_back(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.publish(spark.range(3), path, {})
    rename, calls = sinks._rename, []

    def failing(files, source, target):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("no")
        rename(files, source, target)

    monkeypatch.setattr(sinks, "_rename", failing)
    with pytest.raises(OSError):
        sinks.publish(spark.range(9), path, {})
    assert spark.read.parquet(path).count() == 3


def test_contract_names_win_over_aliases(spark):
    for names in (["date", "date_"], ["capacity", "city_name"], ["city_name", "capacity"]):
        df = spark.createDataFrame([(1, 2)], ", ".join(f"{n} int" for n in names))
        assert readers.resolve_aliases(df).columns == names


@pytest.mark.parametrize("per_batch", [None, 1])
def test_repeats_across_batches(spark, tables, tmp_path, per_batch):
    raw = tables.raw_sales.limit(40).cache()
    for k in range(3):  # the same lines in three files
        raw.coalesce(1).write.parquet(str(tmp_path / f"inbox/f={k}"))
    files = str(tmp_path / "inbox/f=*")
    stream = jobs.read_stream(spark, files, raw.schema, files_per_batch=per_batch)
    target = str(tmp_path / "out")
    jobs.stream_validate(stream, tables.products, target, str(tmp_path / "progress")).awaitTermination()
    good, bad = spark.read.parquet(f"{target}/accepted").count(), spark.read.parquet(f"{target}/rejected")
    assert good + bad.agg(F.sum("copies")).first()[0] == 3 * raw.count()
    assert bad.where(F.array_contains("errors", "duplicate_row")).agg(F.sum("copies")).first()[0] == 3 * raw.count() - raw.distinct().count()


def test_order_counts_of_one_side_are_seen(spark):
    sales = spark.createDataFrame([("d", "p", None, 1), ("d", "q", "c", 2)], "date_ string, product_id string, city_name string, order_id int")
    demand = spark.createDataFrame([("d", "p", None, 1), ("d", "r", "c", 4)], "date_ string, product_id string, city_name string, order_count long")
    row = audits.verify_order_count(sales, demand).first()
    assert (row["rows_compared"], row["only_in_sales"], row["only_in_demand"], row["mismatched"]) == (1, 1, 1, 0)


def test_trees_are_drawn_from_all_rows(spark):
    df = spark.range(20000).select("id", (F.rand(1) * 10).alias("a"))
    forest = isolation.fit_forest(df, ["a"], ["id"], trees=60)
    assert forest.sample == 256
    assert all(size[0] == 256 for size in forest.size)
    cuts = Counter(round(float(c[0]), 6) for c in forest.cut)
    assert len(cuts) > 50


def test_context_of_a_conversation(spark):
    from stockloom.operators import messages

    turns = [
        (1, "user", "How is SKU #123 doing in Delhi?"),
        (2, "assistant", "Recommended order: 1,250 units of it."),
        (3, "user", "and in Mumbai for product 4567?"),
        (4, "assistant", "order quantity: 0 units"),
        (5, "user", "why?"),
        (6, "assistant", "quantity 30.5 units"),
        (7, "user", "ok"),
    ]
    df = spark.createDataFrame([(9, *t) for t in turns], "conv_id long, turn long, role string, text string")
    rows = {r["turn"]: r for r in messages.fill_from_context(messages.conversation_context(df)).collect()}
    assert rows[1]["current_product_id"] is None and rows[1]["product_ids"] == [123] and rows[1]["cities"] == ["Delhi"]
    assert (rows[3]["current_product_id"], rows[3]["current_city"], rows[3]["current_order_qty"]) == (123, "Delhi", 1250.0)
    # Both product and city stand in turn 3, so older quantities do not count.
    assert (rows[5]["current_product_id"], rows[5]["current_city"], rows[5]["current_order_qty"]) == (4567, "Mumbai", None)
    assert rows[5]["product_ids"] == [4567] and rows[5]["cities"] == ["Mumbai"]
    assert rows[7]["current_order_qty"] == 30.5
