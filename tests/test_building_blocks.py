"""Quantiles, running totals, samples and parsing against brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.functions.quantiles import exact_quantiles, quantile_values
from stockloom.functions.running import carry_last, ordered_totals
from stockloom.functions.sampling import hash_sample
from stockloom.functions.scalars import parse_date, parse_double, parse_id, parse_iso_date, product_label
from stockloom.session import configure

PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}


@pytest.mark.parametrize("seed", range(3))
def test_exact_quantiles_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    # One key holds most rows; values repeat, are negative, zero and large.
    keys = rng.choice(["hot", "a", "b", "c"], 4000, p=[0.7, 0.1, 0.1, 0.1])
    values = np.round(np.concatenate([rng.normal(0, 50, 2000), rng.lognormal(5, 3, 1500), np.zeros(500)]), 2)
    rng.shuffle(values)
    df = spark.createDataFrame(list(zip(keys.tolist(), values.tolist())), "k string, v double")
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", PROBS, "n").collect()}
    for key in set(keys):
        part = values[keys == key]
        assert got[key]["n"] == len(part)
        for name, p in PROBS.items():
            assert got[key][name] == pytest.approx(np.quantile(part, p), rel=1e-12, abs=1e-12)
    whole = df.limit(1).select(quantile_values(df, "v", PROBS).alias("q")).first()["q"]
    for name, p in PROBS.items():
        assert whole[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_quantiles_ignore_nulls_and_empty_groups(spark):
    df = spark.createDataFrame([("a", None), ("a", 3.0), ("b", None)], "k string, v double")
    assert [tuple(r) for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()] == [("a", 3.0)]


def test_ordered_totals_match_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(v)) for i, v in enumerate(rng.integers(0, 20, 700))]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    got = ordered_totals(df, [F.desc("v"), F.asc("k")], {"run": "v"}).orderBy("row_rank").collect()
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r["k"], r["v"]) for r in got] == expected
    assert [r["row_rank"] for r in got] == list(range(1, 701))
    assert [r["run"] for r in got] == np.cumsum([v for _, v in expected]).tolist()
    assert {r["v_total"] for r in got} == {sum(v for _, v in rows)}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_carry_last_over_blocks(spark, block):
    rng = np.random.default_rng(1)
    rows = [(k, i, int(v) if v < 4 else None) for k in ("x", "y") for i, v in enumerate(rng.integers(0, 9, 60))]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {(r["k"], r["i"]): r["prev"] for r in carry_last(df, ["k"], "i", {"prev": "v"}, block).collect()}
    for key in ("x", "y"):
        last = None
        for k, i, v in rows:
            if k == key:
                assert got[(k, i)] == last
                last = v if v is not None else last


def test_hash_sample_does_not_depend_on_partitioning(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    one = {r["k"] for r in hash_sample(df.repartition(3), 500, ["k"]).collect()}
    two = {r["k"] for r in hash_sample(df.repartition(11), 500, ["k"]).collect()}
    assert len(one) == 500 and one == two
    assert hash_sample(df.limit(20), 500, ["k"]).count() == 20


def test_parsing(spark):
    day = dt.date(2000, 1, 5)
    cases = {
        "2000-01-05": day, "2000-1-5": day, "05-01-2000": day, "2000/01/05": day, "5/1/2000": day, " 2000-01-05 ": day,
        "31-31-2000": None, "2000-13-01": None, "2000-01/05": None, "": None, "soon": None, "20000-01-05": None,
        "2000-01-05 10:00": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r["s"]: r["d"] for r in df.select("s", parse_date("s").alias("d")).collect()} == cases
    iso = {r["s"]: r["d"] for r in df.select("s", parse_iso_date("s").alias("d")).collect()}
    assert iso["2000-01-05"] == day and iso["05-01-2000"] is None and iso["2000/01/05"] is None
    numbers = {"12": 12.0, "12.0": 12.0, " 3 ": 3.0, "1e3": 1000.0, "nan": None, "NaN": None, "": None, "1,5": None, "-2": -2.0}
    df = spark.createDataFrame([(k,) for k in numbers], "s string")
    assert {r["s"]: r["n"] for r in df.select("s", parse_double("s").alias("n")).collect()} == numbers
    ids = {r["s"]: r["n"] for r in df.select("s", parse_id("s").alias("n")).collect()}
    assert ids["12.0"] == 12 and ids["1,5"] is None and ids["nan"] is None


def test_product_label(spark):
    df = spark.createDataFrame([(7, " Milk "), (8, None), (9, " ")], "i int, n string")
    assert [r[0] for r in df.select(product_label("i", "n")).collect()] == [
        "Milk (Product ID: 7)",
        "Product name is unavailable; Product ID: 8",
        "Product name is unavailable; Product ID: 9",
    ]


def test_null_keys_are_groups_too(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    got = {r["k"]: r["m"] for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {None: 2.0, "a": 5.0}
    turns = spark.createDataFrame([(None, 0, 7), (None, 1, None), (None, 2, None)], "k string, i int, v int")
    carried = carry_last(turns, ["k"], "i", {"prev": "v"}, block=1).orderBy("i").collect()
    assert [r["prev"] for r in carried] == [None, 7, 7]


def test_a_task_reads_a_bounded_share_of_a_shuffle(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    assert configure(spark.newSession()).conf.get(key) == "16m"
    other = spark.newSession()
    other.conf.set(key, "8m")
    assert configure(other).conf.get(key) == "8m"
