"""Versioned tables: one version at a time, conflicts, rewriting of files that hold a key."""

import threading

import pytest
from pyspark.sql import functions as F

from stockloom.sources import snapshots as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def numbers(spark, start, stop, name="a"):
    return spark.range(start, stop).select(F.col("id").alias("k"), F.concat(F.lit(name), F.col("id").cast("string")).alias("v"))


def test_versions_follow_each_other(spark, path):
    assert S.snapshot(spark, path) is None
    with pytest.raises(FileNotFoundError):
        S.read_snapshot(spark, path)
    S.publish_snapshot(numbers(spark, 0, 5), path)
    S.publish_snapshot(numbers(spark, 5, 7), path)
    assert S.versions(spark, path) == [1, 2]
    assert rows(S.read_snapshot(spark, path)) == [(5, "a5"), (6, "a6")]
    assert S.read_snapshot(spark, path, 1).count() == 5


def test_an_old_reader_keeps_its_version(spark, path):
    S.publish_snapshot(numbers(spark, 0, 50), path)
    reader = S.read_snapshot(spark, path)
    S.publish_snapshot(numbers(spark, 0, 1), path)
    assert reader.count() == 50 and S.read_snapshot(spark, path).count() == 1


def test_failed_checks_commit_nothing(spark, path):
    S.publish_snapshot(numbers(spark, 0, 3), path)
    with pytest.raises(Exception):
        S.publish_snapshot(numbers(spark, 0, 9), path, {"no_rows": (F.count(F.lit(1)), 0)})
    assert S.versions(spark, path) == [1] and S.read_snapshot(spark, path).count() == 3


def test_a_writer_that_dies_before_its_commit_leaves_the_table_as_it_is(spark, path, monkeypatch):
    S.publish_snapshot(numbers(spark, 0, 3), path)
    with monkeypatch.context() as m:
        m.setattr(S, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            S.publish_snapshot(numbers(spark, 0, 9), path)
    assert S.read_snapshot(spark, path).count() == 3
    assert len(S.remove_unused(spark, path)) == 1  # what it had written
    assert S.read_snapshot(spark, path).count() == 3


def test_of_two_writers_one_must_try_again(spark, path):
    S.publish_snapshot(numbers(spark, 0, 3), path)
    base = S.snapshot(spark, path)
    S.commit(spark, path, base, base)
    with pytest.raises(S.Conflict):
        S.commit(spark, path, base, base)
    assert S.versions(spark, path) == [1, 2]


def test_writers_at_the_same_time_lose_nothing(spark, path):
    S.publish_snapshot(numbers(spark, 0, 10), path, keys=["k"])
    failed = []

    def write(n):
        try:
            updates = numbers(spark, 10 * n, 10 * n + 10, f"w{n}-").withColumn("at", F.lit(n))
            S.upsert_snapshot(path, updates, "at", attempts=10)
        except Exception as error:  # told to the test below
            failed.append(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(1, 4)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join(120)
    assert not failed
    assert S.versions(spark, path) == [1, 2, 3, 4]
    got = S.read_snapshot(spark, path)
    assert got.count() == 40 == got.select("k").distinct().count()


def ranged(spark, path, n=4000, parts=8):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        return S.publish_snapshot(numbers(spark, 0, n).withColumn("at", F.lit(0)), path, keys=["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def full_upsert(before, updates):
    out = {r[0]: r for r in before}
    for r in sorted(updates, key=lambda r: r[2]):
        out[r[0]] = r
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("filter_bytes", [0, S.FILTER_BYTES])
def test_files_without_a_key_keep_their_names(spark, path, filter_bytes):
    first = ranged(spark, path)
    assert len(first.files) == 8
    before = rows(S.read_snapshot(spark, path))
    updates = [(3, "x", 1), (3, "y", 2), (17, "z", 1), (9000, "new", 1)]
    df = spark.createDataFrame(updates, "k long, v string, at int")
    second = S.upsert_snapshot(path, df, "at", filter_bytes=filter_bytes)
    assert len(set(first.files) & set(second.files)) == 7
    assert rows(S.read_snapshot(spark, path)) == full_upsert(before, updates)


def test_filters_spare_files_whose_range_holds_the_key(spark, path):
    even = numbers(spark, 0, 2000).select((F.col("k") * 2).alias("k"), "v", F.lit(0).alias("at"))
    first = S.publish_snapshot(even, path, keys=["k"])
    odd = spark.createDataFrame([(2 * k + 1, "odd", 1) for k in range(0, 1900, 190)], "k long, v string, at int")
    near = S.touched_files(spark, path, first, odd, filter_bytes=0)
    assert len(S.touched_files(spark, path, first, odd)) < len(near) or len(near) == len(first.files) == 1
    again = S.upsert_snapshot(path, odd, "at")
    assert S.read_snapshot(spark, path).count() == 2010 and again.version == 2


def test_null_keys_are_added_and_replace_nothing(spark, path):
    start = spark.createDataFrame([(None, "n", 0), (1, "a", 0)], "k long, v string, at int")
    S.publish_snapshot(start, path, keys=["k"])
    S.upsert_snapshot(path, spark.createDataFrame([(None, "m", 1), (1, "b", 1)], "k long, v string, at int"), "at")
    assert rows(S.read_snapshot(spark, path)) == [(1, "b", 1), (None, "m", 1), (None, "n", 0)]


def test_two_part_keys_and_empty_updates(spark, path):
    start = spark.createDataFrame([(k % 5, f"c{k}", float(k), 0) for k in range(200)], "a long, b string, v double, at int")
    first = S.publish_snapshot(start, path, keys=["a", "b"])
    same = S.upsert_snapshot(path, start.limit(0), "at")
    assert set(first.files) <= set(same.files)
    updates = spark.createDataFrame([(3, "c8", -1.0, 1), (3, "c9", -2.0, 1)], "a long, b string, v double, at int")
    S.upsert_snapshot(path, updates, "at")
    got = {(r.a, r.b): r.v for r in S.read_snapshot(spark, path).collect()}
    assert got[3, "c8"] == -1.0 and got[3, "c9"] == -2.0 and len(got) == 201


def test_update_and_clean_up(spark, path):
    S.publish_snapshot(numbers(spark, 0, 10), path)
    S.update_snapshot(spark, path, lambda df: df.where("k < 4"))
    S.update_snapshot(spark, path, lambda df: df.where("k < 2"))
    S.remove_unused(spark, path, keep=1)
    assert S.versions(spark, path) == [3] and rows(S.read_snapshot(spark, path)) == [(0, "a0"), (1, "a1")]
