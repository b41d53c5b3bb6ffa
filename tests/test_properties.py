"""Properties that must hold for any data."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators import cleaning, demand, features, forecasting, inventory, segments, validation


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(3)
    start = dt.date(2022, 4, 1)
    data = [
        (start + dt.timedelta(days=int(d)), p, c, float(q))
        for p in (1, 2, 3)
        for c in ("Delhi", "Mumbai")
        for d, q in zip(rng.choice(100, 60, replace=False), rng.integers(0, 30, 60))
    ]
    return spark.createDataFrame(data, "date_ date, product_id long, city_name string, daily_quantity double").cache()


def test_grid_is_complete_and_keeps_the_demand(daily):
    grid = features.calendar_grid(daily, "2022-04-01", "2022-07-10")
    audit = features.feature_audit(grid, "2022-04-01", "2022-07-10").first()
    assert audit["series"] == 6 and audit["expected_rows"] == audit["actual_rows"] == 606
    assert audit["incomplete_series"] == 0 and audit["null_rows"] == 0
    assert grid.agg(F.sum("daily_quantity")).first()[0] == daily.agg(F.sum("daily_quantity")).first()[0]


def test_grid_does_not_shuffle_its_rows(daily):
    grid = features.calendar_grid(daily, "2022-04-01", "2022-07-10")
    plan = features.feature_frame(grid)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_features_never_look_ahead(daily):
    cut = dt.date(2022, 6, 20)
    changed = daily.withColumn(
        "daily_quantity", F.when(F.col("date_") >= F.lit(cut), F.col("daily_quantity") * 7 + 5).otherwise(F.col("daily_quantity"))
    )
    before = F.col("date_") <= F.lit(cut)
    out = []
    for source in (daily, changed):
        frame = features.feature_frame(features.calendar_grid(source, "2022-04-01", "2022-07-10"))
        out.append(rows(frame.where(before).drop("daily_quantity")))
    assert out[0] == out[1]


@pytest.mark.parametrize("parts", [1, 13])
def test_results_do_not_depend_on_partitioning(daily, parts):
    shuffled = daily.repartition(parts, "daily_quantity")
    for build in (
        lambda d: features.feature_frame(features.calendar_grid(d, "2022-04-01", "2022-07-10")),
        lambda d: forecasting.croston(d, "2022-04-01", "2022-07-01"),
        lambda d: segments.product_stats(d, "2022-04-01", "2022-07-10", "daily_quantity"),
    ):
        a, b = rows(build(daily)), rows(build(shuffled))
        assert len(a) == len(b)
        for x, y in zip(a, b):
            for left, right in zip(x, y):
                assert left == (pytest.approx(right) if isinstance(right, float) else right)


def test_split_adds_up(tables):
    raw = tables.raw_sales
    checked = validation.validate_rows(raw, tables.products)
    good, bad = validation.split_valid(checked)
    refused = bad.agg(F.sum("copies")).first()[0]
    assert good.count() + refused == raw.count()
    totals = validation.counters(checked).first()
    assert totals["total_rows"] == raw.count() and totals["valid_rows"] == good.count()


def test_a_hot_group_of_copies_is_one_row_before_the_shuffle(spark, tables):
    columns = validation.SALES_COLUMNS
    row = ("2022-04-01", "Delhi", "o", "c", "k", "1", "2", "0", "1", "")
    raw = spark.createDataFrame([row], ", ".join(f"{c} string" for c in columns))
    many = raw.crossJoin(spark.range(50000)).drop("id")
    checked = validation.validate_rows(many, tables.products).collect()
    assert sorted(r["copies"] for r in checked) == [1, 49999]


def test_roll_forward_equals_the_recursion(spark):
    rng = np.random.default_rng(8)
    start = dt.date(2022, 4, 1)
    data = [
        (p, "Delhi", start + dt.timedelta(days=i), float(rng.integers(0, 30)) if i % 5 == 0 else 0.0, float(rng.integers(0, 12)))
        for p in (1, 2)
        for i in range(80)
    ]
    moves = spark.createDataFrame(
        data, "product_id long, city_name string, snapshot_date date, stock_received double, sales_quantity double"
    )
    opening = spark.createDataFrame([(1, "Delhi", 20.0)], "product_id long, city_name string, opening_stock double")
    got = {(r["product_id"], r["snapshot_date"]): r for r in inventory.roll_forward(moves, opening).collect()}
    for product, stock in ((1, 20.0), (2, 0.0)):
        for p, _, day, received, sold in data:
            if p == product:
                assert got[(p, day)]["opening_stock"] == stock
                stock = max(0.0, stock + received - sold)
                assert got[(p, day)]["closing_stock"] == stock


def test_daily_demand_reconciles(tables):
    sales, table = tables.sales, demand.daily_demand(tables.sales)
    assert table.agg(F.sum("daily_quantity")).first()[0] == sales.agg(F.sum("procured_quantity")).first()[0]


def test_null_keys_stay_groups(spark):
    df = spark.createDataFrame(
        [("2022-04-01", None, "Delhi", 1.0, 2.0, "o")], "date_ string, product_id long, city_name string, procured_quantity double, unit_selling_price double, order_id string"
    )
    assert demand.daily_demand(df).count() == 1


def test_product_statistics_equal_the_zero_filled_series(spark, daily):
    got = {r["product_id"]: r for r in segments.product_stats(daily, "2022-04-01", "2022-07-10", "daily_quantity").collect()}
    own = {r["product_id"]: r for r in segments.product_stats_own_span(daily, "daily_quantity").collect()}
    pdf = daily.toPandas()
    for product, part in pdf.groupby("product_id"):
        series = part.groupby("date_")["daily_quantity"].sum()
        days = [dt.date(2022, 4, 1) + dt.timedelta(days=i) for i in range(101)]
        full = np.array([series.get(d, 0.0) for d in days])
        assert got[product]["std_daily_demand"] == pytest.approx(full.std(ddof=1))
        assert got[product]["avg_daily_demand"] == pytest.approx(full.mean())
        assert got[product]["zero_days"] == (full == 0).sum()
        span = [d for d in days if series.index.min() <= d <= series.index.max()]
        short = np.array([series.get(d, 0.0) for d in span])
        assert own[product]["std_daily_demand"] == pytest.approx(short.std(ddof=1))
        assert own[product]["cv"] == pytest.approx(short.std(ddof=1) / short.mean())


def test_cost_recovery_fills_only_gaps(tables):
    sales = tables.sales
    lookup = cleaning.cost_recovery_lookup(sales)
    filled = cleaning.apply_cost_recovery(sales, lookup)
    assert filled.count() == sales.count()
    kept = filled.where("price_fill_method = 'original'").count()
    assert kept == sales.where("total_weighted_landing_price is not null").count()
    assert filled.where("price_fill_method like 'Tier%' and total_weighted_landing_price is null").count() == 0


def test_pareto_is_monotone_and_ends_at_one(tables):
    curve = demand.pareto(tables.sales).orderBy("product_rank").collect()
    shares = [r["cum_revenue_share"] for r in curve]
    assert shares == sorted(shares) and shares[-1] == pytest.approx(1.0)
    assert [r["product_rank"] for r in curve] == list(range(1, len(curve) + 1))


def test_panel_split_is_chronological(tables):
    frame = features.feature_frame(features.calendar_grid(tables.panel, tables.days.first, tables.days.last))
    train, later = features.split_by_date(frame, tables.days.cut)
    assert train.agg(F.max("date_")).first()[0] < later.agg(F.min("date_")).first()[0]
    assert train.count() + later.count() == frame.count()


def test_filters_and_columns_reach_the_scan(tables):
    q = tables.read("lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(F.sum("l_tax"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan
    assert "l_extendedprice" not in plan


def test_pareto_keeps_products_without_revenue(spark):
    df = spark.createDataFrame(
        [(1, 2.0, 5.0), (2, 3.0, None), (3, 1.0, 5.0), (4, 1.0, 5.0)], "product_id long, procured_quantity double, unit_selling_price double"
    )
    got = {r["product_id"]: r for r in demand.pareto(df).collect()}
    assert len(got) == 4 and got[2]["product_rank"] == 4 and got[2]["revenue"] is None
    # Equal revenues share the cumulative value.
    assert got[3]["cum_revenue_share"] == got[4]["cum_revenue_share"] == 1.0
