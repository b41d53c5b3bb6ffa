"""Boosted trees by histograms: splits, growth, stopping, search."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.catalog import load
from stockloom.operators import boosted
from stockloom.operators import linear_models as lm
from stockloom.operators.boosted import Fitting, Settings


def frame(spark, n=400, seed=1, columns=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(0, 20, (n, columns)), 0)
    y = np.round(3 * x[:, 0] + np.where(x[:, 1] > 8, 25, 0) + rng.normal(0, 2, n), 3)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)]
    names = [f"x{k}" for k in range(columns)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "daily_quantity"])), names, x, y


def plain_tree(x, g, settings):
    """Best-first growth with every split of every leaf tried on the raw values."""

    def best(rows):
        found = (0.0, None, None)
        for k in range(x.shape[1]):
            for value in np.unique(x[rows, k])[:-1]:
                left = rows[x[rows, k] <= value]
                right = rows[x[rows, k] > value]
                if min(len(left), len(right)) < settings.min_rows:
                    continue
                gain = g[left].sum() ** 2 / len(left) + g[right].sum() ** 2 / len(right) - g[rows].sum() ** 2 / len(rows)
                if gain > found[0] * (1 + 1e-9) + 1e-9:
                    found = (gain, k, value)
        return found

    leaves = [(np.arange(len(g)), 0)]
    while len(leaves) < settings.leaves:
        ranked = [(best(rows), i) for i, (rows, depth) in enumerate(leaves) if depth < settings.depth]
        ranked = [r for r in ranked if r[0][1] is not None]
        if not ranked:
            break
        (_, k, value), i = max(ranked, key=lambda r: r[0][0])
        rows, depth = leaves.pop(i)
        leaves += [(rows[x[rows, k] <= value], depth + 1), (rows[x[rows, k] > value], depth + 1)]
    out = np.empty(len(g))
    for rows, _ in leaves:
        out[rows] = settings.rate * g[rows].mean()
    return out


@pytest.mark.parametrize("settings", [Settings(4, 0.3, 6, 16, 10), Settings(3, 0.5, 31, 2, 20), Settings(5, 0.2, 12, 4, 5)], ids=str)
def test_trees_equal_a_search_over_all_splits(spark, settings):
    df, names, x, y = frame(spark)
    model = boosted.gbt(df, names, **settings.__dict__)
    pred = np.full(len(y), y.mean())
    for _ in range(settings.rounds):
        pred = pred + plain_tree(x, y - pred, settings)
    assert model.values(x) == pytest.approx(pred, abs=1e-6)
    assert max(len(t.column) // 2 + 1 for t in model.trees) <= settings.leaves


def test_models_do_not_depend_on_partitions(spark):
    df, names, x, _ = frame(spark, 700, seed=3)
    settings = {"rounds": 6, "min_rows": 5, "row_share": 0.7, "column_share": 0.7}
    one = boosted.gbt(df.coalesce(1), names, **settings).values(x)
    assert (one == boosted.gbt(df.repartition(7), names, **settings).values(x)).all()


def test_jobs_by_level_give_the_trees_of_one_task(spark):
    df, names, x, _ = frame(spark, 600, seed=4)
    train, later = df.where("x2 < 15"), df.where("x2 >= 15")
    found = []
    for local_rows in (0, 1 << 18):
        fitting = Fitting(train.repartition(3), names, "daily_quantity", later, local_rows=local_rows)
        ids = [fitting.add(s, patience=3) for s in (Settings(6, 0.3, 6, 16, 5), Settings(4, 0.5, 9, 3, 10, 0.8, 0.7))]
        fitting.run(2)
        fitting.run(9)
        found.append([(fitting.models[k].squared, fitting.models[k].absolute, fitting.model(k, 9).values(x).tolist()) for k in ids])
        fitting.close()
    assert found[0] == found[1]


def test_missing_values_and_unseen_ones(spark):
    rows = [(None, 1.0)] * 40 + [(1.0, 5.0)] * 40 + [(2.0, 9.0)] * 40 + [(3.0, None)] * 5
    df = spark.createDataFrame(rows, "x double, daily_quantity double")
    model = boosted.gbt(df, ["x"], rounds=80, rate=0.3, min_rows=5)
    got = {r["x"]: r["p"] for r in model.predict(spark.createDataFrame([(None,), (1.0,), (2.0,), (99.0,), (-5.0,)], "x double"), "p").collect()}
    assert got[None] == pytest.approx(1, abs=0.01) and got[1.0] == pytest.approx(5, abs=0.01) == pytest.approx(got[-5.0], abs=0.02)
    assert got[2.0] == pytest.approx(9, abs=0.01) == pytest.approx(got[99.0], abs=0.02)
    with pytest.raises(ValueError):
        boosted.gbt(df.limit(0), ["x"])


def test_constant_target_gives_one_leaf(spark):
    df = spark.range(50).selectExpr("cast(id as double) as x", "0.1D as daily_quantity")
    model = boosted.gbt(df, ["x"], rounds=2, min_rows=1)
    assert all(len(t.column) == 1 for t in model.trees)
    assert model.values(np.array([[3.0]])) == pytest.approx([0.1])


def test_bins_are_many_values_in_few():
    x = np.random.default_rng(0).normal(size=(10_000, 1))
    edges = boosted.bin_edges(x)
    counts = np.bincount(boosted.to_bins(x, edges)[0], minlength=256)
    assert len(edges[0]) <= 254 and counts[0] == 0 and counts.max() < 120


def test_search_covers_six_parameters_in_twenty_trials():
    settings = boosted.search_settings()
    assert len(settings) == 20 and settings == boosted.search_settings()
    for name in ("rate", "depth", "leaves", "row_share", "column_share", "rounds"):
        assert len({getattr(s, name) for s in settings}) > 4, name
    assert all(80 <= s.rounds <= 300 and 3 <= s.depth <= 10 and 0.01 <= s.rate <= 0.2 and 15 <= s.leaves <= 127 for s in settings)


def test_stopping_inside_the_loop_keeps_the_round_of_the_full_run(spark):
    df, names, x, y = frame(spark, 900, seed=5)
    noisy = df.withColumn("daily_quantity", F.col("daily_quantity") + F.rand(7) * 40)
    train, later = noisy.where("x2 < 14").cache(), noisy.where("x2 >= 14").cache()
    params = {"rounds": 60, "rate": 0.3, "min_rows": 3, "row_share": 0.8, "column_share": 0.8}
    full = Fitting(train, names, "daily_quantity", later)
    k = full.add(Settings(**params))
    full.run(60)
    errors = full.models[k].squared
    full.close()
    assert len(errors) == 60
    best = next(i for i, e in enumerate(errors) if e == min(errors[: i + 1]) and min(errors[i + 1 : i + 6], default=np.inf) >= e) + 1
    short = Fitting(train, names, "daily_quantity", later)
    j = short.add(Settings(**params), patience=5)
    short.run(60)
    assert short.models[j].squared == errors[: best + 5] and short.models[j].best_round == best < 55
    kept = short.model(j)
    short.close()
    assert len(kept.trees) == best
    rows = np.array([[r[c] for c in [*names, "daily_quantity"]] for r in later.collect()])
    gap = rows[:, -1] - np.maximum(kept.values(rows[:, :-1]), 0)
    assert (gap**2).sum() == pytest.approx(errors[best - 1], rel=1e-9)


def test_trials_side_by_side_equal_trials_alone(spark):
    df, names, x, _ = frame(spark, 500, seed=8)
    many = [Settings(5, 0.1 * (k + 1), 4 + 3 * k, 3 + k, 10, 1.0 - 0.1 * k) for k in range(3)]
    together = Fitting(df, names, "daily_quantity")
    ids = [together.add(s) for s in many]
    together.run(5)
    for k, s in zip(ids, many):
        assert (together.model(k).values(x) == boosted.gbt(df, names, **s.__dict__).values(x)).all()
    together.close()


def test_halving_keeps_the_better_trials(spark):
    df, names, _, _ = frame(spark, 900, seed=11)
    train, tune = df.where("x2 < 12"), df.where("x2 >= 12")
    grid = [Settings(12, rate, 8, 4, 5) for rate in (0.001, 0.3, 0.002, 0.2, 0.01)]
    model, best, scores = boosted.tune_gbt(train, tune, names, grid, first=3)
    assert best.rate in (0.2, 0.3) and len(scores) == 5 and 1 <= len(model.trees) <= 12
    assert dict((s.rate, e) for s, e in scores)[best.rate] == min(e for _, e in scores)


def test_sixty_rounds_on_a_stored_frame(spark, tmp_path):
    rows = spark.range(200_000).select(*[F.round(F.rand(k) * 100, 2).alias(f"x{k}") for k in range(10)])
    rows = rows.withColumn("daily_quantity", F.col("x0") * 2 + F.sqrt("x1") * 9 + F.rand(99) * 10)
    rows.write.parquet(str(tmp_path / "frame"))
    stored = spark.read.parquet(str(tmp_path / "frame"))
    began = time.perf_counter()
    model = boosted.gbt(stored, [f"x{k}" for k in range(10)])
    seconds = time.perf_counter() - began
    print(f"60 rounds on 200,000 rows: {seconds:.1f} s")
    scored = model.predict(stored, "p").selectExpr("sqrt(avg(pow(daily_quantity - p, 2)))", "stddev(daily_quantity)").first()
    assert scored[0] < 0.1 * scored[1]
    assert seconds < 60  # a slow machine; the bench has the figure


def test_stacking_weighs_both_boosted_models(spark, small, monkeypatch):
    stack, stop, seen = lm.stack, boosted.gbt_early_stop, []
    monkeypatch.setattr(boosted, "search_settings", lambda: [Settings(rounds=2, depth=2)])
    monkeypatch.setattr(boosted, "gbt_early_stop", lambda *a: stop(*a, rounds=2))
    monkeypatch.setattr(lm, "stack", lambda df, preds: seen.extend(preds) or stack(df, preds))
    rows = load()["fct15_stacking"](spark, small)
    assert rows.where("pred_ensemble is null").count() == 0
    assert {"pred_lgb", "pred_xgb", "pred_prophet", "pred_ridge"} <= set(seen)


def test_frequent_demand_takes_a_fitted_forecast(spark, small, tables):
    from stockloom.catalog.forecasts import fixed_results

    fixed, fitted = load()["fct16_hybrid_route"](spark, small), load()["fct16_fitted_route"](spark, small)
    frequent = F.col("demand_category").isin("Smooth", "Erratic")
    keys = ["date_", "product_id", "city_name", "demand_category"]
    both = fixed.join(fitted.withColumnRenamed("pred_hybrid", "fitted"), keys)
    assert both.count() == fixed.count() == fitted.count()
    assert both.where(F.col("fitted") != F.col("pred_hybrid")).count() == 0
    rows = fixed_results(tables)
    assert rows.where(frequent & (F.col("pred_hybrid") != F.col("pred_mean"))).count() > 0
    assert rows.where(~frequent & (F.col("pred_hybrid") != F.col("pred_sba"))).count() == 0


def test_a_model_task_has_one_python_process(spark, monkeypatch):
    df, names, _, _ = frame(spark)
    fitting = Fitting(df.repartition(3), names, "daily_quantity")
    for rate in (0.1, 0.3):
        fitting.add(Settings(rounds=2, rate=rate))
    union, steps = type(spark.sparkContext).union, []

    def seen(context, parts):
        steps.extend(part.toDebugString().decode().count("PythonRDD[") for part in parts)
        return union(context, parts)

    monkeypatch.setattr(type(spark.sparkContext), "union", seen)
    fitting.run(2)
    assert steps == [1, 1] and [len(m.trees) for m in fitting.models.values()] == [2, 2]
