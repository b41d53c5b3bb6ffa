"""Linear forecasters fitted from co-moment sums.

One distributed aggregation yields means and co-moments of the k inputs; the
k x k system is solved on the driver, and scoring is a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.scalars import clip0
from stockloom.schemas import SERIES_KEY


@dataclass(frozen=True)
class Moments:
    """Row count, means and centred co-moment matrix of some columns."""

    n: int
    names: list[str]
    means: np.ndarray
    comoments: np.ndarray


def moments(df: DataFrame, names: list[str]) -> Moments:
    """Exact moments in one pass over Arrow batches.

    A task returns one row, its count, means and centred products; the driver
    combines these k x k tables pairwise, which loses no digits to large means.
    """
    k = len(names)

    def sums(batches):
        n, means, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if len(x):
                centre = x.mean(axis=0)
                n, means, products = combine((n, means, products), (len(x), centre, (x - centre).T @ (x - centre)))
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "values": [[*means.tolist(), *products.ravel().tolist()]]})

    def combine(one, two):
        n, gap = one[0] + two[0], two[1] - one[1]
        return n, one[1] + gap * (two[0] / n), one[2] + two[2] + np.outer(gap, gap) * (one[0] * two[0] / n)

    rows = df.dropna(subset=names).select(*[F.col(c).cast("double") for c in names])
    whole = (0, np.zeros(k), np.zeros((k, k)))
    for row in rows.mapInArrow(sums, "n long, values array<double>").toLocalIterator():
        part = np.array(row["values"])
        whole = combine(whole, (row["n"], part[:k], part[k:].reshape(k, k)))
    if not whole[0]:
        raise ValueError("no complete rows to fit on")
    return Moments(whole[0], list(names), whole[1], whole[2])


@dataclass(frozen=True)
class LinearModel:
    intercept: float
    weights: dict[str, float]

    def expression(self) -> Column:
        terms = F.lit(float(self.intercept))
        for name, weight in self.weights.items():
            terms = terms + F.col(name) * F.lit(float(weight))
        return terms


def ridge(train: DataFrame, inputs: list[str], target: str = "daily_quantity", alpha: float = 1.0) -> LinearModel:
    """Ridge regression with a free intercept on all training rows."""
    m = moments(train, [*inputs, target])
    k = len(inputs)
    weights = np.linalg.solve(m.comoments[:k, :k] + alpha * np.eye(k), m.comoments[:k, k])
    intercept = m.means[k] - weights @ m.means[:k]
    return LinearModel(float(intercept), dict(zip(inputs, weights.tolist())))


def predict_ridge(df: DataFrame, model: LinearModel, name: str = "pred_ridge") -> DataFrame:
    return df.withColumn(name, clip0(model.expression()))


def _season_inputs(origin: str) -> dict[str, Column]:
    """Linear trend and six weekday indicators (Monday is the base)."""
    inputs = {"_t": F.datediff("date_", F.lit(origin).cast("date")).cast("double")}
    for d in range(1, 7):
        inputs[f"_dow{d}"] = (F.weekday("date_") == d).cast("double")
    return inputs


def additive_seasonal(
    train: DataFrame, future: DataFrame, origin: str, name: str = "pred_prophet", keys: list[str] = SERIES_KEY
) -> DataFrame:
    """Overall trend plus weekday pattern, scaled to the mean of each series.

    Fitted by least squares on the daily totals; a series without training
    rows gets the overall row mean.
    """
    daily = train.groupBy("date_").agg(F.sum("daily_quantity").alias("_y"))
    inputs = _season_inputs(origin)
    m = moments(daily.withColumns(inputs), [*inputs, "_y"])
    k = len(inputs)
    # Minimum-norm solution: a weekday may be absent from a short training period.
    weights = np.linalg.lstsq(m.comoments[:k, :k], m.comoments[:k, k], rcond=None)[0]
    model = LinearModel(float(m.means[k] - weights @ m.means[:k]), dict(zip(inputs, weights.tolist())))
    day_mean = float(m.means[k])
    level = train.groupBy(*keys).agg(F.avg("daily_quantity").alias("_level"))
    overall = train.agg(F.avg("daily_quantity")).first()[0]
    scale = model.expression() / F.lit(max(1.0, day_mean))
    return (
        future.join(level, keys, "left")
        .withColumns(inputs)
        .withColumn(name, clip0(F.coalesce("_level", F.lit(overall)) * scale))
        .drop("_level", *inputs)
    )


def _basis(first: str, knots: list[int], harmonics: int) -> dict[str, Column]:
    """Day number, slope changes after each knot, and harmonics of the week."""
    t = F.datediff("date_", F.lit(first).cast("date")).cast("double")
    out = {"_t": t}
    out |= {f"_change{k}": F.greatest(t - F.lit(float(k)), F.lit(0.0)) for k in knots}
    for k in range(1, harmonics + 1):
        angle = t * F.lit(2 * np.pi * k / 7)
        out |= {f"_sin{k}": F.sin(angle), f"_cos{k}": F.cos(angle)}
    return out


def _soft_path(a: np.ndarray, b: np.ndarray, penalised: np.ndarray, penalty: float, sweeps: int = 400) -> np.ndarray:
    """Coordinate descent for w'aw/2 - w'b + penalty * sum of the penalised |w|."""
    w, slope = np.zeros(len(b)), b.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(np.diag(a) > 0):
            pull = slope[j] + a[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - (penalty if penalised[j] else 0.0), 0.0) / a[j, j]
            if new != w[j]:
                slope -= a[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]) * np.sqrt(a[j, j]))
                w[j] = new
        if moved < 1e-9 * np.sqrt(max(float(b @ w), 1e-300)):
            break
    return w


def _changes(m: Moments, inputs: list[str], spacing: float) -> list[str]:
    """The slope changes whose least-squares fit has the lowest Bayesian information criterion.

    Candidates come along the path of an absolute penalty on the changes: it keeps
    few of them, and neighbours closer than ``spacing`` days that describe one bend
    are tried as their largest member alone.
    """
    k = len(inputs)
    scale = np.sqrt(np.maximum(np.diag(m.comoments)[:k], 1e-300))
    a, b = m.comoments[:k, :k] / np.outer(scale, scale), m.comoments[:k, k] / scale
    total = float(m.comoments[k, k])
    change = np.array([name.startswith("_change") for name in inputs])
    place = {j: float(inputs[j].removeprefix("_change")) for j in np.flatnonzero(change)}

    def criterion(active: np.ndarray) -> float:
        w = np.linalg.lstsq(a[np.ix_(active, active)], b[active], rcond=None)[0]
        left = max(total - float(w @ b[active]), 1e-12 * max(total, 1e-300))
        # A change costs its place as well as its size.
        return m.n * np.log(left / m.n) + np.log(max(m.n, 2)) * (len(active) + int(change[active].sum()))

    base = np.flatnonzero(~change)
    best, best_value = base, criterion(base)
    residual = b - a[:, base] @ np.linalg.lstsq(a[np.ix_(base, base)], b[base], rcond=None)[0]
    top = float(np.abs(residual[change]).max(initial=0.0))
    for share in np.geomspace(0.9, 1e-3, 30):
        w = _soft_path(a, b, change, share * top)
        chosen: list[int] = []
        for j in sorted((j for j in place if w[j] != 0), key=lambda j: -abs(w[j])):
            if all(abs(place[j] - place[i]) > spacing for i in chosen):
                chosen.append(j)
        for active in (np.sort([*base, *chosen]), np.sort([*base, *(j for j in place if w[j] != 0)])):
            value = criterion(active.astype(int))
            if value < best_value - 1e-9:
                best, best_value = active.astype(int), value
    return [inputs[j] for j in best]


def trend_model(
    daily: DataFrame, first: str, days: int, value: str = "_y", knots: int = 25, harmonics: int = 3
) -> tuple[LinearModel, dict[str, Column], list[int], float]:
    """Piecewise-linear trend with weekly harmonics for a table of (date_, value).

    ``knots`` places for slope changes lie evenly in the first nine tenths of the
    ``days`` from ``first`` on.  Everything is chosen from one pass of moments.
    Returns the model, its input columns, the days at which the slope changes, and
    the mean of the values.
    """
    step = max(1.0, 0.9 * days / (knots + 1))
    places = sorted({int(round(step * (k + 1))) for k in range(knots)} - {0})
    inputs = _basis(first, [p for p in places if p < days], harmonics)
    names = list(inputs)
    m = moments(daily.withColumns(inputs), [*names, value])
    kept = _changes(m, names, 1.5 * step)
    at = [names.index(name) for name in kept]
    # Minimum-norm solution: harmonics may coincide in a very short period.
    w = np.linalg.lstsq(m.comoments[np.ix_(at, at)], m.comoments[at, len(names)], rcond=None)[0]
    model = LinearModel(float(m.means[-1] - w @ m.means[at]), dict(zip(kept, w.tolist())))
    changes = [int(name.removeprefix("_change")) for name in kept if name.startswith("_change")]
    return model, {name: inputs[name] for name in kept}, changes, float(m.means[-1])


def trend_with_changes(
    train: DataFrame,
    future: DataFrame,
    first: str,
    days: int,
    name: str = "pred_trend",
    keys: list[str] = SERIES_KEY,
    knots: int = 25,
    harmonics: int = 3,
) -> DataFrame:
    """Trend with slope changes and weekly harmonics, scaled to the mean of each series.

    The shape is fitted on the daily totals of ``train``, which covers ``days`` days
    from ``first`` on; a series without training rows gets the overall row mean.
    """
    daily = train.groupBy("date_").agg(F.sum("daily_quantity").alias("_y"))
    model, inputs, _, day_mean = trend_model(daily, first, days, knots=knots, harmonics=harmonics)
    level = train.groupBy(*keys).agg(F.avg("daily_quantity").alias("_level"))
    overall = train.agg(F.avg("daily_quantity")).first()[0]
    shape = model.expression() / F.lit(max(1.0, day_mean))
    return (
        future.join(level, keys, "left")
        .withColumns(inputs)
        .withColumn(name, clip0(F.coalesce("_level", F.lit(overall)) * shape))
        .drop("_level", *inputs)
    )


def non_negative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 with the lowest x'ax - 2x'b, by Lawson and Hanson's active sets.

    ``a`` is symmetric and positive semidefinite.  At the result the slope b - ax is
    zero where x > 0 and not above zero elsewhere, up to rounding.
    """
    x, free = np.zeros(len(b)), np.zeros(len(b), dtype=bool)
    tolerance = 1e-10 * max(float(np.abs(b).max(initial=0.0)), 1e-300)
    for _ in range(3 * len(b) + 10):
        slope = b - a @ x
        if free.all() or (slope[~free] <= tolerance).all():
            break
        free[np.flatnonzero(~free)[slope[~free].argmax()]] = True
        while True:
            inside = np.flatnonzero(free)
            solved = np.linalg.lstsq(a[np.ix_(inside, inside)], b[inside], rcond=None)[0]
            if (solved > 0).all():
                break
            # Go towards the solution up to the first border, and stay there.
            down = inside[solved <= 0]
            share = (x[down] / (x[down] - solved[solved <= 0])).min()
            x[inside] += share * (solved - x[inside])
            free[inside[x[inside] <= 1e-14 * max(x.max(), 1e-300)]] = False
            x[~free] = 0.0
        x[:] = 0.0
        x[inside] = solved
    return x


def stack(df: DataFrame, preds: list[str], target: str = "daily_quantity", alpha: float = 0.5) -> tuple[LinearModel, dict[str, float]]:
    """Non-negative ridge over any number of base predictions, without intercept.

    Returns the model and its normalised weights.
    """
    m = moments(df, [*preds, target])
    k = len(preds)
    gram = m.comoments + m.n * np.outer(m.means, m.means)
    best = non_negative(gram[:k, :k] + alpha * np.eye(k), gram[:k, k])
    total = best.sum()
    weights = dict(zip(preds, best.tolist()))
    shares = {p: (w / total if total > 0 else 0.0) for p, w in weights.items()}
    return LinearModel(0.0, weights), shares


def predict_stack(df: DataFrame, model: LinearModel, name: str = "pred_ensemble") -> DataFrame:
    return df.withColumn(name, clip0(model.expression()))
