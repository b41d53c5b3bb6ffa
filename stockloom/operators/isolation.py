"""Isolation forest: small sampled trees, scored over all rows.

Each tree sees 256 rows, so the forest has a fixed size whatever the input:
rows are chosen by hash (repeatable under any partitioning), trees are built
by one task each, and the forest travels to the scoring tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.quantiles import quantile_values
from stockloom.session import materialize, ship_package

NODE_SCHEMA = "tree int, node int, feature int, cut double, low int, high int, size int"


def average_path(n):
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    depth = 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, depth, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Node tables of all trees; leaves have feature -1."""

    inputs: list[str]
    sample: int
    feature: list[np.ndarray]
    cut: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    size: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean depth / expected depth): near 1 is isolated, near 0 is usual."""
        depth = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, low, high, size in zip(self.feature, self.cut, self.low, self.high, self.size):
            node = np.zeros(len(x), dtype=np.int64)
            level = np.zeros(len(x))
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                at = node[inner]
                goes_low = x[rows[inner], feature[at]] < cut[at]
                node[inner] = np.where(goes_low, low[at], high[at])
                level[inner] += 1
            depth += level + average_path(size[node])
        return np.exp2(-depth / len(self.cut) / max(float(average_path(self.sample)), 1e-12))


def _grow(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """Random splits until points are alone or the depth limit is reached."""
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, None, None)]
    while todo:
        members, depth, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, len(members)])
        if parent is not None:
            nodes[parent][side] = me
        spread = x[members].max(axis=0) - x[members].min(axis=0) if len(members) else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(members) < 2 or not len(usable):
            continue
        f = int(rng.choice(usable))
        values = x[members, f]
        cut = float(rng.uniform(values.min(), values.max()))
        if cut <= values.min():
            cut = float(np.nextafter(values.min(), np.inf))
        nodes[me][2:4] = [f, cut]
        todo.append((members[values < cut], depth + 1, me, 4))
        todo.append((members[values >= cut], depth + 1, me, 5))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "low", "high", "size"])


def fit_forest(
    df: DataFrame,
    inputs: list[str],
    keys: list[str],
    trees: int = 100,
    sample: int = 256,
    seed: int = 42,
) -> Forest:
    """Grow the trees on hash-chosen samples of all rows.

    Every row has a hash place per tree; the places that count follow from the
    number of rows, so one pass hands a tree slightly more than its sample.
    """
    rows = df.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in inputs])
    share = min(1.0, (sample + 10 * math.sqrt(sample) + 50) / max(rows.count(), 1))

    def place(tree):
        return F.pmod(F.xxhash64(*keys, tree, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)

    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: place(tree) < share)
    order = Window.partitionBy("tree").orderBy(place(F.col("tree")), *keys)
    chosen = (
        rows.withColumn("tree", F.explode(drawn))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= sample)
        .select("tree", "_rank", *inputs)
    )

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("_rank")
        return _grow(int(ordered["tree"].iloc[0]), ordered[inputs].to_numpy(dtype=float), seed)

    # At most trees x (2 x sample - 1) nodes come back.
    nodes = chosen.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas().sort_values(["tree", "node"])
    if nodes.empty:
        raise ValueError("no rows to grow a forest on")
    parts = [g for _, g in nodes.groupby("tree")]
    columns = {c: [g[c].to_numpy() for g in parts] for c in ["feature", "cut", "low", "high", "size"]}
    used = int(max(g["size"].iloc[0] for g in parts))
    return Forest(list(inputs), used, **columns)


def score_rows(df: DataFrame, forest: Forest, name: str = "iso_score") -> DataFrame:
    """Attach the isolation score; works on Arrow batches of the input columns."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(values: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.score(values.to_numpy(dtype=float)))

    inputs = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in forest.inputs])
    return df.withColumn(name, score(inputs))


def isolation_forest(
    df: DataFrame, inputs: list[str], keys: list[str], contamination: float = 0.03, trees: int = 100, seed: int = 42
) -> DataFrame:
    """Flag the most isolated share of rows and scale their score to [0, 1].

    The input is written once and read for counting, growing and scoring; the
    scores are written once, so threshold and result come from the same values.
    """
    ship_package(df.sparkSession)
    rows = materialize(df)
    scored = materialize(score_rows(rows, fit_forest(rows, inputs, keys, trees=trees, seed=seed)))
    cut = quantile_values(scored, "iso_score", {"cut": 1 - contamination})["cut"]
    span = scored.agg(F.struct(F.min("iso_score").alias("lo"), F.max("iso_score").alias("hi")).alias("s")).scalar()
    width = F.when(span["hi"] > span["lo"], span["hi"] - span["lo"]).otherwise(1.0)
    return scored.withColumns(
        {
            "is_isolation_anomaly": F.col("iso_score") > cut,
            "anomaly_score": F.bround((F.col("iso_score") - span["lo"]) / width, 4),
        }
    )
