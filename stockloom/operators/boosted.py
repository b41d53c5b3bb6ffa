"""Gradient-boosted regression trees on binned columns, fitted by distributed sums.

Inputs are cut once into at most 255 bins.  A block of rows holds the bins, the
target and the current prediction of every model that is being fitted.  One Spark
job sums gradients and row counts per (model, leaf, column, bin) over all blocks;
the driver sees only these sums, picks splits, and takes the histogram of the
larger child as parent less sibling.  Leaves are opened best gain first, and one
job looks at the children of every leaf that may still be opened, so a tree costs
about one job per level.  Many models share the jobs, which is how a search runs
its trials at the same time.

A level costs a Spark job, which a small frame does not repay: up to ``LOCAL_ROWS``
rows every model is fitted in a task of its own over the same blocks.

Gradients are rounded to a power of two that makes every sum exact, and row samples
come from a hash of the row, so a model does not depend on how rows are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.functions.sampling import hash_sample
from stockloom.functions.scalars import clip0
from stockloom.session import enable_checkpoints, materialize, ship_package

BINS = 255
BIN_SAMPLE = 200_000
BLOCK_ROWS = 1 << 16
CHECKPOINT_EVERY = 25
# A frame of at most so many rows is read by one task per model; a larger one is summed
# over all tasks for every level of a tree.  Both give the same trees.
LOCAL_ROWS = 1 << 18
# Sums of more tasks than this are first added up on the executors.
DIRECT_TASKS = 64


@dataclass(frozen=True)
class Settings:
    """How one model is fitted."""

    rounds: int = 60
    rate: float = 0.1
    leaves: int = 31
    depth: int = 16
    min_rows: int = 50
    row_share: float = 1.0
    column_share: float = 1.0
    seed: int = 42


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays; ``column`` is -1 in a leaf.  A row goes left up to bin ``cut``.

    Bin 0 holds missing values, which therefore go left of every cut.
    """

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """Leaf number of every row; ``bins`` has one row per column."""
        node = np.zeros(bins.shape[1], dtype=np.int32)
        moving = np.arange(bins.shape[1]) if self.column[0] >= 0 else np.zeros(0, dtype=np.int64)
        while len(moving):
            at = node[moving]
            goes_left = bins[self.column[at], moving] <= self.cut[at]
            node[moving] = np.where(goes_left, self.left[at], self.right[at])
            moving = moving[self.column[node[moving]] >= 0]
        return node


def bin_edges(sample: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges per column: values halfway between neighbours, at most ``bins`` - 1 of them."""
    out = []
    for values in sample.T:
        found = np.unique(values[~np.isnan(values)])
        if len(found) > bins:
            ordered = np.sort(values[~np.isnan(values)])
            found = np.unique(ordered[np.linspace(0, len(ordered) - 1, bins).astype(np.int64)])
        out.append((found[:-1] + found[1:]) / 2)
    return out


def to_bins(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers, one row per column: 0 for missing values, else 1 and up."""
    out = np.empty((len(edges), len(values)), dtype=np.uint8)
    for k, edge in enumerate(edges):
        column = values[:, k]
        out[k] = np.where(np.isnan(column), 0, np.searchsorted(edge, column, side="left") + 1)
    return out


@dataclass
class Block:
    """Rows of one block; ``pred`` has one array per model that is being fitted."""

    bins: np.ndarray
    target: np.ndarray
    key: np.ndarray
    held_out: np.ndarray
    pred: dict[int, np.ndarray] = field(default_factory=dict)


def _in_sample(key: np.ndarray, share: float, seed: int) -> np.ndarray:
    if share >= 1:
        return np.ones(len(key), dtype=bool)
    x = (key ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.float64) < share * (1 << 32)


@dataclass(frozen=True)
class _Wanted:
    """Histograms that one model needs: of ``nodes`` of ``tree``, over a sample of the rows."""

    tree: Tree
    nodes: tuple[int, ...]
    row_share: float
    seed: int


def _histograms(block: Block, model: int, wanted: _Wanted, unit: float) -> np.ndarray:
    """Sums of gradient and rows: (node, column, bin, 2)."""
    gradient = np.rint((block.target - block.pred[model]) / unit) * unit
    use = _in_sample(block.key, wanted.row_share, wanted.seed) & ~block.held_out
    slot_of = np.full(len(wanted.tree.column), -1, dtype=np.int64)
    slot_of[list(wanted.nodes)] = np.arange(len(wanted.nodes))
    slot = slot_of[wanted.tree.leaf_of(block.bins)]
    rows = np.flatnonzero(use & (slot >= 0))
    base, weights = slot[rows] << 8, gradient[rows]
    out = np.empty((len(wanted.nodes), len(block.bins), 256, 2))
    for k, column in enumerate(block.bins):
        at = base + column[rows]
        out[:, k, :, 0] = np.bincount(at, weights, len(wanted.nodes) << 8).reshape(-1, 256)
        out[:, k, :, 1] = np.bincount(at, minlength=len(wanted.nodes) << 8).reshape(-1, 256)
    return out


def _moved(block: Block, trees: dict[int, Tree]) -> Block:
    """The block with one more tree in the predictions of these models."""
    return replace(block, pred={k: block.pred[k] + tree.value[tree.leaf_of(block.bins)] for k, tree in trees.items()})


def _errors(block: Block, model: int, unit: float, square: float) -> np.ndarray:
    """Held-out sums of squared and absolute errors, rounded so that they add up exactly."""
    gap = (block.target - np.maximum(block.pred[model], 0.0))[block.held_out]
    return np.array([np.rint(gap**2 / square).sum() * square, np.rint(np.abs(gap) / unit).sum() * unit])


def best_split(histogram: np.ndarray, columns: np.ndarray, min_rows: int) -> tuple[float, int, int]:
    """(gain, column, cut) of the split that lowers the squared error most.

    Ties go to the first column and the lowest cut; without an allowed split the
    gain is 0.
    """
    left = np.cumsum(histogram[columns], axis=1)
    total = left[:, -1:, :]
    right = total - left
    least = max(min_rows, 1)
    allowed = (left[..., 1] >= least) & (right[..., 1] >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = left[..., 0] ** 2 / left[..., 1] + right[..., 0] ** 2 / right[..., 1]
        together = total[..., 0] ** 2 / total[..., 1]
    # What rounding leaves is no gain.
    gain = np.where(allowed & (apart - together > 1e-12 * apart), apart - together, 0.0)
    column, cut = divmod(int(gain.argmax()), gain.shape[1])
    found = float(gain[column, cut])
    return (found, int(columns[column]), cut) if found > 0 else (0.0, -1, 0)


class _Leaf:
    def __init__(self, histogram: np.ndarray, depth: int, columns: np.ndarray, settings: Settings):
        self.histogram, self.depth = histogram, depth
        total = histogram[0].sum(axis=0)
        self.value = settings.rate * total[0] / total[1] if total[1] else 0.0
        may_split = depth < settings.depth and total[1] >= 2 * settings.min_rows
        self.gain, self.column, self.cut = best_split(histogram, columns, settings.min_rows) if may_split else (0.0, -1, 0)
        self.children: tuple[_Leaf, _Leaf] | None = None


class _Growing:
    """The tree of one round while its leaves are being opened."""

    def __init__(self, settings: Settings, columns: int, round_number: int):
        self.settings, self.seed = settings, settings.seed * 1_000_003 + round_number
        count = max(1, math.ceil(settings.column_share * columns))
        self.columns = np.sort(np.random.default_rng(self.seed).permutation(columns)[:count])
        self.column = [-1]
        self.cut, self.left, self.right = [0], [0], [0]
        self.leaves: dict[int, _Leaf] = {}
        self.asked: list[int] = []

    def tree(self, extra: list[int] = ()) -> Tree:
        """The tree so far; the leaves in ``extra`` are split as they would be."""
        column, cut, left, right = list(self.column), list(self.cut), list(self.left), list(self.right)
        for node in extra:
            leaf = self.leaves[node]
            column[node], cut[node] = leaf.column, leaf.cut
            left[node], right[node] = len(column), len(column) + 1
            for nodes, none in ((column, -1), (cut, 0), (left, 0), (right, 0)):
                nodes += [none, none]
        value = np.zeros(len(column))
        for node, leaf in self.leaves.items():
            value[node] = leaf.value
        return Tree(np.array(column, np.int32), np.array(cut, np.uint8), np.array(left, np.int32), np.array(right, np.int32), value)

    def wanted(self) -> _Wanted | None:
        """What must be summed before the next leaf can be opened; None when the tree is done."""
        if not self.leaves:
            return _Wanted(self.tree(), (0,), self.settings.row_share, self.seed)
        while len(self.leaves) < self.settings.leaves:
            ranked = sorted((n for n, leaf in self.leaves.items() if leaf.gain > 0), key=lambda n: (-self.leaves[n].gain, n))
            if not ranked:
                return None
            first = self.leaves[ranked[0]]
            if first.children is None:
                open_now = self.settings.leaves - len(self.leaves)
                self.asked = [n for n in ranked[:open_now] if self.leaves[n].children is None]
                tree = self.tree(self.asked)
                return _Wanted(tree, tuple(self._smaller(tree, n) for n in self.asked), self.settings.row_share, self.seed)
            self._open(ranked[0], first)
        return None

    def _smaller(self, tree: Tree, node: int) -> int:
        leaf = self.leaves[node]
        rows = leaf.histogram[leaf.column, :, 1]
        low = rows[: leaf.cut + 1].sum()
        return int(tree.left[node] if 2 * low <= rows.sum() else tree.right[node])

    def receive(self, sums: np.ndarray) -> None:
        if not self.leaves:
            self.leaves[0] = _Leaf(sums[0], 0, self.columns, self.settings)
            return
        tree = self.tree(self.asked)
        for node, small in zip(self.asked, sums):
            leaf = self.leaves[node]
            parts = [_Leaf(h, leaf.depth + 1, self.columns, self.settings) for h in (small, leaf.histogram - small)]
            leaf.children = (parts[0], parts[1]) if self._smaller(tree, node) == tree.left[node] else (parts[1], parts[0])

    def _open(self, node: int, leaf: _Leaf) -> None:
        del self.leaves[node]
        self.column[node], self.cut[node] = leaf.column, leaf.cut
        self.left[node], self.right[node] = len(self.column), len(self.column) + 1
        for child in leaf.children:
            self.leaves[len(self.column)] = child
            for nodes, none in ((self.column, -1), (self.cut, 0), (self.left, 0), (self.right, 0)):
                nodes.append(none)


@dataclass
class _Model:
    settings: Settings
    trees: list[Tree] = field(default_factory=list)
    squared: list[float] = field(default_factory=list)  # held-out errors after each round
    absolute: list[float] = field(default_factory=list)
    patience: int | None = None
    done: bool = False

    @property
    def best_round(self) -> int:
        """Rounds up to the lowest held-out error, all of them without held-out rows."""
        return int(np.argmin(self.squared)) + 1 if self.squared else len(self.trees)

    def grown(self, tree: Tree, errors: np.ndarray | None) -> None:
        """A round more: its tree and, with held-out rows, the errors it leaves."""
        self.trees.append(tree)
        if errors is not None:
            self.squared.append(float(errors[0]))
            self.absolute.append(float(errors[1]))
        self.judge()

    def judge(self) -> None:
        stale = self.patience is not None and self.squared and len(self.squared) - self.best_round >= self.patience
        self.done = self.done or bool(stale) or len(self.trees) >= self.settings.rounds


class Fitting:
    """Models that are fitted side by side on one binned frame."""

    def __init__(
        self,
        train: DataFrame,
        inputs: list[str],
        target: str,
        held_out: DataFrame | None = None,
        bins: int = BINS,
        bin_sample: int = BIN_SAMPLE,
        local_rows: int = LOCAL_ROWS,
    ):
        self.spark, self.inputs = train.sparkSession, list(inputs)
        enable_checkpoints(self.spark)
        ship_package(self.spark)
        wanted = [*[F.col(c).cast("double").alias(c) for c in inputs], F.col(target).cast("double").alias("_target")]
        rows = train.select(*wanted, F.lit(False).alias("_held"))
        if held_out is not None:
            rows = rows.unionByName(held_out.select(*wanted, F.lit(True).alias("_held")))
        rows = materialize(rows.where(F.col("_target").isNotNull()))
        self._look(rows, bin_sample)
        self.edges = bin_edges(self._sample(rows, bin_sample), bins)
        self.packed = self._pack(rows)
        self.local = self.rows + self.held <= local_rows
        self.models: dict[int, _Model] = {}
        self.state: RDD | None = None
        self.previous: RDD | None = None
        self.updates = 0

    def _look(self, rows: DataFrame, bin_sample: int) -> None:
        fit = ~F.col("_held")
        known = rows.agg(
            F.count_if(fit).alias("n"),
            F.count_if(~fit).alias("held"),
            F.avg(F.when(fit, F.col("_target"))).alias("mean"),
            F.max(F.abs("_target")).alias("top"),
        ).first()
        if not known["n"]:
            raise ValueError("no rows to fit on")
        self.rows, self.held = known["n"], known["held"]
        # Sums of up to n gradients of this size are whole multiples of the unit below 2^53.
        self.top = max(float(known["top"]), 1e-300)
        self.unit = 2.0 ** (math.ceil(math.log2(4 * self.top * max(self.rows + self.held, 2))) - 52)
        self.start = float(np.rint(known["mean"] / self.unit) * self.unit)

    def _sample(self, rows: DataFrame, bin_sample: int) -> np.ndarray:
        chosen = hash_sample(rows.where(~F.col("_held")).select(*self.inputs), bin_sample, self.inputs, rows=self.rows)
        return np.stack([c.to_numpy() for c in chosen.toArrow().columns], axis=1).astype(float)

    def _pack(self, rows: DataFrame) -> DataFrame:
        edges, k = self.edges, len(self.inputs)
        schema = T.StructType([T.StructField(n, T.BinaryType()) for n in ("bins", "target", "key", "held")])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0

            def one():
                joined = [np.concatenate(x, axis=-1) for x in zip(*held)]
                return pa.RecordBatch.from_pydict({name: [x.tobytes()] for name, x in zip(schema.names, joined)})

            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                values = np.stack([c.astype(float) for c in columns[:k]], axis=1)
                held.append((to_bins(values, edges), columns[k], columns[k + 2].view(np.uint64), columns[k + 1].astype(bool)))
                n += batch.num_rows
                if n >= BLOCK_ROWS:
                    yield one()
                    held, n = [], 0
            if held:
                yield one()

        keyed = rows.withColumn("_key", F.xxhash64(*self.inputs, "_target"))
        return materialize(keyed.mapInArrow(pack, schema))

    def _blocks(self, packed: DataFrame) -> RDD:
        """The blocks, read in the same Python process as what is mapped over them."""
        k = len(self.inputs)

        def unpack(row) -> Block:
            target = np.frombuffer(row["target"])
            return Block(
                np.frombuffer(row["bins"], dtype=np.uint8).reshape(k, len(target)),
                target,
                np.frombuffer(row["key"], dtype=np.uint64),
                np.frombuffer(row["held"], dtype=bool),
            )

        return packed.rdd.map(unpack)

    def add(self, settings: Settings, patience: int | None = None) -> int:
        """A further model; all are added before the first round."""
        self.models[len(self.models)] = _Model(settings, patience=patience)
        return len(self.models) - 1

    def drop(self, models: list[int]) -> None:
        """Do not go on with these models; what they have stays."""
        for k in models:
            self.models[k].done = True

    def _begin(self) -> None:
        start, names = self.start, list(self.models)

        def first(block: Block) -> Block:
            return replace(block, pred={k: np.full(len(block.target), start) for k in names})

        self.state = self._blocks(self.packed).map(first).persist(StorageLevel.MEMORY_AND_DISK)

    def run(self, rounds: int) -> None:
        """Up to ``rounds`` more rounds of every model that is not done."""
        if self.local:
            self._run_local(rounds)
            return
        if self.state is None:
            self._begin()
        for _ in range(rounds):
            active = [k for k, m in self.models.items() if not m.done]
            if not active:
                return
            growing = {k: _Growing(self.models[k].settings, len(self.inputs), len(self.models[k].trees)) for k in active}
            while wanted := {k: w for k, g in growing.items() if (w := g.wanted()) is not None}:
                for k, sums in self._sum(wanted).items():
                    growing[k].receive(sums)
            self._apply({k: g.tree() for k, g in growing.items()})

    def _run_local(self, rounds: int) -> None:
        """One task per model over all blocks, of which there are few."""
        active = {k: m for k, m in self.models.items() if not m.done}
        if not active:
            return
        start, unit, square, held, columns = self.start, self.unit, self.unit * self.top, self.held, len(self.inputs)
        # Brought together as a table: blocks would come through a second Python process a task.
        one = self._blocks(self.packed.coalesce(1))

        def fit(k: int, model: _Model):
            def each(blocks: Iterator[Block]):
                mine = [replace(b, pred={k: np.full(len(b.target), start)}) for b in blocks]
                for tree in model.trees:
                    mine = [_moved(b, {k: tree}) for b in mine]
                for _ in range(rounds):
                    if model.done:
                        break
                    growing = _Growing(model.settings, columns, len(model.trees))
                    while (wanted := growing.wanted()) is not None:
                        growing.receive(sum(_histograms(b, k, wanted, unit) for b in mine))
                    tree = growing.tree()
                    mine = [_moved(b, {k: tree}) for b in mine]
                    model.grown(tree, sum(_errors(b, k, unit, square) for b in mine) if held else None)
                yield k, model

            return each

        parts = [one.mapPartitions(fit(k, model)) for k, model in active.items()]
        for k, model in self.spark.sparkContext.union(parts).collect():  # the trees of a few models
            self.models[k] = model

    def _sum(self, wanted: dict[int, _Wanted]) -> dict[int, np.ndarray]:
        unit = self.unit

        def each(blocks: Iterator[Block]):
            total: dict[int, np.ndarray] = {}
            for block in blocks:
                for k, w in wanted.items():
                    found = _histograms(block, k, w, unit)
                    total[k] = total[k] + found if k in total else found
            yield total

        return _added(self.state.mapPartitions(each))

    def _apply(self, trees: dict[int, Tree]) -> None:
        """Add the trees to the predictions and look at the held-out errors."""
        old, unit = self.state, self.unit
        square = self.unit * self.top

        def errors(blocks: Iterator[Block]):
            total: dict[int, np.ndarray] = {}
            for block in blocks:
                for k in trees:
                    found = _errors(block, k, unit, square)
                    total[k] = total[k] + found if k in total else found
            yield total

        self.state = old.map(lambda block: _moved(block, trees)).persist(StorageLevel.MEMORY_AND_DISK)
        self.updates += 1
        if self.updates % CHECKPOINT_EVERY == 0:  # else the plan would grow with the rounds
            self.state.checkpoint()
        found = _added(self.state.mapPartitions(errors)) if self.held else {}
        for k, tree in trees.items():
            self.models[k].grown(tree, found.get(k))
        # This round's sums have computed ``old``, so nothing reads the one before it any more.
        if self.previous is not None:
            self.previous.unpersist()
        self.previous = old

    def model(self, k: int, rounds: int | None = None) -> BoostedModel:
        fitted = self.models[k]
        return BoostedModel(self.inputs, self.edges, self.start, fitted.trees[: fitted.best_round if rounds is None else rounds])

    def close(self) -> None:
        for rdd in (self.previous, self.state):
            if rdd is not None:
                rdd.unpersist()


def _add_up(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in a.keys() | b.keys()}


def _added(parts: RDD) -> dict[int, np.ndarray]:
    if parts.getNumPartitions() > DIRECT_TASKS:
        return parts.treeReduce(_add_up, depth=2)
    out: dict[int, np.ndarray] = {}
    for part in parts.collect():  # histograms of a few leaves from each of a few tasks
        out = _add_up(out, part)
    return out


@dataclass(frozen=True)
class BoostedModel:
    inputs: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]

    def values(self, x: np.ndarray) -> np.ndarray:
        """Predictions for rows of ``x``."""
        bins = to_bins(x, self.edges)
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += tree.value[tree.leaf_of(bins)]
        return out

    def predict(self, df: DataFrame, name: str = "pred_hist_gbt") -> DataFrame:
        """``df`` with non-negative predictions as column ``name``."""
        ship_package(df.sparkSession)
        values = self.values

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            return pd.Series(values(np.stack([c.to_numpy(dtype=float) for c in columns], axis=1)))

        return df.withColumn(name, clip0(score(*[F.col(c).cast("double") for c in self.inputs])))


def gbt(train: DataFrame, inputs: list[str], target: str = "daily_quantity", **settings) -> BoostedModel:
    """Boosted trees on all training rows: 60 rounds of at most 31 leaves unless told otherwise."""
    fitting = Fitting(train, inputs, target)
    try:
        k = fitting.add(Settings(**settings))
        fitting.run(fitting.models[k].settings.rounds)
        return fitting.model(k)
    finally:
        fitting.close()


def gbt_early_stop(
    train: DataFrame, held_out: DataFrame, inputs: list[str], target: str = "daily_quantity", patience: int = 20, **settings
) -> BoostedModel:
    """Boosting that ends ``patience`` rounds after the lowest held-out squared error.

    The error is updated from each new tree inside the loop; the model keeps the
    rounds up to the best one.
    """
    fitting = Fitting(train, inputs, target, held_out)
    try:
        k = fitting.add(Settings(**({"rounds": 300, "rate": 0.03, "depth": 5, "leaves": 32, "row_share": 0.8, "column_share": 0.8} | settings)), patience)
        fitting.run(fitting.models[k].settings.rounds)
        return fitting.model(k)
    finally:
        fitting.close()


def search_settings(trials: int = 20, seed: int = 42) -> list[Settings]:
    """Random settings of six parameters, the same for the same seed."""
    rng = np.random.default_rng(seed)
    return [
        Settings(
            rate=float(np.exp(rng.uniform(np.log(0.01), np.log(0.2)))),
            depth=int(rng.integers(3, 11)),
            leaves=int(rng.integers(15, 128)),
            row_share=float(rng.uniform(0.6, 1.0)),
            column_share=float(rng.uniform(0.6, 1.0)),
            rounds=int(rng.integers(80, 301)),
            min_rows=20,
        )
        for _ in range(trials)
    ]


def tune_gbt(
    train: DataFrame,
    tune: DataFrame,
    inputs: list[str],
    grid: list[Settings],
    target: str = "daily_quantity",
    first: int = 20,
    patience: int = 20,
) -> tuple[BoostedModel, Settings, list[tuple[Settings, float]]]:
    """The settings with the lowest error on a later period than the training one.

    Successive halving: all trials run ``first`` rounds side by side on one binned
    frame, the better half by absolute error on ``tune`` goes on for twice as many,
    and so on until one is left, which is fitted to its end.  Any trial ends early
    when ``patience`` rounds bring no lower squared error.  Returned are the model at
    its best round, its settings, and every trial with its lowest error in percent of
    the demand.  ``tune`` must lie after ``train`` and before the period reported.
    """
    if not grid:
        raise ValueError("an empty grid has no best setting")
    fitting = Fitting(train, inputs, target, tune)
    try:
        going = [fitting.add(settings, patience) for settings in grid]
        rounds, total = first, float(tune.agg(F.sum(F.abs(F.col(target)))).first()[0] or 0.0)

        def error(k: int) -> float:
            model = fitting.models[k]
            return min(model.absolute) / total * 100 if model.absolute and total else 0.0

        while True:
            fitting.run(rounds)
            if len(going) == 1:
                break
            ranked = sorted(going, key=lambda k: (error(k), k))
            going = ranked[: (len(ranked) + 1) // 2]
            fitting.drop(ranked[len(going) :])
            rounds = rounds * 2 if len(going) > 1 else max(s.rounds for s in grid)
        best = going[0]
        return fitting.model(best), grid[best], [(s, error(k)) for k, s in enumerate(grid)]
    finally:
        fitting.close()
