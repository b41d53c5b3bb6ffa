"""Connected components of a graph of long ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.session import materialize


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Each round joins every node's neighbours to the smallest of them, first
    towards larger neighbours, then towards smaller ones, until only stars are
    left.  A round is written to the shared scratch folder, so lineage stays short
    and a lost executor costs one round.  Nothing but two numbers per round comes
    to the driver.  Nulls and loops are ignored.
    """
    a, b = F.col(left), F.col(right)
    links = materialize(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
        .distinct()
    )
    state = _state(links)
    while True:
        both = links.select(F.col("v").alias("node"), F.col("u").alias("other")).union(links.select("u", "v"))
        lowest = both.groupBy("node").agg(F.min("other").alias("low"))
        lowest = lowest.select("node", F.least("node", "low").alias("low"))
        outward = (
            both.join(lowest, "node")
            .where(F.col("other") > F.col("node"))
            .select(F.col("other").alias("v"), F.col("low").alias("u"))
            .distinct()
        )
        lowest = outward.groupBy("v").agg(F.min("u").alias("low"))
        inward = (
            outward.join(lowest, "v")
            .select(F.explode(F.array(F.struct("v", "low"), F.struct(F.col("u").alias("v"), "low"))).alias("e"))
            .select("e.v", F.col("e.low").alias("u"))
            .where(F.col("v") != F.col("u"))
            .distinct()
        )
        links = materialize(inward)
        now = _state(links)
        if now == state:
            break
        state = now
    return links.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        links.select("u", "u").distinct()
    )


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
    return row["n"], row["x"]


class Forest:
    """Union-find over the members of one bounded group; roots are smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
