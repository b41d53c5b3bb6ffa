"""Near-duplicate vectors: random-hyperplane hashing, exact cosines, components.

Equal vectors are one node with a multiplicity.  In each of several tables a
vector's bucket is the sign pattern of its products with random hyperplanes.
Buckets are as large as a task can hold (32 MiB in double precision), so few signs
and few tables are needed and a vector is shuffled only as often as there are
tables; inside a bucket a second family of smaller tables, which costs memory of
the task but no shuffle, says which vectors to compare.  Both numbers of tables
follow from the wanted recall of a pair exactly at the threshold, half of the
misses each.  Cosines are matrix products in double precision.

A pair that shares buckets in several tables is counted in the first one: both
sides carry their signatures, so this is seen without collecting pairs.  Tasks
return one row per vector with its number of links, and a spanning forest of the
links, never the pairs.  A bucket with more than ``block`` vectors is cut into
blocks, and each pair of blocks is a task of its own.  With a recall of 1 there is
one bucket, so all pairs are compared, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.common import as_batch
from stockloom.llm.components import connected_components
from stockloom.session import materialize

THRESHOLD = 0.9
RECALL = 0.998
BUCKET = 128
BLOCK_BYTES = 32 << 20
COMPARED = 1 << 22
SEED = 11


def table_plan(distinct: int, threshold: float, recall: float, bucket: int) -> tuple[int, int]:
    """(signs per table, tables) for ``distinct`` vectors in buckets of about ``bucket``."""
    agree = 1 - math.acos(threshold) / math.pi
    signs = min(60, math.ceil(math.log2(max(1, distinct / bucket))))
    if recall >= 1 or signs == 0:
        return 0, 1
    hit = agree**signs
    return signs, max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit)))


def _signatures(matrix: np.ndarray, signs: int, tables: int, seed: int) -> np.ndarray:
    """Bucket number of every row in every table."""
    out = np.empty((len(matrix), tables), dtype=np.int64)
    powers = 1 << np.arange(signs, dtype=np.int64)
    for t in range(tables):
        planes = np.random.Generator(np.random.Philox(key=[seed, t])).standard_normal((matrix.shape[1], signs))
        out[:, t] = (matrix @ planes > 0) @ powers
    return out


def distinct_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their vector's key and whether it can link, nodes with multiplicity).

    Vectors that are null, empty, zero or hold null or non-finite components
    cannot link, nor can rows without an id.  Vectors of different lengths never do.
    """
    v = F.col("vector")
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    usable = F.col("vec_id").isNotNull() & finite & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    element = vectors.schema[vector_column].dataType.elementType
    rows = vectors.select(
        vectors[id_column].alias("vec_id"), vectors[vector_column].alias("vector")
    ).withColumn("usable", usable)
    # Adding zero makes -0.0 and 0.0 the same value before grouping.
    rows = rows.withColumn("vector", F.when(F.col("usable"), F.transform(v, lambda x: (x + F.lit(0).cast(element)))))
    nodes = rows.where("usable").groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    return rows, nodes


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; the largest component is
    scaled first, which keeps squares in range."""
    matrix = matrix.astype(np.float64)
    matrix /= np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def count_links(units: np.ndarray, copies: np.ndarray, earlier: np.ndarray, split: int, threshold: float):
    """(links, root) per row of one bucket or pair of blocks.

    Rows are compared with later ones or, if ``split`` is below their number, those
    before it with those from it on.  Pairs that agree in a column of ``earlier``
    were counted elsewhere.
    """
    n = len(units)
    links, root = np.zeros(n, dtype=np.int64), np.arange(n)
    begin = split if split < n else 0
    step = max(1, COMPARED // max(n, 1))
    for start in range(0, split, step):
        close = units[start : min(start + step, split)] @ units[begin:].T >= threshold
        if begin == 0:
            close = np.triu(close, start + 1)
        for a in start + np.flatnonzero(close.any(axis=1)):
            others = begin + np.flatnonzero(close[a - start])
            others = others[~(earlier[others] == earlier[a]).any(axis=1)]
            if not len(others):
                continue
            links[a] += copies[others].sum()
            links[others] += copies[a]
            met = np.unique(root[np.append(others, a)])
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    return links, root


def local_links(units, copies, earlier, far, threshold: float, recall: float, bucket: int, seed: int):
    """Yields (rows, links, root) of each small bucket of the vectors of one task.

    ``far`` marks the second block of a pair of blocks, behind the first; rows are then
    compared across.  Every task draws its planes from the same seed.
    """
    n, cross = len(units), bool(far.any())
    signs, tables = table_plan(n, threshold, recall, bucket)
    marks = _signatures(units, signs, tables, seed)
    for t in range(tables):
        order = np.argsort(marks[:, t], kind="stable")
        ends = np.append(np.flatnonzero(np.diff(marks[order, t])) + 1, n)
        for start, end in zip(np.append(0, ends[:-1]), ends):
            rows = order[start:end]
            split = int((~far[rows]).sum()) if cross else len(rows)
            if len(rows) < 2 or cross and split in (0, len(rows)):
                continue
            met = np.hstack([earlier[rows], marks[rows, :t]])
            yield rows, *count_links(units[rows], copies[rows], met, split, threshold)


def bucket_links(
    nodes: DataFrame, threshold: float, recall: float, signs: int, tables: int, bucket: int, block: int, seed: int
) -> DataFrame:
    """Per bucket and linked vector (node, links, joined): copies linked there, and one forest edge."""
    key = ["table", "bucket", "length"]
    short = nodes.schema["vector"].dataType.elementType == T.FloatType()
    kind = np.dtype("<f4" if short else "<f8")
    dealt_schema = T.StructType(
        [
            T.StructField("table", T.IntegerType()),
            T.StructField("bucket", T.LongType()),
            T.StructField("length", T.IntegerType()),
            T.StructField("node", T.LongType()),
            T.StructField("copies", T.LongType()),
            T.StructField("values", T.BinaryType()),
            T.StructField("earlier", T.BinaryType()),
        ]
    )
    arrow = pa.schema(
        [
            ("table", pa.int32()),
            ("bucket", pa.int64()),
            ("length", pa.int32()),
            ("node", pa.int64()),
            ("copies", pa.int64()),
            ("values", pa.binary()),
            ("earlier", pa.binary()),
        ]
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, names, copies = (column.to_pylist() for column in batch.columns)
            for length in sorted({len(v) for v in vectors}):
                where = [k for k, v in enumerate(vectors) if len(v) == length]
                matrix = np.array([vectors[k] for k in where], dtype=kind)
                found = _signatures(_unit_rows(matrix), signs, tables, seed)
                values, marks = [row.tobytes() for row in matrix], found.astype("<i8")
                for t in range(tables):
                    rows = [
                        (t, int(found[i, t]), length, names[k], copies[k], values[i], marks[i, :t].tobytes())
                        for i, k in enumerate(where)
                    ]
                    yield as_batch(rows, arrow)

    dealt = nodes.select("vector", "node", "copies").mapInArrow(deal, dealt_schema)
    # A bucket of n blocks becomes n (n + 1) / 2 tasks; a vector goes to those of its own block.
    large = materialize(
        dealt.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("size"))
        .where(F.col("size") > block)
        .select(*key, F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tasks = (
        dealt.join(large, key, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", own)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .drop("blocks", "other")
    )

    def link(group: tuple, members: pa.Table) -> pa.Table:
        table, low, high = group[0].as_py(), group[3].as_py(), group[4].as_py()
        names, own = members["node"].to_numpy(), members["own"].to_numpy()
        order = np.lexsort((names, own))
        names, own, copies = names[order], own[order], members["copies"].to_numpy()[order]
        values, marks = members["values"].to_pylist(), members["earlier"].to_pylist()
        units = _unit_rows(np.frombuffer(b"".join(values[k] for k in order), dtype=kind).reshape(len(order), -1))
        earlier = np.frombuffer(b"".join(marks[k] for k in order), dtype="<i8").reshape(len(order), table)
        far = own == high if low != high else np.zeros(len(names), dtype=bool)
        found = [
            (names[rows[touched]], links[touched], names[rows[root[touched]]])
            for rows, links, root in local_links(units, copies, earlier, far, threshold, recall, bucket, seed + 1)
            if len(touched := np.flatnonzero(links))
        ]
        if not found:
            return linked.empty_table()
        return pa.table([np.concatenate(column) for column in zip(*found)], schema=linked)

    linked = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("joined", pa.int64())])
    out_schema = T.StructType([T.StructField(name, T.LongType()) for name in ("node", "links", "joined")])
    return tasks.groupBy(*key, "low", "high").applyInArrow(link, out_schema)


def near_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    bucket: int = BUCKET,
    block: int | None = None,
    seed: int = SEED,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    ``n_links`` counts the other rows linked directly, copies included;
    ``component_id`` is the smallest id reachable.  Rows that cannot link (null, zero
    or non-finite vectors) are components of their own; a row without an id has no
    component and is kept.  Repeated rows link with each other; rows that share an id
    but not a vector are separate vectors with one name, so their links are one
    component.  Labels and other columns are not read; an empty table gives no rows.
    ``block``, the most vectors of one task's side, is by default what fits in
    ``BLOCK_BYTES``; a recall of 1 is exact and compares all pairs, block by block.
    """
    rows, nodes = distinct_vectors(vectors, id_column, vector_column)
    nodes = materialize(nodes)
    distinct, length = nodes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    block = block or max(1, BLOCK_BYTES // (8 * (length or 1)))
    each = (1 + recall) / 2
    signs, tables = table_plan(distinct, threshold, each, max(1, block // 2))
    found = materialize(bucket_links(nodes, threshold, each, signs, tables, bucket, block, seed))
    linked = found.groupBy(F.col("node").alias("linked")).agg(F.sum("links").alias("links"))
    reached = connected_components(found, "node", "joined").withColumnRenamed("node", "reached")
    of_vector = (
        nodes.join(linked, F.col("node") == F.col("linked"), "left")
        .join(reached, F.col("node") == F.col("reached"), "left")
        .select(
            F.col("vector").alias("of_vector"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    return rows.join(of_vector, F.col("vector") == F.col("of_vector"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
