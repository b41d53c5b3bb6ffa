"""Near-duplicate documents by 64-bit SimHash, linked through BK-trees.

Documents with equal fingerprints are one node.  Two fingerprints within radius
r agree on at least one of r + 1 blocks of bits, so each fingerprint goes to the
r + 1 shards named by its block values, and a shard holds every neighbour of its
members that shares its block.  In a shard a BK-tree is grown: the children of a
node are keyed by their Hamming distance to it, and a search follows only the
edges within the radius of the distance to the node.  The tree of a shard is
built where its queries are, since both come by the same key; a broadcast of all
trees would grow with the corpus.

A shard above ``shard_limit`` is not given to one task.  Its members agree on
the bits of the block, so they are dealt again by blocks of the remaining bits,
with the same guarantee.  After four such steps at most 13 bits are free, which
bounds a shard of distinct fingerprints at 8,192.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.common import fresh, in_slices, strings, text_or_empty
from stockloom.llm.components import Forest, connected_components
from stockloom.session import materialize

SEED = 42
SHINGLE = 3
RADIUS = 2
SHARD_LIMIT = 1024
LEVELS = 4
BITS = 64
_SLICE = 1 << 16


def simhash(text: str, words_per_shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of the whole text; words are runs of non-space ASCII-lowered bytes."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(words_per_shingle, len(words))
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for first in range(0, len(starts), _SLICE):
        pairs = zip(starts[first : first + _SLICE], stops[first : first + _SLICE])
        hashes = np.array([digest(joined[a:b], seed) for a, b in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; null texts are empty."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("fp", T.LongType())]
    )

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(text) for text in strings(batch, "text")], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    narrow = docs.select(docs[id_column].alias("doc_id"), text_or_empty(docs[text_column]).alias("text"))
    return narrow.mapInArrow(compute, schema)


class BKTree:
    """Fingerprints keyed by integer Hamming distance to their parent."""

    def __init__(self):
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, item: int, radius: int) -> list[int]:
        """Indices of the members at most ``radius`` bits away."""
        found, open_nodes = [], [0] if self.items else []
        while open_nodes:
            node = open_nodes.pop()
            distance = (self.items[node] ^ item).bit_count()
            if distance <= radius:
                found.append(node)
            children = self.children[node]
            if len(children) <= 2 * radius + 1:
                open_nodes += [child for d, child in children.items() if abs(d - distance) <= radius]
            else:
                for d in range(max(1, distance - radius), distance + radius + 1):
                    if d in children:
                        open_nodes.append(children[d])
        return found

    def add(self, item: int) -> None:
        """Add a fingerprint that is not in the tree."""
        number, node = len(self.items), 0
        self.items.append(item)
        self.children.append({})
        while number:
            distance = (self.items[node] ^ item).bit_count()
            below = self.children[node].setdefault(distance, number)
            if below == number:
                return
            node = below


def shard_links(items: list[int], radius: int) -> list[tuple[int, int]]:
    """Index pairs that connect each linked group of a shard, at most one per member."""
    tree, forest = BKTree(), Forest(len(items))
    for k, item in enumerate(items):
        for other in tree.within(item, radius):
            forest.join(k, other)
        tree.add(item)
    return [(forest.root(k), k) for k in range(len(items)) if forest.root(k) != k]


def _split(bits: list[int], parts: int) -> list[list[int]]:
    size, extra = divmod(len(bits), parts)
    out, at = [], 0
    for k in range(parts):
        stop = at + size + (k < extra)
        out.append(bits[at:stop])
        at = stop
    return out


def _signed_mask(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(levels: int, parts: int) -> list[list[int]]:
    """Per level the masks of all paths; path p of a level opens paths p * parts + j of the next."""
    free = [list(range(BITS))]
    out = []
    for _ in range(levels):
        masks, rest = [], []
        for bits in free:
            blocks = _split(bits, parts)
            masks += [_signed_mask(block) for block in blocks]
            rest += [[b for b in bits if b not in set(block)] for block in blocks]
        out.append(masks)
        free = rest
    return out


def near_links(nodes: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(a, b) node pairs that connect all of ``nodes`` (fp, node) within ``radius`` bits."""
    parts = radius + 1
    edges_schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    out_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for members in batch.column(0).to_pylist():
                    members = sorted((m["node"], m["fp"]) for m in members)
                    names = [node for node, _ in members]
                    for a, b in shard_links([fp & (1 << BITS) - 1 for _, fp in members], radius):
                        yield names[a], names[b]

        yield from in_slices(rows(), out_schema)

    links = None
    dealt = nodes.select("fp", "node", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("shard"))
    for level, masks in enumerate(block_masks(LEVELS, parts)):
        mask_of = F.array(*[F.lit(m).cast("long") for m in masks])
        step = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("block")
        dealt = dealt.select("fp", "node", "path", "shard", step).select(
            "fp",
            "node",
            (F.col("path") * parts + F.col("block")).alias("path"),
            F.xxhash64(
                "shard", "block", F.col("fp").bitwiseAND(F.get(mask_of, (F.col("path") * parts + F.col("block")).cast("int")))
            ).alias("shard"),
        )
        sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
        fits = F.col("size") >= 2
        last = level == LEVELS - 1
        if not last:
            sizes = materialize(sizes.where(fits))
            fits = fits & (F.col("size") <= shard_limit)
        groups = (
            dealt.join(sizes.where(fits), "shard")
            .groupBy("shard")
            .agg(F.collect_list(F.struct("node", "fp")).alias("members"))
            .select("members")
        )
        found = groups.mapInArrow(search, edges_schema)
        links = found if links is None else links.union(found)
        if last:
            break
        large = sizes.where(F.col("size") > shard_limit).select("shard")
        if large.isEmpty():
            break
        dealt = materialize(dealt.join(large, "shard", "left_semi").select("fp", "node", "path", "shard"))
    return links


def near_duplicates(
    docs: DataFrame,
    radius: int = RADIUS,
    shard_limit: int = SHARD_LIMIT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` is the smallest
    id that links reach.  Null and empty texts have fingerprint zero, which links
    like any other.  Repeated rows are in one group; rows that share an id count as
    one node.  A row without an id takes part only through an equal fingerprint: it
    gets that group's component, else null.  An empty table gives no rows; other
    columns are not read.
    """
    marked = materialize(fingerprints(docs, id_column, text_column))
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("node")))
    links = near_links(nodes.where(F.col("node").isNotNull()), radius, shard_limit)
    found = connected_components(links, "a", "b").withColumnRenamed("node", "linked")
    of_fp = nodes.join(found, F.col("node") == F.col("linked"), "left").select(
        F.col("fp").alias("of_fp"), F.coalesce("component", "node").alias("component_id")
    )
    return marked.join(of_fp, F.col("fp") == F.col("of_fp"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, one row per id.

    Of rows that share an id the one with the smallest text stays.  Rows without an id
    cannot be named by a group and all stay.
    """
    groups = near_duplicates(docs, radius, shard_limit)
    name = fresh(docs, "_kept_id")
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    chosen = docs.join(kept, docs["doc_id"] == F.col(name), "left_semi")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    one = chosen.groupBy("doc_id").agg(F.min_by(whole, text_or_empty("text")).alias("row")).select("row.*")
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
