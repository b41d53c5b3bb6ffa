"""Pack documents, in their order, into windows of a fixed number of tokens.

Every document is its token ids and one end id.  The stream of a partition is
cut into windows of at most ``window`` tokens.  Where to cut is a shortest path
over the possible cuts: ends of documents (free), ends of sentences and, inside
long stretches without either, a grid of positions.  A window costs its padding
plus the price of the cut that ends it,

    cost[k] = min over i with p[k] - p[i] <= window of
              cost[i] + (window - (p[k] - p[i])) + price[k]

so the best predecessor minimises ``cost[i] + p[i]`` over a sliding range,
which a monotone queue keeps: each cut enters and leaves it once.

The stream is solved in stretches of ``stretch`` tokens; the last window of a
stretch is carried into the next one.  What remains at the end of a partition is
cut at powers of two, which need no padding.  No row is shuffled, memory is
one stretch or one document, whichever is longer, and a lost task repeats with
the same result because it depends on its partition alone.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.common import in_slices, strings, text_or_empty
from stockloom.llm.tokens import encoder
from stockloom.session import materialize

WINDOW = 2048
END_ID = 1
SENTENCE_PRICE = 2
GRID_PRICE = 24
GRID = 32
STRETCH = 1 << 19

_INT = pa.int64()


def choose_cuts(positions: list[int], prices: list[int], window: int) -> list[int]:
    """Indices of the cheapest cuts from the first to the last position.

    ``positions`` ascend with gaps of at most ``window``; the first index is
    left out of the result, the last is always in it.
    """
    n = len(positions)
    cost = [0] * n
    before = [0] * n
    key = [0] * n
    key[0] = positions[0]
    queue = deque([0])
    for k in range(1, n):
        at = positions[k]
        while at - positions[queue[0]] > window:
            queue.popleft()
        best = queue[0]
        before[k] = best
        total = key[best] + window - at + prices[k]
        cost[k] = total
        value = total + at
        key[k] = value
        while queue and key[queue[-1]] >= value:
            queue.pop()
        queue.append(k)
    cuts = []
    k = n - 1
    while k:
        cuts.append(k)
        k = before[k]
    return cuts[::-1]


def possible_cuts(ids: np.ndarray, document_ends: np.ndarray, ends_sentence: np.ndarray, window: int):
    """Positions and prices of the cuts inside one stretch, first position 0."""
    price = np.full(len(ids) + 1, -1, dtype=np.int32)
    price[1:][ends_sentence[ids]] = SENTENCE_PRICE
    price[document_ends] = 0
    price[0] = 0
    price[-1] = max(price[-1], 0)
    known = np.flatnonzero(price >= 0)
    gaps = np.diff(known)
    step = min(GRID, window)
    for k in np.flatnonzero(gaps > step):
        price[known[k] + step : known[k + 1] : step] = GRID_PRICE
    positions = np.flatnonzero(price >= 0)
    return positions.tolist(), price[positions].tolist()


def powers_of_two(n: int) -> list[int]:
    """Lengths, largest first, of the binary digits of ``n``."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Stream:
    """The documents of one partition, cut into windows as they come."""

    def __init__(self, ends_sentence: np.ndarray, window: int, stretch: int):
        self.ends_sentence, self.window, self.stretch = ends_sentence, window, stretch
        self.held: list[tuple] = []  # document, start inside it, ids, tokens of the document
        self.tokens = 0

    def add(self, document, ids: np.ndarray) -> Iterator[list[tuple]]:
        self.held.append((document, 0, ids, len(ids)))
        self.tokens += len(ids)
        if self.tokens >= self.stretch:
            yield from self.cut(last=False)

    def cut(self, last: bool) -> Iterator[list[tuple]]:
        """Windows as lists of (document, start, ids, tokens of the document)."""
        if not self.held:
            return
        ids = np.concatenate([part[2] for part in self.held])
        ends = np.cumsum([len(part[2]) for part in self.held])
        positions, prices = possible_cuts(ids, ends, self.ends_sentence, self.window)
        stops = [positions[k] for k in choose_cuts(positions, prices, self.window)]
        tail = stops[-2] if len(stops) > 1 else 0
        if last:
            rest = powers_of_two(len(ids) - tail) if len(ids) - tail < self.window else [len(ids) - tail]
            stops = stops[:-1] + (tail + np.cumsum(rest)).tolist()
        else:
            stops = stops[:-1]
        firsts = ends - [len(part[2]) for part in self.held]
        at = 0
        for stop in stops:
            yield self._parts(firsts, ends, at, stop)
            at = stop
        self.held = [] if last else self._parts(firsts, ends, at, len(ids))
        self.tokens = 0 if last else len(ids) - at

    def _parts(self, firsts: np.ndarray, ends: np.ndarray, start: int, stop: int) -> list[tuple]:
        out = []
        k = int(np.searchsorted(ends, start, side="right"))
        while k < len(ends) and firsts[k] < stop:
            document, before, ids, whole = self.held[k]
            a, b = max(start - int(firsts[k]), 0), min(stop, int(ends[k])) - int(firsts[k])
            out.append((document, before + a, ids[a:b], whole))
            k += 1
        return out


def windows_of(
    documents: Iterator[tuple], ends_sentence: np.ndarray, window: int = WINDOW, stretch: int = STRETCH
) -> Iterator[list[tuple]]:
    """Windows of (document, ids) pairs, each a list of parts in order."""
    stream = _Stream(ends_sentence, window, stretch)
    for document, ids in documents:
        yield from stream.add(document, ids)
    yield from stream.cut(last=True)


def pack_files(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
    stretch: int = STRETCH,
) -> DataFrame:
    """The pieces of ``pack_documents`` for rows read from Parquet files, in the order of the files.

    Tasks read files in any order and in parts.  Here every run of rows of one file is a
    stream of its own, and windows are numbered without gaps by file name and row, so
    ``sequence_id`` follows the order in which the rows were written.  ``docs`` must come
    straight from a Parquet scan, whose ``_metadata`` names file and row.
    """
    kind = docs.schema[id_column].dataType
    numbers = ("start", "length", "ids_crc32", "doc_tokens", "number", "offset", "first")
    out = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in numbers], T.StructField("file", T.StringType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        tool = encoder(tokenizer)
        end, ends_sentence = np.array([end_id], dtype=tool.dtype), tool.ends_sentence()
        fields = [("doc_id", first.schema.field(0).type), *[(n, _INT) for n in numbers], ("file", pa.string())]

        def runs():
            """Each run of rows that follow each other in one file, as (file, first row, documents)."""
            rows = (row for batch in chain([first], batches) for row in zip(*(c.to_pylist() for c in batch.columns)))
            held = next(rows, None)

            def run(file, place):
                nonlocal held
                while held is not None and held[2:] == (file, place):
                    yield held[0], np.concatenate([tool.encode(held[1]), end])
                    held, place = next(rows, None), place + 1

            while held is not None:
                yield held[2], held[3], run(held[2], held[3])

        def pieces():
            for file, place, documents in runs():
                for number, parts in enumerate(windows_of(documents, ends_sentence, window, stretch)):
                    offset = 0
                    for document, start, ids, whole in parts:
                        yield document, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), whole, number, offset, place, file
                        offset += len(ids)

        yield from in_slices(pieces(), pa.schema(fields))

    narrow = docs.select(
        docs[id_column].alias("doc_id"),
        text_or_empty(docs[text_column]).alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("first"),
    )
    packed = materialize(narrow.mapInArrow(pack, out))
    # One row per run, which is at most one per file and task: names sort by length, then text.
    order = Window.partitionBy(F.lit(0)).orderBy(F.length("file"), "file", "first")
    runs = packed.groupBy("file", "first").agg((F.max("number") + 1).alias("windows"))
    runs = runs.withColumn("base", F.sum("windows").over(order) - F.col("windows"))
    runs = runs.select(F.col("file").alias("of_file"), F.col("first").alias("of_first"), "base")
    return packed.join(runs, (F.col("file") == F.col("of_file")) & (F.col("first") == F.col("of_first"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("number")).alias("sequence_id"), "offset"
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
    stretch: int = STRETCH,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: where it comes from and where it lies.

    Columns: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and, with ``keep_ids``, ``ids``.

    Null texts are empty and give the end id alone; null ids are carried along;
    repeated rows are packed as often as they come; other columns are not read;
    an empty table gives no rows.
    """
    out = [
        T.StructField("doc_id", docs.schema[id_column].dataType),
        *[
            T.StructField(name, T.LongType())
            for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        ],
    ]
    if keep_ids:
        out.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        tool = encoder(tokenizer)
        end = np.array([end_id], dtype=tool.dtype)
        kind = first.schema.field(0).type
        fields = [pa.field("doc_id", kind), *[pa.field(f.name, _INT) for f in out[1:7]]]
        schema = pa.schema(fields + ([pa.field("ids", pa.list_(_INT))] if keep_ids else []))
        base = TaskContext.get().partitionId() << 32

        def documents():
            for batch in chain([first], batches):
                for document, text in zip(strings(batch, "doc_id"), strings(batch, "text")):
                    yield document, np.concatenate([tool.encode(text), end])

        def rows():
            for number, parts in enumerate(windows_of(documents(), tool.ends_sentence(), window, stretch)):
                offset = 0
                for document, start, ids, whole in parts:
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    row = (document, start, len(ids), crc, whole, base + number, offset)
                    yield (*row, ids.tolist()) if keep_ids else row
                    offset += len(ids)

        yield from in_slices(rows(), schema)

    narrow = docs.select(docs[id_column].alias("doc_id"), text_or_empty(docs[text_column]).alias("text"))
    return narrow.mapInArrow(pack, T.StructType(out))
