"""Token sequences in training order: fixed-stride binary shards.

Each partition of documents is one stream of token ids, cut into sequences of
``window`` ids.  A sequence's number is its place in the partition after the numbers
reserved for the partitions before; a token has at least one byte, so the bytes of
the texts bound the sequences of a partition before anything is encoded.  A keyed
Feistel network over the next even number of bits permutes the numbers, and cycle
walking (apply it again until the result is in range) keeps them in the reserved
range.  The order of the permuted numbers is the training order.

The permuted range is cut into equal parts, one shard each.  A shard's records have
one length, so record k of a shard is at k * stride and the global slot of a sequence
is its index plus the records of the shards before: a reader starts at any slot with
one seek.  Texts are encoded once and shuffled once, as ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.common import file_system, in_slices, strings, text_or_empty
from stockloom.llm.tokens import encoder
from stockloom.session import materialize, scratch_path

WINDOW = 2048
END_ID = 1
PAD_ID = 0
SHARD_RECORDS = 1 << 13
KEY = 0x5EED
ROUNDS = 6
MAX_SHARDS = 1 << 16


class Permutation:
    """A keyed bijection of 0 .. size - 1."""

    def __init__(self, size: int, key: int = KEY, rounds: int = ROUNDS):
        if not 0 <= size <= 1 << 62:
            raise ValueError("the range must have at most 2**62 numbers")
        self.size = size
        self.half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.Generator(np.random.Philox(key=key)).integers(0, 1 << 63, rounds, dtype=np.uint64)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))

    def _once(self, x: np.ndarray, keys: np.ndarray, inverse: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in keys:
            if inverse:
                left, right = right ^ (self._mix(left ^ key) & self.mask), left
            else:
                left, right = right, left ^ (self._mix(right ^ key) & self.mask)
        return left << self.half | right

    def _walk(self, numbers, inverse: bool) -> np.ndarray:
        x = np.asarray(numbers, dtype=np.uint64)
        if len(x) and int(x.max()) >= self.size:
            raise ValueError("number out of range")
        keys = self.keys[::-1] if inverse else self.keys
        out = self._once(x, keys, inverse)
        while (outside := out >= np.uint64(self.size)).any():
            out[outside] = self._once(out[outside], keys, inverse)
        return out.astype(np.int64)

    def forward(self, numbers) -> np.ndarray:
        return self._walk(numbers, False)

    def backward(self, numbers) -> np.ndarray:
        return self._walk(numbers, True)


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    pad_id: int = PAD_ID,
    shard_records: int = SHARD_RECORDS,
    key: int = KEY,
    text_column: str = "text",
) -> DataFrame:
    """Write all sequences; one row (slot, number, shard, path, byte_offset, n_tokens, crc32) each.

    ``crc32`` is over the record as stored, little-endian ids of two bytes, or four for
    larger vocabularies.  The last sequence of a partition is filled up with ``pad_id``.

    ``docs`` is read twice, for its sizes and for its texts, and must have the same
    partitions both times, as stored tables have; more sequences than were reserved
    raise an error.  Null texts are empty and give the end id alone; repeated rows come
    as often as they are; other columns are not read; an empty table gives no rows.
    """
    texts = docs.select(text_or_empty(docs[text_column]).alias("text"))
    sizes = (
        texts.groupBy(F.spark_partition_id().alias("part"))
        .agg(F.sum(F.octet_length("text") + 1).alias("bytes"))
        .collect()
    )
    reserved = {row["part"]: -(-row["bytes"] // window) for row in sizes}
    starts, total = {}, 0
    for part in sorted(reserved):
        starts[part] = total
        total += reserved[part]
    # About two numbers are reserved for every sequence; beyond MAX_SHARDS shards grow instead.
    shards = max(1, min(MAX_SHARDS, -(-total // (2 * shard_records))))
    per_shard = -(-total // shards) if total else 1
    dealt_schema = T.StructType(
        [
            T.StructField("shard", T.LongType()),
            T.StructField("place", T.LongType()),
            T.StructField("number", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    arrow = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("number", pa.int64()), ("ids", pa.binary())])

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        tool, order = encoder(tokenizer), Permutation(total, key)
        part = TaskContext.get().partitionId()
        begin, room = starts.get(part, 0), reserved.get(part, 0)
        end = np.array([end_id], dtype=tool.dtype)
        held, size, done = [], 0, 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, done
            ids = np.concatenate(held) if held else np.zeros(0, dtype=tool.dtype)
            stop = len(ids) if last else len(ids) // window * window
            pieces = [ids[k : k + window].tobytes() for k in range(0, stop, window)]
            held, size = [ids[stop:]], len(ids) - stop
            if not pieces:
                return
            if done + len(pieces) > room:
                raise RuntimeError("the documents changed between two readings of their partitions")
            numbers = np.arange(begin + done, begin + done + len(pieces), dtype=np.int64)
            done += len(pieces)
            places = order.forward(numbers)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places // per_shard), pa.array(places), pa.array(numbers), pa.array(pieces, pa.binary())],
                schema=arrow,
            )

        batch = first
        while batch is not None:
            for text in strings(batch, "text"):
                ids = tool.encode(text)
                held += [ids, end]
                size += len(ids) + 1
                if size >= 256 * window:
                    yield from cut(last=False)
            batch = next(batches, None)
        yield from cut(last=True)

    rows_schema = T.StructType(
        [
            T.StructField("shard", T.LongType()),
            T.StructField("index", T.LongType()),
            T.StructField("number", T.LongType()),
            T.StructField("path", T.StringType()),
            T.StructField("byte_offset", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("crc32", T.LongType()),
        ]
    )
    rows_arrow = pa.schema(
        [(f.name, pa.string() if f.name == "path" else pa.int64()) for f in rows_schema.fields]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)

        def rows():
            tool = encoder(tokenizer)
            width, fill = tool.dtype.itemsize, np.array([pad_id], dtype=tool.dtype).tobytes()
            open_shard, file, index, path = None, None, 0, ""
            for batch in batches:
                for shard, _, number, ids in zip(*(column.to_pylist() for column in batch.columns)):
                    if shard != open_shard:
                        if file is not None:
                            file.close()
                        system.create_dir(base, recursive=True)
                        path = f"{base}/shard-{shard:07d}-{TaskContext.get().taskAttemptId()}.bin"
                        open_shard, file, index = shard, system.open_output_stream(path, compression=None), 0
                    n = len(ids) // width
                    record = ids + fill * (window - n)
                    file.write(record)
                    yield shard, index, number, path, index * len(record), n, zlib.crc32(record)
                    index += 1
            if file is not None:
                file.close()

        yield from in_slices(rows(), rows_arrow)

    written = materialize(
        texts.mapInArrow(sequences, dealt_schema)
        .repartitionById(shards, F.col("shard").cast("int"))
        .sortWithinPartitions("shard", "place")
        .mapInArrow(write, rows_schema)
    )
    # One row per shard, so at most MAX_SHARDS.
    ahead = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = written.groupBy("shard").agg(F.count(F.lit(1)).alias("records")).select(
        "shard", F.coalesce(F.sum("records").over(ahead), F.lit(0)).alias("base")
    )
    return written.join(bases, "shard").select(
        (F.col("base") + F.col("index")).alias("slot"), "number", "shard", "path", "byte_offset", "n_tokens", "crc32"
    )


def order_documents(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """``write_shards`` into ``folder``, by default one below the shared scratch folder."""
    return write_shards(docs, tokenizer, folder or scratch_path(docs.sparkSession, f"shards-{uuid.uuid4().hex[:8]}"), **options)


def read_shard(path: str, window: int, itemsize: int, first: int = 0, records: int | None = None) -> np.ndarray:
    """Records of a shard from index ``first`` on, one row each: one seek, then sequential."""
    system, name = file_system(path)
    stride = window * itemsize
    with system.open_input_file(name) as file:
        file.seek(first * stride)
        data = file.read() if records is None else file.read(records * stride)
    return np.frombuffer(data, dtype=f"<u{itemsize}").reshape(-1, window)
