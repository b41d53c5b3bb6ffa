"""Token alignment between two vocabularies, once per distinct text.

Equal texts are counted first, by their whole text, so each is tokenised and
aligned once and its pair counts are weighted by its number of copies.

Corpus-wide pair counts come back to the texts in two ways that together are
exact: pairs at or above a count that at most ``broadcast_pairs`` pairs reach are
joined from a broadcast table of that many rows at most, all rarer ones by a
shuffled join, in which no key is frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.common import as_batch, strings, text_or_empty
from stockloom.llm.tokens import encoder
from stockloom.session import materialize, scratch_path

BROADCAST_PAIRS = 1 << 19
# A pair (a, b) of token ids as one number.
_SHIFT = 1 << 20
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

_HELD: dict[tuple[str, str], Aligner] = {}


@dataclass(frozen=True)
class Alignment:
    """Token ids of both vocabularies, the last token of each group, and linked pairs as numbers."""

    a: np.ndarray
    b: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray
    links: np.ndarray

    def counts(self) -> tuple[int, int, int, int]:
        return len(self.a), len(self.b), int(self.a_last.sum()), len(self.links)


def overlapping(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens of A and of B whose byte ranges overlap, in order."""
    a_starts, b_starts = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
    first = np.searchsorted(b_ends, a_starts, side="right")
    times = np.searchsorted(b_starts, a_ends, side="left") - first
    i = np.repeat(np.arange(len(a_ends)), times)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(times) - times - first, times)


class Aligner:
    """Aligns the tokens of a byte-level vocabulary (A) with those of a piece model (B)."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        import sentencepiece

        tool = encoder(byte_vocabulary)
        self.encode = tool.fast._core_bpe.encode_ordinary  # no string is special to it
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.b_bytes = [self._piece(k) for k in range(len(self.pieces))]
        self.a_size = np.zeros(tool.size, dtype=np.int64)
        for number, token in tool.token_bytes.items():
            self.a_size[number] = len(token)
        self.b_size = np.array([len(token) for token in self.b_bytes], dtype=np.int64)
        # Ids as text by what follows: inside or at the end of A's and B's part of a group.
        a, b = range(tool.size), range(len(self.b_bytes))
        self.shown = [f"{k}," for k in a] + [f"{k}|" for k in a] + [f"{k}," for k in b] + [f"{k};" for k in b]

    def _piece(self, number: int) -> bytes:
        piece = self.pieces.id_to_piece(number)
        if self.pieces.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        if self.pieces.is_control(number):
            return b""
        return piece.replace("▁", " ").encode()

    def align(self, texts: list[str]) -> Iterator[Alignment | None]:
        """The alignment of every text; None for texts that are empty or not spelled by their tokens."""
        for text, pieces in zip(texts, self.pieces.encode(texts, num_threads=1)):
            yield self._align(text, pieces) if text else None

    def _align(self, text: str, pieces: list[int]) -> Alignment | None:
        raw = f" {text}".encode()
        if b"".join([self.b_bytes[k] for k in pieces]) != raw:
            return None
        a, b = np.array(self.encode(f" {text}"), dtype=np.int64), np.array(pieces, dtype=np.int64)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        if a_ends[-1] != len(raw):
            return None
        a_last = b_ends[np.searchsorted(b_ends, a_ends)] == a_ends
        b_last = a_ends[np.searchsorted(a_ends, b_ends)] == b_ends
        i, j = overlapping(a_ends, b_ends)
        return Alignment(a, b, a_last, b_last, a[i] * _SHIFT + b[j])

    def groups(self, found: Alignment) -> str:
        """The groups as ``a1,a2|b1;a3|b2,b3``."""
        n, m = len(self.a_size), len(self.b_size)
        a_group, b_group = np.cumsum(found.a_last) - found.a_last, np.cumsum(found.b_last) - found.b_last
        out = np.empty(len(found.a) + len(found.b), dtype=np.int64)
        # A group's ids of A stand before its ids of B, behind all groups before it.
        b_first = np.append(0, np.flatnonzero(found.b_last) + 1)
        a_stop = np.flatnonzero(found.a_last) + 1
        out[np.arange(len(found.a)) + b_first[a_group]] = found.a + n * found.a_last
        out[np.arange(len(found.b)) + a_stop[b_group]] = 2 * n + found.b + m * found.b_last
        return "".join(map(self.shown.__getitem__, out.tolist()))[:-1]


def aligner(byte_vocabulary: str, piece_model: str) -> Aligner:
    """One aligner per Python worker and pair of files."""
    key = (byte_vocabulary, piece_model)
    if key not in _HELD:
        _HELD[key] = Aligner(*key)
    return _HELD[key]


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def aligned_texts(
    docs: DataFrame, byte_vocabulary: str, piece_model: str, text_column: str = "text", keep_groups: bool = True
) -> DataFrame:
    """One row per distinct text: (key, copies, n_a, n_b, n_groups, n_links, groups, groups_sha256, pairs, times).

    ``groups`` is the alignment as text (null without ``keep_groups``), ``pairs`` are the
    distinct linked id pairs as numbers (see ``pair_ids``), ``times`` how often the text
    links each.  Null texts are empty; texts without tokens have zeros and an empty
    alignment.
    """
    distinct = docs.groupBy(text_or_empty(docs[text_column]).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    schema = T.StructType(
        [T.StructField("key", T.BinaryType()), T.StructField("copies", T.LongType())]
        + [T.StructField(name, T.LongType()) for name in MEASURES[:4]]
        + [T.StructField(name, T.StringType()) for name in ("groups", "groups_sha256")]
        + [T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]
    )
    arrow = pa.schema(
        [("key", pa.binary()), ("copies", pa.int64())]
        + [(name, pa.int64()) for name in MEASURES[:4]]
        + [("groups", pa.string()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
    )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(byte_vocabulary, piece_model)
        for batch in batches:
            rows = []
            for key, copies, found in zip(strings(batch, "key"), strings(batch, "copies"), tool.align(strings(batch, "text"))):
                if found is None:
                    rows.append((key, copies, 0, 0, 0, 0, "" if keep_groups else None, "", [], []))
                    continue
                groups = tool.groups(found)
                pairs, times = np.unique(found.links, return_counts=True)
                digest = hashlib.sha256(groups.encode()).hexdigest()
                rows.append((key, copies, *found.counts(), groups if keep_groups else None, digest, pairs, times.astype(np.int32)))
            if rows:
                yield as_batch(rows, arrow)

    return distinct.select(_key(F.col("text")).alias("key"), "copies", "text").mapInArrow(align, schema)


def pair_ids(pair: str = "pair") -> tuple[Column, Column]:
    """The two token ids of a linked pair."""
    return F.expr(f"{pair} div {_SHIFT}").alias("a"), F.expr(f"{pair} % {_SHIFT}").alias("b")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how many documents hold a pair linked; is it its A id's highest?"""
    held = aligned.select("copies", F.explode("pairs").alias("pair"))
    counts = materialize(held.groupBy("pair").agg(F.sum("copies").alias("count")))
    a_id = F.expr(f"pair div {_SHIFT}")
    # An A id has at most as many partners as B has ids.
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(a_id)))


def common_count(counts: DataFrame, most: int) -> int:
    """The lowest count that at most ``most`` pairs reach."""
    found, rows = 1 << 62, 0
    # One row per distinct count, highest first, read until the pairs are too many.
    sizes = counts.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count"))
    for row in sizes.toLocalIterator():
        rows += row["n"]
        if rows > most:
            break
        found = row["count"]
    return found


def corpus_measures(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(key, n_best, count_sum) of every distinct text that has links."""
    least = common_count(counts, broadcast_pairs)
    links = aligned.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "key", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")
    )
    sums = [
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    ]
    common = counts.where(F.col("count") >= least)
    # A text's links stand together, so they are summed before anything is shuffled.
    found = links.join(F.broadcast(common), "pair").groupBy("key").agg(*sums)
    rare = counts.where(F.col("count") < least)
    if rare.isEmpty():
        return found
    rest = links.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(rare, "pair").groupBy("key").agg(*sums)
    return found.unionByName(rest).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(
    docs: DataFrame,
    byte_vocabulary: str,
    piece_model: str,
    broadcast_pairs: int = BROADCAST_PAIRS,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_groups: bool = False,
) -> DataFrame:
    """Alignment measures of every row of ``docs``.

    Columns: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum``, ``groups_sha256`` and, with ``keep_groups``, ``groups``.  Null and
    empty texts, and texts whose tokens do not spell them, have zeros and an empty
    ``groups_sha256``.  Repeated rows count once each and all come back; null ids are
    carried along; an empty table gives no rows; other columns are not read.  Texts are
    told apart by SHA-256 when measures are joined back.
    """
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "aligned")
    made = aligned_texts(docs, byte_vocabulary, piece_model, text_column, keep_groups)
    made.write.option("compression", "zstd").parquet(path)
    aligned = spark.read.schema(made.schema).parquet(path)
    measured = corpus_measures(aligned, materialize(pair_counts(aligned)), broadcast_pairs)
    shown = ["groups_sha256", *["groups"] * keep_groups]
    texts = aligned.select("key", *MEASURES[:4], *shown).join(measured, "key", "left")
    rows = docs.select(docs[id_column].alias("doc_id"), _key(text_or_empty(docs[text_column])).alias("of"))
    return rows.join(texts, F.col("of") == F.col("key"), "left").select(
        "doc_id", *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in MEASURES], *shown
    )
