"""Threshold-scaled fingerprints of documents, in SQL expressions only.

A sketch keeps every hash of a five-word shingle that lies below a fixed
fraction of the hash range.  The sketch of a union is the union of the sketches,
and the share of one sketch found in another estimates how much of the one text
the other contains, however unequal their lengths.  A text with fewer than
``FLOOR`` such hashes keeps its ``FLOOR`` smallest, so short texts are compared
exactly.  A sketch shows up to which hash it is complete, and two sketches are
compared below the lower of their two limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import text_or_empty
from stockloom.session import materialize

SHINGLE = 5
FRACTION = 1 / 8
FLOOR = 32
_SPACES = r"[\x20\t-\r]+"


def _let(body, *values: Column) -> Column:
    """``body`` of ``values``, each of which is computed once per row."""
    bound = F.struct(*[value.alias(f"v{k}") for k, value in enumerate(values)])
    return F.get(F.transform(F.array(bound), lambda row: body(*[row[f"v{k}"] for k in range(len(values))])), F.lit(0))


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words (runs of signs other than ASCII spaces)."""
    words = F.filter(F.split(F.lower(text), _SPACES), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, width: int = SHINGLE) -> Column:
    """One hash per run of ``width`` words; a shorter text is one shingle, an empty one none."""
    n = F.size(hashes)
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]),
    )
    return F.when(n >= width, runs).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def _limit(fraction: float) -> Column:
    return F.lit(-(1 << 63) + int(fraction * (1 << 64))).cast("long")


def keep_below(hashes: Column, fraction: float = FRACTION) -> Column:
    """The sketch: distinct hashes in the lowest ``fraction`` of the range, ascending."""
    kept = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < _limit(fraction))))
    smallest = F.slice(F.array_sort(F.array_distinct(hashes)), 1, FLOOR)
    return _let(lambda found: F.when(F.size(found) >= FLOOR, found).otherwise(smallest), kept)


def complete_up_to(sketch: Column, fraction: float = FRACTION) -> Column:
    """The largest hash up to which the sketch has all hashes of its text."""
    last = F.element_at(sketch, -1)
    return (
        F.when(F.size(sketch) < FLOOR, F.lit((1 << 63) - 1))
        .when(last >= _limit(fraction), last)
        .otherwise(_limit(fraction) - 1)
    )


def with_sketch(df: DataFrame, text: str, out: str, width: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """``df`` with the sketch of column ``text`` as column ``out``."""
    return (
        df.withColumn(out, word_hashes(F.col(text)))
        .withColumn(out, shingle_hashes(F.col(out), width))
        .withColumn(out, keep_below(F.col(out), fraction))
    )


def _below_common(body, a: Column, b: Column, fraction: float) -> Column:
    """``body`` of the parts of two sketches up to which both are complete."""
    limit = F.least(complete_up_to(a, fraction), complete_up_to(b, fraction))
    return _let(
        lambda x, y, top: _let(body, F.filter(x, lambda h: h <= top), F.filter(y, lambda h: h <= top)), a, b, limit
    )


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Sketch of two texts taken together."""
    return _below_common(lambda x, y: keep_below(F.concat(x, y), fraction), a, b, fraction)


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; an empty ``a`` is contained."""
    found = lambda x, y: F.when(F.size(x) == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))
    return _below_common(found, a, b, fraction)


def likeness(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike."""

    def jaccard(x: Column, y: Column) -> Column:
        return _let(
            lambda common, both: F.when(both == 0, 1.0).otherwise(common / (both - common)),
            F.size(F.array_intersect(x, y)),
            F.size(x) + F.size(y),
        )

    return _below_common(jaccard, a, b, fraction)


def as_text(sketch: Column) -> Column:
    """The sketch as 16 hex digits per hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def fingerprint_documents(
    docs: DataFrame,
    width: int = SHINGLE,
    fraction: float = FRACTION,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, n_chars, sketch) of every row; null texts are empty."""
    rows = docs.select(docs[id_column].alias("doc_id"), text_or_empty(docs[text_column]).alias("text"))
    return with_sketch(rows, "text", "sketch", width, fraction).select("doc_id", F.length("text").cast("long").alias("n_chars"), "sketch")


def following_ids(ids: DataFrame, key: str) -> DataFrame:
    """(key, next_key): the next larger of the distinct ``key`` values, the first after the last.

    Keys are dealt into range slices, so a window sees one slice; one row per
    slice says where the next one begins.
    """
    sliced = materialize(ids.select(key).repartitionByRange(F.col(key)).withColumn("slice", F.spark_partition_id()))
    every = Window.partitionBy(F.lit(0))
    # One row per slice, so at most the shuffle parallelism.
    starts = (
        sliced.groupBy("slice")
        .agg(F.min(key).alias("first_key"))
        .select(
            "slice",
            F.lead("first_key").over(every.orderBy("slice")).alias("next_first"),
            F.min("first_key").over(every).alias("lowest"),
        )
    )
    inside = Window.partitionBy("slice").orderBy(key)
    return sliced.withColumn("follower", F.lead(key).over(inside)).join(starts, "slice").select(
        key, F.coalesce("follower", "next_first", "lowest").alias("next_key")
    )


def compare_edits(
    docs: DataFrame,
    width: int = SHINGLE,
    fraction: float = FRACTION,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited form replaces the last quarter of the code points by as many from
    the start of the document with the next id (all of it, if that is shorter).

    The texts are shuffled once by id: where a text is the next one of another, its
    beginning and its sketch go on to that one.

    Null texts are empty.  Rows that share an id all meet the same next document,
    the one with the smallest beginning among rows of the next id.  Rows without an
    id have no next document: an empty one takes its place.  A single document is its
    own next.  An empty table gives no rows; other columns are not read.
    """
    # A new name for the id gives both uses of the texts the same plan, so they share one shuffle.
    all_rows = docs.select(docs[id_column].alias("key"), text_or_empty(docs[text_column]).alias("text"))
    rows = all_rows.where(F.col("key").isNotNull())
    lengths = rows.groupBy("key").agg(F.floor(F.max(F.length("text")) / 4).cast("int").alias("wanted"))
    lengths = materialize(lengths)
    wanted = following_ids(lengths, "key").join(lengths, "key")
    wanted = wanted.select(F.col("key").alias("wanted_by"), F.col("next_key"), "wanted")

    beginnings = rows.join(wanted, F.col("key") == F.col("next_key"))
    beginnings = with_sketch(beginnings, "text", "next_sketch", width, fraction)
    beginnings = beginnings.groupBy("wanted_by").agg(
        F.min(F.struct(F.expr("left(text, wanted)").alias("beginning"), "next_sketch")).alias("following")
    )
    met = rows.join(beginnings, F.col("key") == F.col("wanted_by"), "left").select(
        F.col("key").alias("doc_id"), "text", "following.beginning", "following.next_sketch"
    )
    without = all_rows.where(F.col("key").isNull()).select(
        F.col("key").alias("doc_id"), "text", F.lit("").alias("beginning"), F.array().cast("array<bigint>").alias("next_sketch")
    )
    return _likeness_rows(met, width, fraction).unionByName(_likeness_rows(without, width, fraction))


def _likeness_rows(met: DataFrame, width: int, fraction: float) -> DataFrame:
    replaced = F.floor(F.length("text") / 4).cast("int")
    out = met.withColumn(
        "edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.substring(F.col("beginning"), F.lit(1), replaced))
    )
    out = with_sketch(out, "text", "sketch", width, fraction)
    out = with_sketch(out, "edited", "edited_sketch", width, fraction)
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), fraction).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), fraction).alias("near_next"),
    )
