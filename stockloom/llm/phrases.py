"""Phrases whose words come together more often than their parts suggest.

Texts are parsed into chunks that depend on content alone: a chunk goes from one
trigger, a pair of neighbouring words whose hash is divisible by ``TRIGGER``, to the
end of the next one, so no chunk begins another and neighbouring chunks share the
two words of a trigger.  Equal passages give equal chunks, and each distinct chunk
is kept once with its parse frequency.  Phrases of up to three words are counted
inside distinct chunks, weighted by that frequency; a phrase belongs to the chunk in
which it begins before the closing trigger, so what two chunks share counts once.

The dictionary is read twice.  The first pass sums hashes of words and pairs and
keeps those that may reach the least count in a Bloom filter of bounded size; a
word or pair that misses it is rare.  The second pass counts the phrases themselves
where all their parts are in the filter.  A full filter lets more rare phrases
through, never fewer frequent ones, and the exact counts decide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import strings, text_or_empty
from stockloom.session import materialize

LONGEST = 3
LEAST = 10
TOP = 2000
SCALE = 1_000_000
INSIDE_PERCENT = 50
TRIGGER = 12
FILTER_BYTES = 64 << 20
SEGMENTS = 256
_BITS_PER_KEY = 12
_HASHES = 6
# Bytes of chunks that a task works on at once.
_HELD = 4 << 20

# Between pieces, and twice behind a text; no word holds it.
BREAK = b"\n"
_U = np.uint64
# A-Z in lower case, and every sign that ends a piece as a break.
_SIGNS = bytes(b + 32 if 65 <= b <= 90 else BREAK[0] if b in b".,;:!?\n\v\f\r" else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def _hashes(tokens: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array(list(map(xxhash.xxh64_intdigest, tokens)), dtype=_U)


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(first * _U(5) + (second << _U(17) | second >> _U(47)))


def stream(text: str) -> list[bytes]:
    """The words of a text with breaks between its pieces and two behind the last one."""
    out: list[bytes] = []
    for piece in text.encode("utf-8", "surrogatepass").translate(_SIGNS).split(BREAK):
        words = piece.split()
        if words:
            out += words
            out.append(BREAK)
    if out:
        out.append(BREAK)
    return out


def chunks(tokens: list[bytes], trigger: int = TRIGGER) -> list[tuple[bytes, int]]:
    """The chunks of a stream, each its tokens joined by spaces, with the words that begin in it."""
    if not tokens:
        return []
    h = _hashes(tokens)
    begins = np.flatnonzero(_pairs(h[:-1], h[1:]) % _U(trigger) == 0)
    last = len(tokens) - 2
    starts = np.array([0, *begins[(begins > 0) & (begins < last)].tolist()])
    words = np.add.reduceat((h != h[-1])[:last], starts).tolist()
    starts = starts.tolist()
    return [(b" ".join(tokens[a : b + 2]), n) for a, b, n in zip(starts, [*starts[1:], last], words)]


def dictionary(docs: DataFrame, trigger: int = TRIGGER, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """(lang, chunk, words, n): distinct chunks with their parse frequencies; null lang is ``und``.

    ``words`` are those that the chunk counts, all but the closing trigger's.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, bytes, int]] = Counter()
            for lang, text in zip(strings(batch, "lang"), strings(batch, "text")):
                for chunk, words in chunks(stream(text), trigger):
                    found[lang, chunk, words] += 1
            if found:
                langs, texts, words = zip(*found)
                columns = [pa.array(langs), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(words, pa.int32()), pa.array(list(found.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "chunk", "words", "n"])

    rows = docs.select(F.coalesce(docs[lang_column], F.lit("und")).alias("lang"), text_or_empty(docs[text_column]).alias("text"))
    parsed = rows.mapInArrow(parse, "lang string, chunk string, words int, n long")
    return parsed.groupBy("lang", "chunk", "words").agg(F.sum("n").alias("n"))


def _gathered(batches: Iterator[pa.RecordBatch], size: int = _HELD) -> Iterator[pa.Table]:
    """Batches put together until they have about ``size`` bytes."""
    held, bytes_held = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            bytes_held += batch.nbytes
        if bytes_held >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, bytes_held = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    """A number for every value of a column, and the values by number."""
    encoded = column.combine_chunks().dictionary_encode()
    encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_pylist()


class _Tokens:
    """The tokens of some chunks as numbers, and which phrases begin where."""

    def __init__(self, table: pa.Table):
        lists = pc.split_pattern(table["chunk"], " ")
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        self.ids, self.words = _codes(pc.list_flatten(lists))
        lang, self.langs = _codes(table["lang"])
        self.lang = np.repeat(lang, sizes)
        self.n = np.repeat(table["n"].to_numpy(), sizes)
        self.hashes = _hashes([w.encode("utf-8", "surrogatepass") for w in self.words])
        word = self.hashes[self.ids] != _hashes([BREAK])[0]
        own = np.ones(len(word), dtype=bool)
        stops = np.cumsum(sizes)
        own[stops - 1] = own[stops - 2] = False  # what the next chunk counts
        # By the number of words: where phrases of so many words begin.
        self.begins = {1: np.flatnonzero(own & word)}
        for k in range(2, LONGEST + 1):
            before = self.begins[k - 1]
            self.begins[k] = before[word[before + k - 1]]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the token and of the pair that begin at every place."""
        of_lang = _mix(_hashes([lang.encode("utf-8", "surrogatepass") for lang in self.langs]))
        one = _mix(self.hashes[self.ids] ^ of_lang[self.lang])
        return one | _U(1), _pairs(one[:-1], one[1:]) & ~_U(1)

    def phrases(self, at: np.ndarray, k: int) -> tuple[list[str], list[str], np.ndarray]:
        """(languages, phrases, counts) of the distinct phrases of ``k`` words at these places."""
        parts = [self.lang[at], *(self.ids[at + j] for j in range(k))]
        order = np.lexsort(parts)
        parts = [p[order] for p in parts]
        new = np.zeros(len(at), dtype=bool)
        new[:1] = True
        for p in parts:
            new[1:] |= p[1:] != p[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            return [], [], np.zeros(0, dtype=np.int64)
        lang, *columns = ([names[i] for i in p[first].tolist()] for names, p in zip([self.langs, *[self.words] * k], parts))
        return lang, columns[0] if k == 1 else list(map(" ".join, zip(*columns))), np.add.reduceat(self.n[at][order], first)


class KeyFilter:
    """Bloom filter of 64-bit keys in equal segments, named by the first bits of a key."""

    def __init__(self, bits: int):
        self.bits = bits  # of a segment
        self.data = np.zeros((SEGMENTS, bits // 8), dtype=np.uint8)

    def add(self, keys: np.ndarray) -> None:
        for row, at in self._places(keys):
            np.bitwise_or.at(self.data, (row, at >> 3), (1 << (at & 7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for row, at in self._places(keys):
            found &= (self.data[row, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return found

    def _places(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        row, step = (keys >> _U(56)).astype(np.int64), _mix(keys) | _U(1)
        for k in range(_HASHES):
            yield row, ((keys + _U(k) * step) % _U(self.bits)).astype(np.int64)


def frequent_keys(parsed: DataFrame, least: int) -> DataFrame:
    """(key) of words and pairs whose hashes come at least ``least`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            read = _Tokens(table)
            keys = np.concatenate([keys[read.begins[k]] for keys, k in zip(read.keys(), (1, 2))])
            if not len(keys):
                continue
            n = np.concatenate([read.n[read.begins[k]] for k in (1, 2)])
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sums = np.add.reduceat(n[order], first)
            yield pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(sums)], names=["key", "n"])

    summed = parsed.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return summed.where(F.col("n") >= least).select("key")


def key_filter(keys: DataFrame, most_bytes: int = FILTER_BYTES) -> KeyFilter:
    """The keys as a filter of at most ``most_bytes``; the tasks build its segments."""
    bytes_each = min(keys.count() * _BITS_PER_KEY // 8, most_bytes) // SEGMENTS + 8
    bits = bytes_each * 8

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = KeyFilter(bits), set()
        for batch in batches:
            found = batch.column(0).to_numpy().view(_U)
            own.add(found)
            seen.update(np.unique(found >> _U(56)).tolist())
        if seen:
            rows = [own.data[k].tobytes() for k in sorted(seen)]
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), type=pa.int32()), pa.array(rows)], names=["segment", "data"])

    out = KeyFilter(bits)
    for row in keys.repartition(F.shiftrightunsigned("key", 56)).mapInArrow(build, "segment int, data binary").toLocalIterator():
        out.data[row["segment"]] = np.frombuffer(row["data"], dtype=np.uint8)
    return out


def phrase_counts(parsed: DataFrame, least: int = LEAST, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """(lang, phrase, words, f): every phrase of up to three words that comes ``least`` times or more."""
    spark = parsed.sparkSession
    shared = spark.sparkContext.broadcast(key_filter(materialize(frequent_keys(parsed, least)), most_bytes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            read = _Tokens(table)
            one, two = read.keys()
            often = {1: shared.value.has(one), 2: np.append(shared.value.has(two), False)}
            for k in range(1, LONGEST + 1):
                at = read.begins[k]
                # All words or pairs inside are frequent, or the phrase is not.
                for j in range(max(1, k - 1)):
                    at = at[often[min(k, 2)][at + j]]
                langs, phrases, sums = read.phrases(at, k)
                columns = [pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array([k] * len(langs), pa.int32()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "f"])

    found = parsed.mapInArrow(count, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def score_cuts(counts: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): candidates with their lowest-scoring cut.

    Products are decimals of 38 digits: exact for counts below 10^15.
    """
    wide = counts.where(F.col("words") > 1).withColumn("w", F.split("phrase", " "))
    cut = wide.select("lang", "phrase", "words", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select(
        "lang", "phrase", "words", "a", "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"),
    )
    of = counts.select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of"), "f")
    for part, name in (("first", "l"), ("rest", "r")):
        joined = cut.join(of, (F.col("lang") == F.col("of_lang")) & (F.col(part) == F.col("of")))
        cut = joined.withColumnRenamed("f", name).drop("of_lang", "of")

    score = F.expr(
        f"cast(cast({scale} as decimal(7,0)) * cast(a as decimal(16,0)) * cast(a as decimal(15,0)) as decimal(38,0))"
        " div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))"
    )
    scored = cut.withColumn("score", score)
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return scored.groupBy("lang", "phrase", "words", "a").agg(best).select(
        "lang", "phrase", "words", "a", "best.l", "best.r", "best.score"
    )


def mine_phrases(
    docs: DataFrame,
    least: int = LEAST,
    top: int = TOP,
    scale: int = SCALE,
    inside_percent: int = INSIDE_PERCENT,
    trigger: int = TRIGGER,
    filter_bytes: int = FILTER_BYTES,
    lang_column: str = "lang",
    text_column: str = "text",
) -> DataFrame:
    """The ``top`` phrases of two or three words of each language.

    Columns: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` (see
    the module text).  Words are lower-cased in A-Z and do not cross ``. , ; : ! ?`` or
    line breaks.  A phrase is left out if a longer candidate that holds it comes at
    least ``inside_percent`` percent as often.  Null texts are empty, a null language
    is ``und``; repeated rows count as often as they come; ids and other columns are
    not read; an empty table gives no rows.
    """
    parsed = materialize(dictionary(docs, trigger, lang_column, text_column))
    sizes = word_totals(parsed)
    counts = materialize(phrase_counts(parsed, least, filter_bytes))
    scored = materialize(score_cuts(counts, scale))
    longer = scored.where(F.col("words") > 2).withColumn("w", F.split("phrase", " "))
    held = longer.select(
        F.col("lang").alias("in_lang"),
        F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.array_join(F.slice("w", k, F.lit(2)), " ")))).alias("held"),
        F.col("a").alias("longer"),
    )
    held = held.groupBy("in_lang", "held").agg(F.max("longer").alias("longer"))
    kept = scored.join(held, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("held")), "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    # One row per language, at most ``top`` per language beside it.
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def word_totals(parsed: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences."""
    return parsed.groupBy("lang").agg(F.sum(F.col("words") * F.col("n")).alias("n"))
