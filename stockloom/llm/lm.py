"""Bigram scores from a log-frequency Bloom filter.

A filter holds counts on a logarithmic scale: an n-gram of level q, the number of
thresholds its count reaches, is stored as the q keys (n-gram, 1) ... (n-gram, q),
and a reader finds q by probing upwards until a key is missing.  Counts up to 5
have a level each; above that a level spans a quarter of its threshold.  A key sets
five bits of one 64-bit word, so a probe reads memory once.  A miss is always right;
a hit is wrong for about one absent key in sixty, so a level is never too low.

Words and bigrams are counted over all training texts in one pass.  The hash of an
n-gram names one of ``CELLS`` cells, and each cell gets a filter of its own size,
built in the task to which its counts come; a cell is a small part of all n-grams,
and hot n-grams are summed before the shuffle.  The cells go to the workers in
broadcasts of at most ``max_bytes``: where all of them are larger, the texts are
read once for each broadcast and the levels found so far are carried along, which
gives the same scores.

A token w after v has the probability

    share[level of v] * low(vw) / high(v) + (1 - share[level of v]) * (low(w) + 1) / (N + V + 1)

with the lowest and the highest counts of the levels found, so probabilities after
v add up to 1 at most.  The share of each level is the one of ``SHARES`` that makes
all training texts most likely when the token itself is taken out of the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.common import strings, text_or_empty
from stockloom.session import materialize

HASHES = 5
BITS_PER_ENTRY = 10.0
CELL_BITS = 14
CELLS = 1 << CELL_BITS
MAX_BYTES = 128 << 20
KNOWN_WORDS = 1 << 20
SHARES = [0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97]
_HELD_GRAMS = 1 << 21

# What ends every text; no word has a space.
END = b" "
_U = np.uint64
_ALL = (1 << 64) - 1
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def thresholds() -> np.ndarray:
    """Lowest counts of levels 1, 2, ...: all integers up to 5, then steps of a quarter."""
    steps = [1]
    while steps[-1] < 1 << 62:
        steps.append(max(steps[-1] + 1, steps[-1] * 5 // 4))
    return np.array(steps, dtype=np.int64)


LOW = np.concatenate([[0], thresholds()])  # by level
HIGH = np.append(LOW[1:] - 1, (1 << 63) - 1)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LOW, counts, side="right") - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


def token_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, the tokens of all texts as numbers of these, and the tokens per text."""
    import xxhash

    tokens, sizes = [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        tokens += words
        tokens.append(END)
        sizes.append(len(words) + 1)
    coded = pa.array(tokens, pa.large_binary()).dictionary_encode()
    hashes = np.array(list(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist())), dtype=_U)
    return hashes, coded.indices.to_numpy(), np.array(sizes, dtype=np.int64)


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in order, and the token number of each text."""
    hashes, ids, sizes = token_codes(texts)
    return hashes[ids], sizes


def bigram_keys(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For every token the key of it and the one before; a text begins after an end."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(sizes) - sizes] = words[-1] if len(words) else 0
    return _mix(before * _U(3) + (words << _U(21) | words >> _U(43)))


def _cell(keys: np.ndarray) -> np.ndarray:
    return (keys >> _U(64 - CELL_BITS)).astype(np.int64)


def _places(keys: np.ndarray, level: np.ndarray, words: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of a cell in which a key and level is looked up, and the bits set there."""
    h = _mix(keys + level.astype(_U) * _U(0x9E3779B97F4A7C15))
    spread = _mix(h + _U(0x632BE59BD9B4E019))
    bits = np.zeros(len(keys), dtype=_U)
    for k in range(HASHES):
        bits |= _U(1) << (spread >> _U(6 * k) & _U(63))
    return (h % words).astype(np.int64), bits


def cell_filter(keys: np.ndarray, counts: np.ndarray, bits_per_entry: float = BITS_PER_ENTRY) -> bytes:
    """Filter of one cell: one word of 64 bits is read for a key and level."""
    levels = level_of(counts)
    entries = int(levels.sum())
    data = np.zeros(max(1, math.ceil(entries * bits_per_entry / 64)), dtype=_U)
    level = np.arange(entries) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    at, bits = _places(np.repeat(keys, levels), level, _U(len(data)))
    np.bitwise_or.at(data, at, bits)
    return data.tobytes()


class Filter:
    """Cells ``first`` up to ``stop`` of a filter; it says nothing of other n-grams."""

    def __init__(self, first: int, stop: int, cells: dict[int, bytes]):
        self.first, self.stop = first, stop
        self.words = np.array([len(cells.get(c, b"")) // 8 for c in range(first, stop)], dtype=np.int64)
        self.starts = np.cumsum(self.words) - self.words
        self.data = np.frombuffer(b"".join(cells.get(c, b"") for c in range(first, stop)), dtype=_U)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of every key in these cells, 0 for all others: probes go on until one misses."""
        cell = _cell(keys)
        out = np.zeros(len(keys), dtype=np.uint8)
        alive = np.flatnonzero((cell >= self.first) & (cell < self.stop))
        alive = alive[self.words[cell[alive] - self.first] > 0]
        while len(alive):
            of = cell[alive] - self.first
            at, bits = _places(keys[alive], out[alive] + np.uint8(1), self.words[of].astype(_U))
            alive = alive[self.data[self.starts[of] + at] & bits == bits]
            out[alive] += 1
            alive = alive[out[alive] < len(LOW) - 1]
        return out


def trains(id_column: Column, modulus: int, held_out: int) -> Column:
    """Whether a row is learned from; rows without an id are."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(modulus)) != held_out, F.lit(True))


def count_cells(texts: DataFrame, bits_per_entry: float = BITS_PER_ENTRY) -> DataFrame:
    """(cell, filter, words, counts) of the n-grams of column ``text``.

    ``words`` are the hashes of the tokens among them and ``counts`` their exact
    counts.  Tokens are told from bigrams by the lowest bit of their key.
    """
    grams = T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def summed():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["gram", "n"])

        for batch in batches:
            words, sizes = token_hashes(strings(batch, "text"))
            if len(words):
                held += [words | _U(1), bigram_keys(words, sizes) & ~_U(1)]
                rows += 2 * len(words)
            if rows >= _HELD_GRAMS:
                yield summed()
                held, rows = [], 0
        if held:
            yield summed()

    cells = T.StructType(
        [
            T.StructField("cell", T.IntegerType()),
            T.StructField("filter", T.BinaryType()),
            T.StructField("words", T.ArrayType(T.LongType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
        ]
    )
    arrow = pa.schema(
        [("cell", pa.int32()), ("filter", pa.binary()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []

        def one():
            grams, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.zeros(len(grams), dtype=np.int64)
            np.add.at(n, at, np.concatenate([c for _, c in held]))
            words = (grams & _U(1)).astype(bool)
            row = [[now], [cell_filter(grams, n, bits_per_entry)], [grams[words].view(np.int64)], [n[words]]]
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            keys = batch.column(0).to_numpy().view(_U)
            n, cell = batch.column(1).to_numpy(), _cell(keys)
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(edges, edges[1:]):
                if a < b and cell[a] != now:
                    if held:
                        yield one()
                    now, held = int(cell[a]), []
                held.append((keys[a:b], n[a:b]))
        if held:
            yield one()

    cell = F.shiftrightunsigned("gram", 64 - CELL_BITS)
    dealt = texts.select("text").mapInArrow(count, grams).repartition(cell).sortWithinPartitions(cell)
    return dealt.mapInArrow(build, cells)


def rounds_of(sizes: dict[int, int], max_bytes: int) -> list[tuple[int, int]]:
    """Ranges of cells whose filters together are at most ``max_bytes`` (one cell at least)."""
    out, first, held = [], 0, 0
    for cell in range(CELLS):
        size = sizes.get(cell, 0)
        if held + size > max_bytes and cell > first:
            out.append((first, cell))
            first, held = cell, 0
        held += size
    return [*out, (first, CELLS)]


def _share_table(found: DataFrame, tokens: int, types: int) -> list[float]:
    """The best of ``SHARES`` for each level of the token before, over all training texts."""
    if not tokens:
        return [0.0] * len(LOW)
    sums = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LOW), len(SHARES)))
        for batch in batches:
            own, pair, before = _levels(batch)
            # Taken out of the counts: this token, and the pair that it ends.
            seen = np.maximum(LOW[pair] - 1, 0) / np.maximum(HIGH[before] - 1, 1)
            alone = np.maximum(LOW[own], 1) / (tokens + types)
            for k, share in enumerate(SHARES):
                total[:, k] += np.bincount(before, np.log(share * seen + (1 - share) * alone), len(LOW))
        kept = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept, type=pa.int32()), pa.array(total[kept].tolist(), type=pa.list_(pa.float64()))], names=["level", "sums"]
        )

    best = np.zeros((len(LOW), len(SHARES)))
    parts = found.where(~F.col("held_out")).select("levels").mapInArrow(add_up, sums)
    each = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(len(SHARES))]
    for row in parts.groupBy("level").agg(*each).collect():  # one row per level
        best[row["level"]] = [row[f"s{k}"] for k in range(len(SHARES))]
    return [SHARES[k] for k in best.argmax(axis=1)]


def _levels(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels of every token, of the pair it ends and of the token before, of a batch of texts."""
    texts = [np.frombuffer(x, dtype=np.uint8).reshape(2, -1) for x in strings(batch, "levels")]
    own = np.concatenate([x[0] for x in texts]).astype(np.int64) if texts else np.zeros(0, np.int64)
    pair = np.concatenate([x[1] for x in texts]).astype(np.int64) if texts else np.zeros(0, np.int64)
    # The token before the first one is an end, which also is the last one.
    before = np.concatenate([np.append(x[0][-1:], x[0][:-1]) for x in texts]).astype(np.int64) if texts else own
    # A pair cannot be more frequent than either of its tokens.
    return own, np.minimum(pair, np.minimum(own, before)), before


def score_documents(
    docs: DataFrame,
    modulus: int = 7,
    held_out: int = 2,
    max_bytes: int = MAX_BYTES,
    known_words: int = KNOWN_WORDS,
    bits_per_entry: float = BITS_PER_ENTRY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Log10 probabilities of every row of ``docs`` under the filter model and an exact add-one model.

    Columns: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score``.  Learned from are rows whose crc32(id as text) mod
    ``modulus`` is not ``held_out``, and rows without an id.  Null texts are empty: one
    end token.  Repeated rows count and come back as often as they are there; other
    columns are not read; an empty table gives no rows, and without training rows all
    probabilities are 1.

    Exact counts for ``base_score`` come from at most ``known_words`` of the most
    frequent tokens in a broadcast table, those of all others by a shuffled join.
    Tokens are told apart by 63 bits of XXH64.
    """
    spark = docs.sparkSession
    rows = docs.select(
        docs[id_column].alias("doc_id"),
        (~trains(docs[id_column], modulus, held_out)).alias("held_out"),
        text_or_empty(docs[text_column]).alias("text"),
    )
    cells = materialize(count_cells(rows.where(~F.col("held_out")), bits_per_entry))
    words = cells.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select("w.words", "w.counts")
    total = words.agg(F.sum("counts").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, types = total["n"] or 0, total["v"]

    least = _least_count(words, known_words)
    common = words.where(F.col("counts") >= least).toArrow().sort_by("words")
    known = spark.sparkContext.broadcast(tuple(column.to_numpy() for column in common.columns))

    sizes = {r["cell"]: r["size"] for r in cells.select("cell", F.octet_length("filter").alias("size")).collect()}
    steps = rounds_of(sizes, max_bytes)
    found = rows
    for k, (first, stop) in enumerate(steps):
        part = cells.where(F.col("cell").between(first, stop - 1)).select("cell", "filter")
        held = {row["cell"]: bytes(row["filter"]) for row in part.toLocalIterator()}
        shared = spark.sparkContext.broadcast(Filter(first, stop, held))
        del held
        found = materialize(_fill(found, shared, known if k == len(steps) - 1 else None, k > 0))
    shares = _share_table(found, tokens, types)
    scored = _score(found, shares, tokens, types)
    return _with_rare(scored, words.where(F.col("counts") < least), tokens, types)


def _least_count(words: DataFrame, most: int) -> int:
    """The lowest count that at most ``most`` words reach."""
    found, rows = 1 << 62, 0
    for row in words.groupBy("counts").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("counts")).toLocalIterator():
        rows += row["n"]
        if rows > most:
            break
        found = row["counts"]
    return found


_FOUND = T.StructType(
    [
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("log_counts", T.DoubleType()),
        T.StructField("rare", T.ArrayType(T.LongType())),
        T.StructField("levels", T.BinaryType()),
    ]
)
_FOUND_ARROW = [
    ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()),
    ("rare", pa.list_(pa.int64())), ("levels", pa.binary()),
]


def _fill(rows: DataFrame, shared, known, begun: bool) -> DataFrame:
    """Levels of all tokens and pairs in the cells of one broadcast.

    With ``known`` (the last round) the texts are replaced by their exact sums and the
    tokens that are not in the table of frequent ones.
    """
    id_field = T.StructField("doc_id", rows.schema["doc_id"].dataType)
    going_on = T.StructType(
        [id_field, _FOUND["held_out"], T.StructField("text", T.StringType()), _FOUND["levels"]]
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = strings(batch, "text")
            distinct, ids, sizes = token_codes(texts)
            starts = np.cumsum(sizes) - sizes
            pairs, of_pair = np.unique(bigram_keys(distinct[ids], sizes) & ~_U(1), return_inverse=True)
            own = shared.value.levels(distinct | _U(1))[ids]
            pair = shared.value.levels(pairs)[of_pair]
            if begun:  # every n-gram is in one broadcast
                earlier = [np.frombuffer(x, dtype=np.uint8).reshape(2, -1) for x in strings(batch, "levels")]
                own, pair = (np.maximum(now, np.concatenate([x[k] for x in earlier])) for k, now in enumerate((own, pair)))
            packed = [own[a:b].tobytes() + pair[a:b].tobytes() for a, b in zip(starts.tolist(), (starts + sizes).tolist())]
            head = [batch.column(0), batch.column(1)]
            names = ["doc_id", "held_out"]
            if known is None:
                body = [pa.array(texts, type=pa.string()), pa.array(packed, type=pa.binary())]
                yield pa.RecordBatch.from_arrays(head + body, names=[*names, "text", "levels"])
                continue
            table, counts = known.value
            mine = (distinct | _U(1)).view(np.int64)
            at = np.minimum(np.searchsorted(table, mine), max(len(table) - 1, 0))
            there = table[at] == mine if len(table) else np.zeros(len(mine), dtype=bool)
            hit = there[ids]
            logs = np.where(there, np.log10(counts[at] + 1.0), 0.0)[ids] if len(table) else np.zeros(len(ids))
            rest = mine[ids]
            rare = [rest[a:b][~hit[a:b]] for a, b in zip(starts.tolist(), (starts + sizes).tolist())]
            columns = [
                pa.array(sizes),
                pa.array(np.add.reduceat(hit.astype(np.int64), starts)),
                pa.array(np.add.reduceat(logs, starts)),
                pa.array(rare, type=pa.list_(pa.int64())),
                pa.array(packed, type=pa.binary()),
            ]
            schema = pa.schema([pa.field("doc_id", batch.schema.field(0).type), *[pa.field(*f) for f in _FOUND_ARROW]])
            yield pa.RecordBatch.from_arrays(head + columns, schema=schema)

    return rows.mapInArrow(fill, going_on if known is None else T.StructType([id_field, *_FOUND]))


def _score(found: DataFrame, shares: list[float], tokens: int, types: int) -> DataFrame:
    """``found`` with the log10 probability of every text instead of its levels."""
    out = T.StructType([f for f in found.schema if f.name != "levels"] + [T.StructField("score", T.DoubleType())])
    share = np.array(shares)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, pair, before = _levels(batch)
            sizes = batch.column(batch.schema.get_field_index("n_tokens")).to_numpy()
            seen = LOW[pair] / np.maximum(HIGH[before], 1)
            mixed = share[before] * seen + (1 - share[before]) * (LOW[own] + 1) / (tokens + types + 1)
            value = np.add.reduceat(np.log10(mixed), np.cumsum(sizes) - sizes) 
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != "levels"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value)], names=[*(n for n in batch.schema.names if n != "levels"), "score"])

    return found.mapInArrow(score, out)


def _with_rare(scored: DataFrame, rare: DataFrame, tokens: int, types: int) -> DataFrame:
    """Exact sums completed by the tokens that are not among the most frequent."""
    name = F.monotonically_increasing_id().alias("row")
    rows = materialize(scored.select("*", name))
    used = rows.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    more = (
        used.join(rare, F.col("word") == F.col("words"))
        .groupBy(F.col("row").alias("of"))
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("counts") + 1.0)).alias("more_logs"))
    )
    base = F.col("log_counts") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(tokens + types + 1))
    return rows.join(more, F.col("row") == F.col("of"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )
