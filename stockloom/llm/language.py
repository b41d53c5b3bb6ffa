"""Language of documents by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point.  A
trigram is bound from its letters, each shifted by its place, and a text is the
sum (bundle) of its trigrams.  The prototype of a language is the bundle of its
labelled texts; a document takes the language whose prototype has the largest
cosine with its own vector.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.common import fresh, strings, text_or_empty

DIMENSIONS = 1024
# Pieces of up to 2^12 trigrams show what longer texts reach.
LENGTHS = 13
# The first so many of them, up to 2^7 trigrams, are summed sign by sign.
SHORT_LENGTHS = 8
# Scores of pieces are told apart to 1 / SCORE_STEPS.
SCORE_STEPS = 10_000
MAX_LANGUAGES = 1000
UNDETERMINED = "und"
_SPACE = 32
_ROWS = 1 << 14
_SHIFT = 21


_LETTER, _MARK = 1, 2


@cache
def _kinds() -> np.ndarray:
    """Letter, combining mark or neither, by code point."""
    marks = {"Mn", "Mc"}
    kinds = (_LETTER if chr(c).isalpha() else _MARK if unicodedata.category(chr(c)) in marks else 0 for c in range(0x110000))
    return np.fromiter(kinds, dtype=np.uint8, count=0x110000)


def _in_words(codes: np.ndarray) -> np.ndarray:
    """Letters, and the marks that follow a letter: vowel signs and accents belong to it."""
    kind = _kinds()[codes]
    letter, mark = kind == _LETTER, kind == _MARK
    if not mark.any():
        return letter
    # The last sign before each place that is no mark, the place itself included.
    base = np.maximum.accumulate(np.where(mark, -1, np.arange(len(codes))))
    return letter | (mark & (base >= 0) & letter[base])


def trigram_keys(text: str) -> np.ndarray:
    """Trigram keys of the whole text in their order.

    Letters are lower-cased and keep the combining marks behind them; every run of
    other signs is one space, also before the first and behind the last letter.  No letters, no trigrams.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    codes = np.where(_in_words(codes), codes, _SPACE)
    codes = np.concatenate([[_SPACE], codes, [_SPACE]])
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
    codes = codes[keep]
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64)
    return codes[:-2] << 2 * _SHIFT | codes[1:-1] << _SHIFT | codes[2:]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram keys of the whole text and their counts."""
    return np.unique(trigram_keys(text), return_counts=True)


class Profiles:
    """Vectors of texts; trigram vectors are kept in a bounded table."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.rows = np.zeros((_ROWS, dimensions), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= _ROWS:
                self.letters.clear()
            draw = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[code] = 2 * draw - 1
        return self.letters[code]

    def bound(self, key: int) -> np.ndarray:
        low = (1 << _SHIFT) - 1
        first, second, third = key >> 2 * _SHIFT, key >> _SHIFT & low, key & low
        return np.roll(self.letter(first), 2) * np.roll(self.letter(second), 1) * self.letter(third)

    def bundle(self, text: str) -> np.ndarray | None:
        """Sum of the trigram vectors of ``text``; None without a letter."""
        return self.bundle_keys(trigram_keys(text))

    def bundle_keys(self, ordered: np.ndarray) -> np.ndarray | None:
        """Sum of the vectors of these trigrams; None without any."""
        keys, counts = np.unique(ordered, return_counts=True)
        return self.weighted(keys, counts[None])[0] if len(keys) else None

    def vectors(self, keys: list[int]) -> np.ndarray:
        """One row per trigram, for at most half as many as the table holds."""
        rows = [self.place.get(key, -1) for key in keys]
        if -1 in rows:
            if len(self.place) + rows.count(-1) > _ROWS:
                self.place.clear()
            for k, key in enumerate(keys):
                if key not in self.place:
                    self.place[key] = len(self.place)
                    self.rows[self.place[key]] = self.bound(key)
                rows[k] = self.place[key]
        return self.rows[rows].astype(np.float32)

    def weighted(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weighted sums of the vectors of these trigrams, one for each row of ``weights``."""
        total = np.zeros((len(weights), self.dimensions), dtype=np.float64)
        for start in range(0, len(keys), _ROWS // 2):
            part = slice(start, start + _ROWS // 2)
            vectors = self.vectors(keys[part].tolist())
            # One product for each of the few rows: faster than one for all of them.
            for row, weight in zip(total, weights[:, part].astype(np.float32)):
                row += weight @ vectors
        return total

    def nested(self, ordered: np.ndarray, lengths: int = LENGTHS) -> np.ndarray:
        """Bundles of the middle 1, 2, 4, ... of these trigrams, at most ``lengths``, then of all.

        The vectors of the text are fetched once for all pieces.
        """
        n = len(ordered)
        starts = [(n - (1 << size)) // 2 for size in range(min(n.bit_length(), lengths))]
        spans = [(start, start + (1 << size)) for size, start in enumerate(starts)]
        short, long = spans[:SHORT_LENGTHS], [*spans[SHORT_LENGTHS:], (0, n)]
        # Every short piece lies within the next one, which adds its two ends.
        first, last = short[-1]
        signs, out = self.vectors(ordered[first:last].tolist()), []
        piece, left, right = np.zeros(self.dimensions), short[0][0], short[0][0]
        for start, stop in short:
            piece = piece + signs[start - first : left - first].sum(axis=0) + signs[right - first : stop - first].sum(axis=0)
            left, right = start, stop
            out.append(piece)
        keys, at = np.unique(ordered, return_inverse=True)
        counts = np.array([np.bincount(at[start:stop], minlength=len(keys)) for start, stop in long])
        return np.concatenate([out, self.weighted(keys, counts)])


def prototypes(
    labelled: DataFrame, dimensions: int = DIMENSIONS, per_language: int | None = None
) -> dict[str, np.ndarray]:
    """One vector per value of ``lang`` from all rows (doc_id, text, lang).

    With ``per_language`` at most about so many texts of each language are bundled,
    chosen by the hash of the id; languages with fewer use all of theirs.  Tasks return one
    vector per language, summed in Spark, so the driver gets languages x dimensions
    numbers.
    """
    return {lang: v / np.linalg.norm(v) for lang, v in _sums(labelled, dimensions, per_language).items()}


def _sample(labelled: DataFrame, per_language: int | None) -> tuple[list[str], DataFrame | None]:
    """The values of ``lang`` and the rows (lang, text), all or those chosen from each."""
    counts = labelled.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    shares = {row["lang"]: min(1.0, (per_language or row["n"]) / row["n"]) for row in counts.limit(MAX_LANGUAGES + 1).collect()}
    if len(shares) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    if not shares:
        return [], None
    if per_language is None:
        return sorted(shares), labelled.where(F.col("lang").isNotNull()).select("lang", text_or_empty("text").alias("text"))
    share = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])[F.col("lang")]
    # The text takes part, so rows without an id are drawn like others.
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(F.col("lang").isNotNull() & (place < share))
    return sorted(shares), chosen.select("lang", text_or_empty("text").alias("text"))


def _sums(labelled: DataFrame, dimensions: int, per_language: int | None) -> dict[str, np.ndarray]:
    """Sum of the unit vectors of the chosen texts of each language."""
    languages, sample = _sample(labelled, per_language)
    if not languages:
        return {}
    schema = T.StructType(
        [T.StructField("lang", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType()))]
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dimensions), {}
        for batch in batches:
            for lang, text in zip(strings(batch, "lang"), strings(batch, "text")):
                vector = profiles.bundle(text)
                if vector is not None:
                    vector = vector / np.linalg.norm(vector)
                    sums[lang] = sums[lang] + vector if lang in sums else vector
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], names=["lang", "vector"]
            )

    summed = (
        sample.mapInArrow(add_up, schema)
        .select("lang", F.posexplode("vector").alias("at", "value"))
        .groupBy("lang", "at")
        .agg(F.sum("value").alias("value"))
    )
    out = {lang: np.zeros(dimensions) for lang in languages}
    for row in summed.toLocalIterator():
        out[row["lang"]][row["at"]] = row["value"]
    return {lang: v for lang, v in out.items() if v.any()}


def expected_scores(
    labelled: DataFrame, sums: dict[str, np.ndarray], dimensions: int = DIMENSIONS, per_language: int | None = None
) -> list[float]:
    """Median cosine of labelled pieces of 1, 2, 4, ... trigrams with their own language.

    The pieces are cut from the middle of every text, or of about ``per_language``
    texts of each language; the text itself is taken out of the prototype before.
    Scores are counted by their first four digits, so the median is that of all
    pieces to this precision.  The list ends with the first length of which there is
    no piece.
    """
    _, sample = _sample(labelled, per_language)
    if sample is None:
        return []

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dimensions)
        for batch in batches:
            sizes, scores = [], []
            for lang, text in zip(strings(batch, "lang"), strings(batch, "text")):
                keys = trigram_keys(text)
                if not len(keys) or lang not in sums:
                    continue
                *pieces, whole = profiles.nested(keys)
                if not whole.any():
                    continue
                others = sums[lang] - whole / np.linalg.norm(whole)
                apart = np.linalg.norm(others)
                # What rounding leaves of the only text of a language is no prototype.
                if apart < 1e-6:
                    continue
                for size, piece in enumerate(pieces):
                    norm = np.linalg.norm(piece) * apart
                    sizes.append(size)
                    scores.append(float(piece @ others / norm) if norm else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(scores, pa.float64())], names=["size", "score"])

    step = F.round(F.col("score") * SCORE_STEPS).cast("long").alias("step")
    counted = sample.mapInArrow(cosines, "size long, score double").groupBy("size", step).agg(F.count(F.lit(1)).alias("n"))
    steps: dict[int, list[tuple[int, int]]] = {}
    # At most LENGTHS x (2 SCORE_STEPS + 1) rows.
    for row in counted.collect():
        steps.setdefault(row["size"], []).append((row["step"], row["n"]))
    return [_median(steps[size]) / SCORE_STEPS for size in range(len(steps))]


def _median(counted: list[tuple[int, int]]) -> int:
    """The lower median of values with their counts."""
    values, counts = zip(*sorted(counted))
    total = np.cumsum(counts)
    return values[int(np.searchsorted(total, (total[-1] + 1) // 2))]


def held_out(doc_id: str | Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; false without an id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict_language(
    docs: DataFrame,
    models: dict[str, np.ndarray],
    text_column: str = "text",
    keep_text: bool = False,
    names: tuple[str, str] = ("lang_pred", "score"),
    size_name: str | None = None,
) -> DataFrame:
    """``docs`` with the predicted language and its score, by default in place of the text.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text when nothing was learned.  Ties go to the first language by name.  The
    score is the cosine, cut at 0.  Repeated rows get equal answers; other columns are
    carried along untouched; an empty table gives no rows.  ``size_name`` adds the
    number of trigrams.
    """
    languages = sorted(models)
    dimensions = len(next(iter(models.values()))) if models else DIMENSIONS
    matrix = np.array([models[name] for name in languages]) if languages else np.zeros((0, dimensions))
    others = [c for c in docs.columns if keep_text or c != text_column]
    schema = T.StructType(
        [docs.schema[c] for c in others]
        + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
        + ([T.StructField(size_name, T.LongType())] if size_name else [])
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dimensions)
        for batch in batches:
            found, scores, sizes = [], [], []
            for text in batch.column(len(others)).to_pylist():
                keys = trigram_keys(text or "")
                sizes.append(len(keys))
                vector = profiles.bundle_keys(keys) if languages else None
                norm = 0.0 if vector is None else float(np.linalg.norm(vector))
                if not norm:
                    found.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                cosines = matrix @ vector / norm
                best = int(np.argmax(cosines))
                found.append(languages[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], pa.array(found, pa.string()), pa.array(scores, pa.float64())]
                + ([pa.array(sizes, pa.int64())] if size_name else []),
                names=schema.names,
            )

    text = docs[text_column].alias(fresh(docs, "_text"))
    return docs.select(*[docs[c] for c in others], text).mapInArrow(score, schema)


def identify(docs: DataFrame, dimensions: int = DIMENSIONS, per_language: int | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the rows that are not held out."""
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "lang", "text")
    models = prototypes(rows.where(~F.col("held_out")).select("doc_id", "text", "lang"), dimensions, per_language)
    return predict_language(rows.select("doc_id", "held_out", "text"), models)


# Share of the expected score that a text must reach, and what chance alone reaches
# in units of the deviation of a cosine of random vectors.
LEAST_SHARE = 0.5
CHANCE = 3.0


def keep_identified(
    docs: DataFrame, least_share: float = LEAST_SHARE, dimensions: int = DIMENSIONS, per_language: int | None = None
) -> DataFrame:
    """The rows of ``docs`` that are in one of the languages learned from its labels.

    Rejected are texts that are null or have no letter, and those whose score is below
    ``least_share`` of what labelled pieces of as many trigrams reach in the median
    (taken at the power of two below), or what chance reaches when no label tells.
    When no row has a label nothing can be learned, and only the texts without a
    letter are rejected.
    """
    labelled = docs.select("doc_id", "text", "lang")
    sums = _sums(labelled, dimensions, per_language)
    if not sums:
        letters = F.length(F.regexp_replace(text_or_empty("text"), r"\P{L}+", ""))
        return docs.where(letters > 0)
    models = {lang: v / np.linalg.norm(v) for lang, v in sums.items()}
    cuts = [least_share * score for score in expected_scores(labelled, sums, dimensions)] or [CHANCE / dimensions**0.5]
    names, size = (fresh(docs, "_lang_pred"), fresh(docs, "_score")), fresh(docs, "_trigrams")
    judged = predict_language(docs, models, keep_text=True, names=names, size_name=size)
    place = F.least(F.floor(F.log2(size)), F.lit(len(cuts) - 1)).cast("int")
    cut = F.get(F.array(*[F.lit(float(c)) for c in cuts]), place)
    return judged.where((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= cut)).drop(*names, size)
