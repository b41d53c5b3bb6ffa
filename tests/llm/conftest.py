import pytest
from pyspark.sql import types as T

from stockloom.llm.common import ready

LONG = T.LongType()
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", LONG),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", LONG),
        # Names that the operators use inside.
        *[T.StructField(name, T.StringType()) for name in ("fp", "node", "key", "slot", "score", "sketch", "_text")],
    ]
)
ODD_TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs home again", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs home again", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs home again", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, "word " * 30_000, "en", "b"),
    (6, "12 34 -- !!", "de", "b"),
    (None, "der schnelle braune fuchs springt über den faulen hund", "de", None),
    (None, None, None, "b"),
    (7, "x", "de", ""),
    (8, "日本語のテキスト  \U0001f600 é\n\nzwei  spaces ", "ja", "c"),
]


@pytest.fixture(scope="session")
def llm(spark):
    return ready(spark)


@pytest.fixture
def odd(llm):
    rows = [(*row, 1, *["x"] * 7) for row in ODD_TEXTS]
    return llm.createDataFrame(rows, DOCUMENTS).repartition(2)


@pytest.fixture
def nothing(llm):
    return llm.createDataFrame([], DOCUMENTS)


@pytest.fixture
def documents(llm, small):
    return llm.read.parquet(f"{small}/documents.parquet")
