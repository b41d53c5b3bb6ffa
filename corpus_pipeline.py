"""A training-data pipeline over ``documents``.

Four stages: drop what is in no learned language, keep one document of each group
of near-copies, interleave the sources by target weights, pack into windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockloom.llm.common import ready, table
from stockloom.llm.language import keep_identified
from stockloom.llm.mixing import mix_sources
from stockloom.llm.packing import pack_files
from stockloom.llm.queries import vocabulary
from stockloom.llm.simhash import keep_one_of_each
from stockloom.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language (operator 7)."""
    ready(spark)
    return keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (operator 8)."""
    ready(spark)
    return keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources interleaved by tempered weights; small ones come more than once (operator 4)."""
    ready(spark)
    return mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2,048 tokens, numbered in the order of the mixture (operator 10)."""
    ready(spark)
    return pack_files(docs, vocabulary())


STAGES = [
    ("language identification", identify_language),
    ("near-copies by SimHash", drop_near_copies),
    ("source mixture", mix),
    ("packing", pack),
]

# The stages train a model and pack by shortest paths, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each reads what the one before has written to the shared scratch folder."""
    docs = table(ready(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
