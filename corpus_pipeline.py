"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import dedup_exact, encoding, language, packing, simhash, suffix
from tessera.llm.common import stored, table
from tessera.session import forget, written

#: Temporary folders of the stage before: its rows are written by the time the next one begins.
_left: list[str] = []


def stage(function: Callable) -> Callable:
    """A stage that first removes what the one before has left in the shared folder."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, _left)
        _left.clear()
        before = set(written())
        out = function(spark, docs, sf_dir)
        _left.extend(p for p in written() if p not in before)
        return out

    return run


@stage
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told stay."""
    return language.accepted(docs)


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    return dedup_exact.keep_first(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 and more), the smallest doc_id stays."""
    return simhash.one_of_each(docs)


@stage
def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller doc_id has are dropped from the texts; every document stays."""
    return suffix.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(packing.pieces(docs, encoding.vocabulary()))


STAGES = [
    ("language ID", identified),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("suffix-array dedup", unrepeated),
    ("best-fit packing", packed),
]

#: No SQL can express the stages: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces and places of what the stages keep of ``documents``.

    Each stage takes nulls in any column, empty and very long texts, repeated rows and ids, empty tables and extra columns
    as its function says; rows without letters go with the first one, so later ones see no empty text but those that
    suffix-array dedup leaves.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
