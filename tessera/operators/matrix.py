"""Sparse similarity matrices: ``row, col, q`` with row > col and similarity in 255ths; one value a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import quantized


def valid(pairs: DataFrame) -> DataFrame:
    """``row, col, q`` of ``row, col, n_intersect, n_union``: row and column are put in order, equal ones fail, so does row 0
    and an empty union."""
    fail = lambda text: F.raise_error(F.lit("ERROR: " + text)).cast("bigint")
    row, col = F.greatest("row", "col"), F.least("row", "col")
    checked = F.when(F.col("row") == F.col("col"), fail("row and column indexes must be different")).when(row == 0, fail("row index must be non-zero")).otherwise(row)
    union = F.when(F.col("n_union") == 0, fail("union count cannot be 0")).otherwise(F.col("n_union"))
    return pairs.withColumns({"_r": checked, "_c": col, "q": quantized(F.col("n_intersect"), union)}).drop("row", "col").withColumnsRenamed({"_r": "row", "_c": "col"})


def inserted(pairs: DataFrame, order: str) -> DataFrame:
    """Of values for one pair, the first by ``order`` stays."""
    return pairs.groupBy("row", "col").agg(F.min_by("q", order).alias("q"))


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union by pair; where both have a value, the left one's stays."""
    both = left.select("row", "col", "q", F.lit(0).alias("_side")).union(right.select("row", "col", "q", F.lit(1).alias("_side")))
    return inserted(both, "_side")


def appended(target: DataFrame, source: DataFrame) -> DataFrame:
    """All rows of both; nothing is looked at."""
    return target.unionByName(source)


def stats(matrix: DataFrame, element_bytes: int = 8) -> DataFrame:
    """``n_elements, n_bytes``."""
    return matrix.agg(F.count(F.lit(1)).alias("n_elements"), (F.count(F.lit(1)) * element_bytes).alias("n_bytes"))


def ordered(matrix: DataFrame) -> DataFrame:
    """Rows in the order of a saved matrix."""
    return matrix.orderBy("row", "col")
