"""Similarity values and the order of pairs in the lower triangle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantized(n_intersect: Column, n_union: Column) -> Column:
    """Jaccard similarity in 255ths, rounded down; null for an empty union, fails if the intersection is larger."""
    fits = F.when(n_intersect <= n_union, n_intersect).otherwise(F.raise_error(F.lit("ERROR: intersection larger than union")).cast("bigint"))
    return F.when(n_union > 0, F.floor(F.lit(255) * fits.cast("bigint") / F.nullif(n_union, F.lit(0))).cast("int"))


def printed(q: Column) -> Column:
    """Four decimals of q / 255."""
    return F.format_string("%.4f", q / F.lit(255.0))


def rank(row: Column, col: Column) -> Column:
    """Index of a pair with row > col in the lower triangle taken row by row, without the diagonal."""
    row = row.cast("bigint")
    return F.shiftright(row * (row - 1), 1) + col


def unrank(index: Column) -> tuple[Column, Column]:
    """Row and column of an index. The root is taken in doubles and set right by one where they round."""
    index = index.cast("bigint")
    near = F.floor((F.sqrt((F.lit(8) * index + 1).cast("double")) + 1) / 2).cast("bigint")
    below = lambda r: F.shiftright(r * (r - 1), 1)
    row = F.when(below(near) > index, near - 1).when(below(near + 1) <= index, near + 1).otherwise(near)
    return row, index - below(row)
