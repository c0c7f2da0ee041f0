"""Even chunks of work, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import unrank


def thread_ranges(count: int, size: int) -> list[tuple[int, int]]:
    """``count`` ranges of ``size`` elements."""
    return [(i * size, (i + 1) * size) for i in range(count)]


def chunk_sizes(spark: SparkSession, n: int, chunks: int) -> DataFrame:
    """``chunk, size``: an even split; the first chunks take one more each until nothing is left over."""
    size = F.lit(n // chunks) + (F.col("id") < n % chunks).cast("bigint")
    return spark.range(chunks).select(F.col("id").alias("chunk"), size.alias("size"))


def chunk_ranges(spark: SparkSession, start: int, n: int, chunks: int) -> DataFrame:
    """``chunk, row0, col0, row1, col1``: first pair of each chunk of the lower triangle and the one after its last."""
    least, more = n // chunks, n % chunks
    begin = F.lit(start) + F.col("id") * least + F.least(F.col("id"), F.lit(more))
    end = begin + least + (F.col("id") < more).cast("bigint")
    (r0, c0), (r1, c1) = unrank(begin), unrank(end)
    return spark.range(chunks).select(F.col("id").alias("chunk"), r0.alias("row0"), c0.alias("col0"), r1.alias("row1"), c1.alias("col1"))


def group_range_end(groups: DataFrame, start_group: int, start_pair: int, size: int) -> DataFrame:
    """``group, pair_count``: where a chunk of ``size`` pairs ends that begins with pair ``start_pair`` of ``start_group``.

    ``groups`` is ``group_id, n_pairs, cum_pairs``. A chunk that would go past the last pair ends there.
    """
    first = groups.filter(F.col("group_id") == start_group).select((F.col("cum_pairs") - F.col("n_pairs") + start_pair + size).alias("_to"))
    total = groups.agg(F.max("cum_pairs").alias("_all"))
    limit = first.crossJoin(F.broadcast(total)).select(F.least("_to", "_all").alias("_cut"))  # one row each
    later = groups.filter(F.col("group_id") >= start_group).crossJoin(F.broadcast(limit)).filter("cum_pairs >= _cut")
    end = later.agg(F.min(F.struct("group_id", "n_pairs", "cum_pairs", "_cut")).alias("x"))
    return end.select(F.col("x.group_id").alias("group"), F.expr("x.n_pairs - (x.cum_pairs - x._cut)").alias("pair_count"))
