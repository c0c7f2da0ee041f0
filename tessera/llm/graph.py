"""Connected components by alternating large and small stars, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import files_for, stored


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Of every node u: its larger (or all smaller) neighbours are tied to the smallest of u and its neighbours."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = both.join(least, "u")
    if large:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.filter("v < u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(pairs: DataFrame, files: int | None = None) -> DataFrame:
    """``node, component_id`` (the smallest node reachable) of nodes in ``pairs`` ``u, v`` (longs, any direction).

    Self-links and repeated pairs do not matter; an empty table gives none. Each round is written to the shared folder;
    the driver sees two numbers a round. Rounds end when a round changes nothing, in about the logarithm of the longest
    path. The first round has ``files`` at most, later ones as many as the pairs of the one before ask for.
    """
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    pairs = stored(pairs, "links", files=files)
    mark = None
    while True:
        pairs = stored(_star(_star(pairs, large=True), large=False), "links", files=files)
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark, files = now, files_for(pairs.sparkSession, now[0])
    flat = pairs.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    return flat.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
