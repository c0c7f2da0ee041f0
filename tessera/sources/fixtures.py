"""Genotype-like tables derived from the driver's tables, which hold no genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import h32

#: Individuals of ``geno`` and values of ``incidence``.
GENO_N, INCIDENCE_N = 64, 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``locus, mac array``: each vector's components as counts, one in fifty missing."""
    value = lambda x: F.when(x < 0.0, 0).when(x < 0.12, 1).otherwise(2)
    one = lambda x, i: F.when(h32("miss", F.col("vec_id"), i) % 50 == 0, -9).otherwise(value(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("locus"), F.transform("embedding", one).alias("mac"))


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``locus, inds``: the hashed distinct words of each document."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    hashed = F.transform(F.array_distinct(words), lambda w: (h32(w) % INCIDENCE_N).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("locus"), F.array_distinct(hashed).alias("inds"))


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``locus, ind, mac``: parts of each supplier, counted up to two; pairs that do not occur have count zero."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("locus"), F.col("l_partkey").alias("ind"))
    return items.agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("mac"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``idx, name`` of the loci of ``geno``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.concat(F.lit("L"), F.col("vec_id")).alias("name"))
