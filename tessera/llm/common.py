"""What the text operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cleaned, files_for, partitions, shared_dir, ship, stored

__all__ = ["cleaned", "drop", "files_for", "partitions", "prepare", "row_hashes", "shared_dir", "stored", "table", "texts", "tidy"]

#: Rows per Arrow batch handed to a Python worker; long texts make large rows.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """For operators that run Python: executors get this package, and Arrow batches of whole texts a bound.

    The bound holds unless the user has set one.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(ARROW_ROWS))
    ship(spark)


def tidy() -> None:
    """Give memory that a Python worker has freed back to the machine, where the C library can: workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def drop(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # noqa: BLE001  the session has ended
        pass


def row_hashes(*columns: str) -> list[Column]:
    """Two independent hashes of 64 bits of the columns' values; a null is another value than an empty text."""
    values = [x for c in columns for x in (F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))]
    return [F.xxhash64(F.lit(k), *values) for k in (1, 2)]


def texts(df: DataFrame, *keep: str) -> DataFrame:
    """``doc_id`` and whole ``text`` (null counts as empty), other columns left out."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
