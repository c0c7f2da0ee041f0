"""Genotype files: a data source for ``.bed`` and readers for ``.bim``, ``.fam`` and allele counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..params import check_counts, check_individuals
from ..session import ship
from .files import place

#: The first bytes of a file, and counts of the minor allele by two-bit code; -9 is missing.
MAGIC = bytes((0x6C, 0x1B, 0x01))
COUNTS = np.array([0, -9, 1, 2], np.int32)
CODES = {0: 0, -9: 1, 1: 2, 2: 3}
#: Bytes of genotypes that one partition reads.
SPLIT = 32 << 20


def check_magic(head: bytes) -> None:
    for name, found, wanted in zip(("first", "second", "third"), head, MAGIC, strict=False):
        if found != wanted:
            raise ValueError(f"ERROR: {name} magic byte in input .bed file is {found:#04x}, not {wanted:#04x}")


def _open(path: str):
    where, inner = place(path)
    try:
        return where.open_input_file(inner)
    except OSError as e:
        raise ValueError(f"ERROR: failed to open file {path}") from e


class _Range(InputPartition):
    def __init__(self, first: int, n: int):
        self.first, self.n = first, n


class BedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.n = options["path"], int(options["individuals"])
        self.split = int(options.get("splitbytes", SPLIT))

    @property
    def width(self) -> int:
        return -(-self.n // 4)

    def partitions(self) -> list[InputPartition]:
        check_individuals(self.n)
        with _open(self.path) as f:
            check_magic(f.read(3))
            loci = max(0, f.size() - 3) // self.width
        if not loci:
            raise ValueError(f"ERROR: no genotype records in file {self.path}")
        step = max(1, self.split // self.width)
        return [_Range(a, min(step, loci - a)) for a in range(0, loci, step)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        step = max(1, (4 << 20) // self.width)
        with _open(self.path) as f:
            for first in range(partition.first, partition.first + partition.n, step):
                n = min(step, partition.first + partition.n - first)
                f.seek(3 + first * self.width)
                raw = np.frombuffer(f.read(n * self.width), np.uint8).reshape(n, self.width)
                codes = np.stack([raw >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(n, -1)[:, : self.n]
                flat = pa.array(COUNTS[codes].ravel())
                mac = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * self.n, self.n, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n, dtype=np.int64)), mac], ["locus", "mac"])


class BedSource(DataSource):
    """``spark.read.format("bed").option("individuals", n).load(path)``: ``locus bigint, mac array<int>``, one row a locus."""

    @classmethod
    def name(cls) -> str:
        return "bed"

    def schema(self) -> str:
        return "locus bigint, mac array<int>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return BedReader(self.options)


def read_bed(spark: SparkSession, path: str, n: int, split: int = SPLIT) -> DataFrame:
    """Genotypes of a file, read in ranges of loci; what is wrong with it is said before any task starts."""
    BedReader({"path": path, "individuals": n}).partitions()
    ship(spark)
    spark.dataSource.register(BedSource)
    return spark.read.format("bed").option("individuals", str(n)).option("splitbytes", str(split)).load(path)


def write_bed(geno: DataFrame, path: str) -> None:
    """One file of ``locus, mac`` in the order of loci: for fixtures and exchange, the rows pass the driver one by one."""
    where, inner = place(path)
    where.create_dir(inner.rpartition("/")[0], recursive=True)
    with where.open_output_stream(inner) as f:
        f.write(MAGIC)
        for row in geno.orderBy("locus").toLocalIterator():
            codes = np.array([CODES[-9 if m is None or m < 0 else m] for m in row.mac], np.uint8)
            quads = np.pad(codes, (0, -len(codes) % 4)).reshape(-1, 4)
            f.write((quads << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes())


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number from 0: numbered within the files' splits, which come in order, and then across them.

    The files of a folder follow each other by name.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    raw = spark.read.text(path).select("value", place.alias("at"), F.monotonically_increasing_id().alias("id"))
    sizes = raw.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    # one row for each split of the files
    before = F.coalesce(F.sum("n").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("at", "first", before.alias("before"))
    return raw.join(F.broadcast(starts), "at").select((F.col("before") + F.col("id") - F.col("first")).alias("idx"), "value")


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(spark, path).filter("trim(value) <> ''").select("idx", F.split(F.trim("value"), r"\s+").alias("f"))


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """``idx, chrom, name, cm, pos, allele1, allele2``; only idx and name must be there."""
    f = F.col("f")
    at = lambda k: F.get(f, F.lit(k))
    return _fields(spark, path).select(
        "idx", at(0).alias("chrom"), at(1).alias("name"), at(2).try_cast("double").alias("cm"), at(3).try_cast("bigint").alias("pos"), at(4).alias("allele1"), at(5).alias("allele2")
    )


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """``idx, family, individual, father, mother, sex, phenotype``."""
    names = ["family", "individual", "father", "mother"]
    at = lambda k: F.get("f", F.lit(k))
    return _fields(spark, path).select("idx", *[at(k).alias(n) for k, n in enumerate(names)], at(4).try_cast("int").alias("sex"), at(5).try_cast("int").alias("phenotype"))


def read_counts(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Allele counts, one a line, locus by locus: ``locus, ind, mac``."""
    lines = _fields(spark, path)
    check_counts(lines.count(), n)
    return lines.select(F.floor(F.col("idx") / n).cast("bigint").alias("locus"), F.pmod("idx", F.lit(n)).cast("int").alias("ind"), F.get("f", F.lit(0)).cast("int").alias("mac"))


def from_counts(spark: SparkSession, counts: list[int], n: int) -> DataFrame:
    """An in-memory vector, locus by locus, as ``locus, mac array``."""
    check_counts(len(counts), n)
    rows = [(k, counts[k * n : (k + 1) * n]) for k in range(len(counts) // n)]
    return spark.createDataFrame(rows, "locus bigint, mac array<int>")


def exploded(geno: DataFrame) -> DataFrame:
    """``locus, ind, mac`` of ``locus, mac array``; missing is -9."""
    return geno.select("locus", F.posexplode("mac").alias("ind", "mac")).select("locus", "ind", F.when(F.col("mac") >= 0, F.col("mac")).otherwise(-9).alias("mac"))
