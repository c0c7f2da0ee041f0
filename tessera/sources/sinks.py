"""Sinks: tab-separated pairs and groups, and raw bits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import partitions, ship
from .files import place


def write_tsv(df: DataFrame, path: str, single: bool = False, by: tuple[str, ...] = ()) -> None:
    """A folder of files with a header each, written in parallel; with ``single``, one file (for small results).

    With ``by``, rows are in this order, file by file.
    """
    if by:
        df = df.orderBy(*by)
    (df.coalesce(1) if single else df).write.mode("overwrite").option("sep", "\t").csv(path, header=True)


def bit_bytes(bits: DataFrame, n: int) -> DataFrame:
    """``locus, bytes``: ceil(n / 8) bytes a locus, the first individual in the lowest bit of the first byte."""
    octet = lambda b: F.aggregate(F.filter("inds", lambda i: F.shiftright(i, 3) == b), F.lit(0), lambda acc, i: acc + F.call_function("shiftleft", F.lit(1), i % 8))
    digits = F.transform(F.sequence(F.lit(0), F.lit(-(-n // 8) - 1)), lambda b: F.lpad(F.hex(octet(b)), 2, "0"))
    return bits.select("locus", F.unhex(F.array_join(digits, "")).alias("bytes"))


def _packed(lists: pa.ListArray, n: int) -> bytes:
    out = np.zeros((len(lists), -(-n // 8) * 8), np.uint8)
    out[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False)] = 1
    return np.packbits(out, axis=1, bitorder="little").tobytes()


@dataclass
class _Part(WriterCommitMessage):
    number: int
    file: str


class RawWriter(DataSourceArrowWriter):
    """Each task writes a file aside; the commit gives the files their names, so that retried tasks leave nothing behind."""

    def __init__(self, options: dict):
        self.path, self.n = options["path"].rstrip("/"), int(options["individuals"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, inner = place(self.path)
        number, file = TaskContext.get().partitionId(), f"{inner}/.tmp-{uuid.uuid4().hex}"
        where.create_dir(inner, recursive=True)
        with where.open_output_stream(file) as f:
            for batch in iterator:
                f.write(_packed(batch.column("inds"), self.n))
        return _Part(number, file)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, inner = place(self.path)
        for part in messages:
            where.move(part.file, f"{inner}/part-{part.number:06d}.bits")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for part in messages:
            if part is not None:
                place(self.path)[0].delete_file(part.file)


class RawSink(DataSource):
    """``df.write.format("rawbits").option("individuals", n).save(path)`` of ``locus, inds``."""

    @classmethod
    def name(cls) -> str:
        return "rawbits"

    def schema(self) -> str:
        return "locus bigint, inds array<int>"

    def writer(self, schema: StructType, overwrite: bool) -> RawWriter:
        return RawWriter(self.options)


def write_raw(bits: DataFrame, n: int, path: str, parts: int | None = None) -> None:
    """All loci's bits without a header, in the order of loci: a folder of files, written by the tasks that hold ranges of
    loci. The files one after the other, by name, are the loci's bits; with ``parts`` 1 there is one file."""
    spark = bits.sparkSession
    ship(spark)
    spark.dataSource.register(RawSink)
    rows = bits.select("locus", F.coalesce("inds", F.array().cast("array<int>")).alias("inds"))
    rows = rows.repartitionByRange(parts or partitions(spark), "locus").sortWithinPartitions("locus")
    rows.write.format("rawbits").option("individuals", str(n)).mode("append").save(path)
