"""What operators need of a Spark session: the package on executors, and written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where none is named, one in the warehouse.

    A warehouse on a machine's own disk is refused on a cluster: other machines would not see what is written there.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    where = warehouse if ":" in warehouse else spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")
    if where.startswith("file:") and spark.conf.get("spark.master", "local").partition("[")[0] != "local":
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{warehouse}/_shared"


def ship(spark: SparkSession) -> None:
    """Give executors this package, once a session: operators with Python kernels call it."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / "tessera.zip"  # read by the driver's file server alone
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._tessera_shipped = True


def remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended: its shared folder is the cluster's to clear
        pass


#: What ``stored`` has written and nothing has removed yet.
_written: list[str] = []


def temporary(spark: SparkSession, path: str) -> str:
    """Note a folder that is to go with the session, or before if ``clean`` or ``remove`` is called."""
    if not _written:
        atexit.register(clean, spark)
    _written.append(path)
    return path


def written() -> list[str]:
    """What is there of ``stored`` tables and other temporary folders."""
    return list(_written)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Remove temporary folders that nothing reads any more."""
    for path in paths:
        if path in _written:
            _written.remove(path)
            remove(spark, path)


def clean(spark: SparkSession) -> None:
    """Remove all that ``stored`` has written, for long sessions; results that still read it must be written out before."""
    while _written:
        remove(spark, _written.pop())


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile leaves no shuffle files behind, where Spark can remove them at the end of a query."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def writer(df: DataFrame) -> DataFrameWriter:
    """For Parquet files of our own: on a local disk they have no files of checksums beside them.

    Hadoop starts a ``chmod`` for each file on a local disk; while it starts, it shares the executor's memory, which then
    counts twice. Parquet has checksums of its own in each page. Other stores do not look at these options, and a class that
    the user has named for local disks stays.
    """
    out = df.write.option("compression", "zstd")
    if df.sparkSession._jsparkSession.sessionState().newHadoopConf().get("fs.file.impl"):
        return out
    return out.option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem").option("fs.file.impl.disable.cache", "true")


#: Short rows that a task writes before another one is worth its file.
FILE_ROWS = 1 << 14


def files_for(spark: SparkSession, rows: int) -> int | None:
    """Files of a table of about ``rows`` short rows; None if they are as many as the shuffle partitions anyway."""
    files = max(1, -(-rows // FILE_ROWS))
    return files if files < partitions(spark) else None


def stored(df: DataFrame, name: str, *parts: str, files: int | None = None, dealt: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that survive executors.

    Columns ``parts`` become folders, so that a filter on them reads no others. At most ``files`` tasks write, if that is
    given: those of the last stage are made fewer, or, if they have much to do, their rows are ``dealt`` to as many.
    """
    spark = df.sparkSession
    if files:
        df = df.repartition(files) if dealt else df.coalesce(files)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        writer(df).partitionBy(*parts).parquet(path)
    temporary(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
