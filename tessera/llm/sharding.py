"""Sharding by size-tiered compaction.

An arrival becomes a run of small immutable shards. Runs whose sizes fall into one tier (a power of ``FAN``) are merged
once there are ``FAN`` of them, into files of about the target size. What is valid is named by the manifest of the
highest version. A version is committed by giving a finished file a name that must not exist yet (see ``commits``), so
that readers see one version or the next, of two writers the slower goes on from the other's version, and a crash leaves
stray files only. No Python runs on the executors.

Rows are kept as they are: nulls in any column, empty and very long texts, repeated rows and ids, extra columns. An empty
arrival is a run without rows. A run that is one very long text is one shard, however small the target.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import remove
from .commits import FAN, Commits, full_tier
from .common import shared_dir, table

SMALL = 8 << 20
TARGET = 128 << 20


def _kinds(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema]


class Shards:
    """A sharded table under ``root`` in a shared file system, for any number of readers and writers."""

    def __init__(self, spark: SparkSession, root: str, small: int = SMALL, target: int = TARGET):
        self.spark, self.root, self.small, self.target = spark, root.rstrip("/"), small, target
        self.commits = Commits(spark, f"{self.root}/manifests")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        return self.commits.numbers()

    def manifest(self, version: int | None = None) -> dict:
        version = version if version is not None else max(self.versions(), default=0)
        return self.commits.read(version) if version else {"version": 0, "schema": None, "runs": []}

    def _commit(self, old: dict, schema: str, runs: list[dict]) -> bool:
        return self.commits.commit(old["version"] + 1, {"version": old["version"] + 1, "schema": schema, "runs": runs})

    # -- runs ---------------------------------------------------------------------------------------------------

    def _size(self, run: str) -> int:
        return self._fs.getContentSummary(self._path(f"{self.root}/runs/{run}")).getLength()

    def _write(self, rows: DataFrame, files: int | None) -> dict:
        run = uuid.uuid4().hex
        rows = rows if files is None else rows.coalesce(files)
        rows.write.option("compression", "zstd").parquet(f"{self.root}/runs/{run}")
        return {"run": run, "bytes": self._size(run)}

    def _read(self, runs: list[dict], schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        paths = [f"{self.root}/runs/{r['run']}" for r in runs]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def append(self, rows: DataFrame) -> dict:
        """One arrival: as many shards as the tasks that bring it, none read again; gives the new manifest.

        All rows stay, repeated ones too. An arrival whose columns differ in name, order or type from the table's is refused.
        """
        run = None
        while True:
            old = self.manifest()
            schema = old["schema"] or rows.schema.json()
            if _kinds(rows.schema) != (wanted := _kinds(StructType.fromJson(json.loads(schema)))):
                if run:
                    remove(self.spark, f"{self.root}/runs/{run['run']}")
                raise ValueError(f"an arrival must have the table's columns {wanted}")
            run = run or self._write(rows, None)
            if self._commit(old, schema, [*old["runs"], run]):
                return self.manifest(old["version"] + 1)

    def compact(self) -> dict:
        """Merge tiers of ``FAN`` runs and more until no tier has that many; each merge is a version of its own."""
        while True:
            old = self.manifest()
            full = full_tier(old["runs"], lambda r: r["bytes"], self.small)
            if not full:
                return old
            files = -(-sum(r["bytes"] for r in full) // self.target)
            merged, gone = self._write(self._read(full, old["schema"]), max(1, files)), {r["run"] for r in full}
            while not self._commit(old, old["schema"], [*(r for r in old["runs"] if r["run"] not in gone), merged]):
                old = self.manifest()
                if not gone <= {r["run"] for r in old["runs"]}:  # another writer has merged some of them
                    remove(self.spark, f"{self.root}/runs/{merged['run']}")
                    break

    def vacuum(self) -> None:
        """Delete runs that the latest version does not name; for when no reader uses an older one and no writer is at work."""
        valid = {r["run"] for r in self.manifest()["runs"]}
        for s in self._fs.listStatus(self._path(f"{self.root}/runs")):
            if s.getPath().getName() not in valid:
                self._fs.delete(s.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is named."""
        at = self.manifest(version)
        if not at["schema"]:
            raise ValueError("nothing was appended yet")
        return self._read(at["runs"], at["schema"])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_bytes, text_sha256`` of all rows that the committed version holds after four arrivals by
    ranges of doc_id (null ids in the first) and compaction. Each arrival reads its range of the table, null texts count
    as empty here, repeated rows stay, an empty table gives no rows, other columns are kept in the shards."""
    docs = table(spark, sf_dir, "documents")
    ends = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = ends[0] or 0, ends[1] or 0
    cuts = [low + (high - low + 1) * k // FAN for k in range(1, FAN)]
    shards = Shards(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    for k in range(FAN):
        part = F.lit(True)
        if k:
            part = part & (F.col("doc_id") >= cuts[k - 1])
        if k < FAN - 1:
            part = part & (F.col("doc_id") < cuts[k])
        shards.append(docs.filter(part if k else F.col("doc_id").isNull() | part))
    shards.compact()
    shards.vacuum()
    text = F.coalesce("text", F.lit(""))
    return shards.read().select("doc_id", "lang", "source", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


ORACLE = """
SELECT doc_id, lang, source, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
