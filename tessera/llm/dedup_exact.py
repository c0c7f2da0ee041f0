"""Exact dedup against a persistent digest index.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one space. The index is a family of
tables ``digest, keep_id``, bucketed and sorted by digest, and of counts by digest. A batch is reduced to one row a digest
first (a group of copies is summed where its rows lie), then its new digests are found by a sort-merge anti-join on each
level of the index and appended. Levels of one size are merged, so that their number grows with the logarithm of the
batches. No Python runs on the executors.
"""

from __future__ import annotations

import atexit
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, temporary, writer
from .commits import Commits, full_tier
from .common import drop, partitions, shared_dir, stored, table, texts

#: The white space that counts.
SPACE = r"[\x20\x09-\x0D]+"


def digests(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id, digest`` (binary SHA-256 of the normalised whole text in UTF-8; null counts as empty)."""
    normal = F.regexp_replace("text", SPACE, " ")
    return texts(docs, *keep).select("doc_id", F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"), *keep)


#: Bytes of a level of the lowest tier, about, and of a bucket of the higher ones.
SMALL = 8 << 20
BUCKET = 256 << 20


class DigestIndex:
    """Digests seen so far, under ``root`` in a shared file system: opened again, it goes on where it ended.

    Batches come in any number and size. The row that stays of a group is the smallest doc_id of the first batch that
    held the digest; within one batch, ties and repeated rows fall to the smallest doc_id. Null ids sort last. A batch is
    one commit (see ``commits``): of two writers, the slower looks its digests up again in what the other has brought.
    Without ``root`` the index ends with the session.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None, small: int = SMALL):
        self.spark, self.buckets, self.small = spark, buckets or partitions(spark), small
        self.root = (root or f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}").rstrip("/")
        if root is None:
            temporary(spark, self.root)
        self.commits = Commits(spark, f"{self.root}/commits")
        self._tables: dict[str, str] = {}

    def levels(self) -> list[dict]:
        """``new`` (folder of a bucketed table), its number of buckets, ``counts`` (folders) and bytes of each level."""
        return self.commits.latest()[1].get("levels", [])

    def part(self, level: dict) -> DataFrame:
        """``digest, keep_id`` of the digests that a level brought, as the bucketed and sorted table that it is."""
        if level["new"] not in self._tables:
            table = self._tables[level["new"]] = f"digest_index_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {table} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                f"INTO {level['buckets']} BUCKETS LOCATION '{level['new']}'"
            )
            atexit.register(drop, self.spark, table)
        return self.spark.table(self._tables[level["new"]])

    def parts(self) -> list[DataFrame]:
        return [self.part(level) for level in self.levels()]

    def _bucketed(self, rows: DataFrame, buckets: int) -> dict:
        """Write ``digest, keep_id``: dealt by digest first, so that each bucket is one file."""
        path, table = f"{self.root}/levels/{uuid.uuid4().hex}", f"digest_batch_{uuid.uuid4().hex}"
        writer(rows.repartition(buckets, "digest")).option("path", path).bucketBy(buckets, "digest").sortBy("digest").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return {"new": path, "buckets": buckets, "bytes": where.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()}

    def _counted(self, counts: DataFrame) -> str:
        path = f"{self.root}/counts/{uuid.uuid4().hex}"
        writer(counts).parquet(path)
        return path

    def add(self, digested: DataFrame) -> None:
        """Take the batch ``doc_id, digest``: append unseen digests, count all of them."""
        counts = self._counted(digested.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
        while True:
            number, at = self.commits.latest()
            levels = at.get("levels", [])
            new = self._counts(counts).select("digest", "keep_id")
            for level in levels:
                new = new.join(self.part(level).hint("merge"), "digest", "left_anti")
            made = self._bucketed(new, self.buckets) | {"counts": [counts]}
            if self.commits.commit(number + 1, {"levels": [*levels, made]}):
                break
            remove(self.spark, made["new"])  # another batch was committed meanwhile
        self.compact()

    def compact(self) -> None:
        """Merge levels of one size; the index says the same before and after."""
        while True:
            number, at = self.commits.latest()
            some = full_tier(at["levels"], lambda x: x["bytes"], self.small)
            if not some:
                return
            rows = reduce(DataFrame.union, [self.spark.read.schema("digest binary, keep_id long").parquet(x["new"]) for x in some])
            made = self._bucketed(rows, max(self.buckets, -(-sum(x["bytes"] for x in some) // BUCKET)))
            counts = self._counts(*(c for x in some for c in x["counts"])).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
            made |= {"counts": [self._counted(counts)]}
            if not self.commits.commit(number + 1, {"levels": [*(x for x in at["levels"] if x not in some), made]}):
                for path in (made["new"], *made["counts"]):
                    remove(self.spark, path)

    def _counts(self, *paths: str) -> DataFrame:
        return self.spark.read.schema("digest binary, keep_id long, n long").parquet(*paths)

    def entries(self) -> DataFrame:
        """``digest, keep_id, group_size`` of all digests: one row each."""
        levels = self.levels()
        kept = reduce(DataFrame.union, map(self.part, levels))
        paths = [c for x in levels for c in x["counts"]]
        counts = self._counts(*paths)
        if len(paths) > 1:
            counts = counts.groupBy("digest").agg(F.sum("n").alias("n"))
        return kept.join(counts.select("digest", F.col("n").alias("group_size")), "digest")


def resolve(digested: DataFrame, index: DigestIndex) -> DataFrame:
    """``digested`` with keep_id and group_size.

    A digest that occurs once needs no partner, so only groups of two and more are looked up; the rows of a large
    group spread over tasks because both sides are dealt by an exchange that AQE may split.
    """
    groups = stored(index.entries().filter("group_size > 1"), "groups")
    found = digested.join(groups.hint("merge"), "digest", "left")
    return found.withColumns({"keep_id": F.coalesce("keep_id", "doc_id"), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``documents``, added to the index in two batches.

    Null texts count as empty; empty texts are copies of each other. Of repeated rows each is returned, and each with the
    smallest id is kept. Rows with a null id are never kept; keep_id is null if no row of the group has an id. An empty
    table gives no rows; other columns are not read.
    """
    digested = stored(digests(table(spark, sf_dir, "documents")), "digested")
    index = DigestIndex(spark)
    middle = digested.agg((F.min("doc_id") / 2 + F.max("doc_id") / 2).cast("long")).first()[0] or 0
    index.add(digested.filter(F.col("doc_id") <= middle))
    index.add(digested.filter(~F.coalesce(F.col("doc_id") <= middle, F.lit(False))))
    return resolve(digested, index).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay: of equal texts the row with the smallest doc_id, any one of them if that id repeats.

    Rows with a null id stay only if no other row has the text. All columns are returned unchanged, whatever their names.
    """
    index = DigestIndex(docs.sparkSession)
    mark, own = (f"_{uuid.uuid4().hex}" for _ in "12")
    last = F.lit((1 << 63) - 1)
    index.add(digests(docs).withColumn("doc_id", F.coalesce("doc_id", last)))
    kept = index.entries().select(F.col("digest").alias(mark + "k"), F.col("keep_id").alias(own + "k"))
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")
    here = docs.withColumns({mark: F.unhex(F.sha2(normal.cast("binary"), 256)), own: F.coalesce("doc_id", last)})
    # a digest and its smallest id name one row, so no key of this join gathers many rows
    stays = here.join(kept.hint("merge"), (here[mark] == kept[mark + "k"]) & (here[own] == kept[own + "k"]), "left_semi")
    return stays.dropDuplicates([mark, own]).drop(mark, own)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
