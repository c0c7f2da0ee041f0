"""Token counts as delta-maintained rollups.

A batch of changes (insert, delete, revise) is turned into signed deltas, against the ledger of what each document
counts, which are summed by source, language and tokenizer version and committed under the batch's id. Totals are sums
over the committed deltas, so they are additive and no batch rewrites another. A batch id that is there already is
skipped: a batch that is delivered again, or retried after a crash, changes nothing. Of two writers that want the same
number one takes it; the other computes its deltas anew on what is there then. Parts of the ledger and of the deltas are
merged by tiers, so that a batch meets a number of parts that grows with the logarithm of all batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove
from . import packing
from .commits import Commits, full_tier
from .common import prepare, shared_dir, table
from .encoding import vocabulary

KEYS = ["source", "lang", "tokenizer"]
#: Bytes of a part of the lowest tier, about.
SMALL = 8 << 20
_ENTRY = ["doc_id", "tokenizer"]
_LEDGER = "doc_id long, tokenizer string, source string, lang string, n_docs long, n_tokens long, replaces boolean"
_DELTAS = "source string, lang string, tokenizer string, d_docs long, d_tokens long"


def counts(docs: DataFrame, path: str, version: str) -> DataFrame:
    """``doc_id, source, lang, tokenizer, n_tokens`` of every whole text; null counts as empty."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(packing.token_ids(t or "", path)) for t in batch.column("text").to_pylist()]
            own = [batch.column(c) for c in ("doc_id", "source", "lang")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def _joined(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with one row for each id and version; a null id is an id like others. Null versions do not occur."""
    named = keys.withColumnsRenamed({"doc_id": "_doc_id", "tokenizer": "_tokenizer"}).hint("merge")
    found = rows.join(named, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("tokenizer") == F.col("_tokenizer")), how)
    return found if how == "left_semi" else found.drop("_doc_id", "_tokenizer")


class Rollup:
    """Totals under ``root`` in a shared file system; opened again, they go on where they ended."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = Commits(spark, f"{self.root}/commits")

    def batches(self) -> list[str]:
        """Ids of the committed batches, in the order of their commits."""
        return [c["batch"] for c in self.commits.all() if c["batch"] is not None]

    # -- parts: folders with the number of the last commit that is in them ---------------------------------------

    def _write(self, rows: DataFrame) -> dict:
        path = f"{self.root}/parts/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return {"path": path, "bytes": where.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()}

    def _read(self, parts: list[dict], schema: str) -> DataFrame:
        read = [self.spark.read.schema(schema).parquet(p["path"]).withColumn("number", F.lit(p["number"]).cast("long")) for p in parts]
        return reduce(DataFrame.union, read) if read else self.spark.createDataFrame([], f"{schema}, number long")

    @staticmethod
    def _state(rows: DataFrame) -> DataFrame:
        """``doc_id, tokenizer, source, lang, n_docs, n_tokens, replaces``: what is left of entries once later parts have replaced earlier ones."""
        last = rows.filter("replaces").groupBy(*_ENTRY).agg(F.max("number").alias("last"))
        own = _joined(rows, last, "left").filter("last IS NULL OR number >= last")
        return own.groupBy(*_ENTRY, "source", "lang").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("replaces").alias("replaces"))

    def ledger(self) -> DataFrame:
        """``doc_id, tokenizer, source, lang, n_docs, n_tokens`` of all that counts now; ids that repeat have their sums."""
        state = self._state(self._read(self.commits.latest()[1].get("ledger", []), _LEDGER))
        return state.filter("n_docs <> 0").drop("replaces")

    @staticmethod
    def _entries(changes: DataFrame) -> DataFrame:
        """What a batch says of each document: its rows by source and language, and whether they replace what was before."""
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        docs = F.col("n_docs").cast("long") if "n_docs" in changes.columns else F.lit(1).cast("long")
        rows = changes.filter("tokenizer IS NOT NULL AND (op = 'delete' OR op IN ('insert', 'revise') AND n_tokens IS NOT NULL)")
        rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer", "source", "lang", "op", seq.alias("seq"), docs.alias("n"), F.col("n_tokens").cast("long").alias("n_tokens"))
        # summed where the rows lie: an id that very many rows share is one row a task from here on
        rows = rows.groupBy(*_ENTRY, "source", "lang", "op", "seq").agg(F.sum("n").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        last = rows.filter("op <> 'insert'").groupBy(*_ENTRY).agg(F.max("seq").alias("last"))
        own = _joined(rows, last, "left").filter("last IS NULL OR op = 'insert' AND seq >= last OR op = 'revise' AND seq = last")
        own = own.select(*_ENTRY, "source", "lang", "n_docs", "n_tokens", F.col("last").isNotNull().alias("replaces"))
        nothing = F.lit(None).cast("string")
        marks = last.select(*_ENTRY, nothing.alias("source"), nothing.alias("lang"), F.lit(0).cast("long").alias("n_docs"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("replaces"))
        both = own.union(marks).groupBy(*_ENTRY, "source", "lang")
        return both.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("replaces").alias("replaces"))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit ``changes``: ``doc_id, tokenizer, source, lang, n_tokens, op``; False if the batch was there already.

        Each insert adds its row, also for an id that has rows (repeated rows count each). A delete takes away all rows of
        an id and version, a revise puts its own rows in their place. Within a batch the last delete or revise by ``seq``
        (0 without such a column) decides: earlier rows of the id do not count, inserts of the same or a later ``seq`` do;
        of equal ones a revise comes after a delete. A column ``n_docs`` tells for how many documents a row stands (else
        one). A null doc_id is an id like others, a null source or language a key of its own. Rows with a null tokenizer,
        another op, or a null n_tokens (unless a delete) do not count. An empty batch is committed and changes nothing.
        """
        if batch in self.batches():
            return False
        own = self._write(self._entries(changes))
        new = self._read([own | {"number": 0}], _LEDGER)
        plus = new.select(*KEYS, F.col("n_docs").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))
        replaced = new.filter("replaces").select(*_ENTRY).distinct()
        while True:
            number, at = self.commits.latest()
            if batch in self.batches():
                remove(self.spark, own["path"])
                return False
            deltas = plus
            if parts := at.get("ledger"):
                old = self._read(parts, _LEDGER)
                old = self._state(_joined(old, replaced, "left_semi"))
                deltas = plus.union(old.select(*KEYS, (-F.col("n_docs")).alias("d_docs"), (-F.col("n_tokens")).alias("d_tokens")))
            summed = self._write(self._summed(deltas))
            one = {"number": number + 1}
            if self.commits.commit(number + 1, {"batch": batch, "ledger": [*at.get("ledger", []), own | one], "deltas": [*at.get("deltas", []), summed | one]}):
                return True
            remove(self.spark, summed["path"])  # another batch came between

    @staticmethod
    def _summed(deltas: DataFrame) -> DataFrame:
        return deltas.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).filter("d_docs <> 0 OR d_tokens <> 0")

    def compact(self) -> None:
        """Merge parts of one tier until no tier has ``FAN``; totals and ledger stay as they are. Another writer's commit goes first."""
        for kind, schema in (("ledger", _LEDGER), ("deltas", _DELTAS)):
            while True:
                number, at = self.commits.latest()
                parts = at.get(kind, [])
                some = full_tier(parts, lambda p: p["bytes"], SMALL)
                if not some:
                    break
                # the ledger's parts replace each other in their order: a merged part takes in those between as well
                span = [p for p in parts if min(x["number"] for x in some) <= p["number"] <= max(x["number"] for x in some)]
                rows = self._read(span, schema)
                merged = self._write(self._state(rows) if kind == "ledger" else self._summed(rows))
                left = [p for p in parts if p not in span] + [merged | {"number": max(p["number"] for p in span)}]
                if not self.commits.commit(number + 1, at | {"batch": None, kind: sorted(left, key=lambda p: p["number"])}):
                    remove(self.spark, merged["path"])

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens``; combinations that all batches together leave empty are not listed."""
        summed = self._summed(self._read(self.commits.latest()[1].get("deltas", []), _DELTAS))
        return summed.select(*KEYS, F.col("d_docs").alias("n_docs"), F.col("d_tokens").alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, lang, tokenizer, n_docs, n_tokens`` over all rows of ``documents``, the end id of each counted as well.

    The totals of six batches: all documents under version 1 of the tokenizer without the end id; the same again, which
    is skipped; a revision that counts the end ids; a deletion of documents that have no other id; and these once more.
    Null texts count as empty, whole texts of any length are counted, repeated rows and ids (null ones too) count each,
    null sources and languages are keys of their own; an empty table has no totals; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    first = counts(docs, vocabulary(), "byte_bpe_50k/1").withColumn("op", F.lit("insert"))
    rollup.apply("documents", first)
    rollup.apply("documents", first)
    rollup.apply("with-end", rollup.ledger().withColumns({"n_tokens": F.col("n_tokens") + F.col("n_docs"), "op": F.lit("revise")}))
    now = rollup.ledger()  # of this moment: later commits add files, they change none
    ids = now.filter("n_tokens = n_docs").select(*_ENTRY).distinct()
    blank = _joined(now, ids, "left_semi")
    rollup.apply("blank-out", blank.withColumn("op", F.lit("delete")))
    rollup.apply("blank-in", blank.withColumn("op", F.lit("insert")))
    rollup.compact()
    return rollup.totals()
