"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ``K`` smallest distinct 48-bit hashes of a text's five-word shingles (fewer words: the whole sequence;
no words: none). The sketch of a union is the K smallest of both sketches, so sketches merge across parts. Of two
sketches, the K smallest of the union are a random sample of it: the share that is in both estimates resemblance.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, prepare, table, texts

K = 128
WORDS = 5
SPACE = 1 << 48
_MEMO = 400_000
_ROLES = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64)) for k in range(64)]


class _Hashes(dict):
    """Hashes of words seen before; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 42)
        return out


_words = _Hashes()


def sketch(text: str, k: int = K, words: int = WORDS) -> np.ndarray:
    """The sorted sketch of a whole text; words are runs of what is not white space, as they stand."""
    found = text.split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    span = min(words, len(h))
    out = np.zeros(len(h) - span + 1, np.uint64)
    for i in range(span):
        out += h[i : i + len(out)] * _ROLES[i]
    out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ out >> np.uint64(32)) >> np.uint64(16)
    if len(out) > 4 * k:  # repeats are few: this many smallest hold k distinct ones, or else all are taken
        least = np.unique(np.partition(out, 2 * k)[: 2 * k])
        if len(least) > k:
            return least[:k]
    return np.unique(out)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the two texts' shingles together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two empty sketches are alike."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact for sketches that are not full."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) + 1) * SPACE


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first one's shingles that the second one has; an empty first one is contained."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def pack(a: np.ndarray) -> str:
    """Six big-endian bytes a hash, in base64."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").reshape(-1).astype(np.uint64)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, n_shingles`` (estimated) of every whole text; null counts as empty, rows are not merged."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t) for t in batch.column("text").to_pylist()]
            own = [batch.column("doc_id"), pa.array(map(pack, found), pa.string()), pa.array(map(distinct, found), pa.float64())]
            yield pa.RecordBatch.from_arrays(own, ["doc_id", "fingerprint", "n_shingles"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def merged(sketched: DataFrame, *keys: str) -> DataFrame:
    """Sketches of groups of documents, ``fingerprint`` by ``keys``: merged in salted parts first, then over the parts."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sketched.select(*keys).schema) + ", fingerprint string"

    def fold(keyed: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.empty(0, np.uint64)
        for batch in rows:
            for s in batch.column("fingerprint").to_pylist():
                out = merge(out, unpack(s))
        yield pa.RecordBatch.from_arrays([*(pa.array([v.as_py()], v.type) for v in keyed[: len(keys)]), pa.array([pack(out)])], [*keys, "fingerprint"])

    def step(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).applyInArrow(lambda key, t: pa.Table.from_batches(fold(key, iter(t.to_batches()))), kind)

    prepare(sketched.sparkSession)
    n = partitions(sketched.sparkSession)
    salted = sketched.select(*keys, "fingerprint", F.pmod(F.xxhash64("doc_id"), F.lit(16 * n)).alias("_salt"))
    return step(step(salted, *keys, "_salt"), *keys)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edits by the next document (see the query's contract).

    The next document is the one with the next smaller doc_id, for the smallest the largest; rows of one doc_id follow
    each other in the order of their texts' hashes; null ids are the smallest. A single row is its own next.

    Documents are dealt once, by ranges of doc_id (of an id that very many rows share, or of null, by ranges of its texts'
    hashes within it); each range is read in order, and the first row of the range that
    follows is dealt to it as well. The driver sees the ranges' bounds only.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = 4 * partitions(spark)
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = texts(docs).withColumn("key", F.coalesce("doc_id", lowest))
    found = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 100 * n)).first()[0] or []
    bounds, shares = sorted(set(found)), Counter(found)
    rows = rows.withColumn("tie", F.xxhash64("text"))
    if bounds:  # a binary search; doubles keep the order of keys, and equal keys fall into one range
        splits = [-math.inf, *sorted(set(map(float, bounds))), math.inf]
        rows = Bucketizer(splits=splits, inputCol="at", outputCol="part").transform(rows.withColumn("at", F.col("key").cast("double"))).drop("at")
    else:
        rows = rows.withColumn("part", F.lit(0))
    # an id that fills several ranges, which all begin with it, is dealt out by ranges of its texts' hashes
    inner = F.lit(n)
    for key, share in shares.items():
        if share > 1:
            at = F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * share)
            inner = F.when(F.col("key") == key, F.least(at, F.lit(share - 1))).otherwise(inner)
    rows = rows.withColumn("part", F.col("part").cast("long") * (n + 1) + inner)
    tops = rows.groupBy("part").agg(F.max(F.struct("key", "tie")).alias("top")).orderBy("part").collect()
    follows = {t.part: tops[k - 1].top for k, t in enumerate(tops)}  # the range below; below the lowest, the highest
    also = [(part, top.key, top.tie) for part, top in follows.items()]
    guests = spark.createDataFrame(also, "guest long, key long, tie long")
    lent = rows.drop("part").join(F.broadcast(guests), ["key", "tie"])  # at most 4 * partitions rows
    lent = lent.dropDuplicates(["guest"]).select("doc_id", "text", "key", F.col("guest").alias("part"), "tie", F.lit(1).alias("lent"))
    dealt = rows.select("doc_id", "text", "key", "part", "tie", F.lit(0).alias("lent")).union(lent)
    dealt = dealt.repartition(partitions(spark), "part").sortWithinPartitions("part", "lent", F.desc("key"), F.desc("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # doc_id, text and sketch of the row before
        part = None
        for batch in batches:
            out = []
            for doc, text, of, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "lent")), strict=True):
                own = sketch(text)
                if held is not None and of == part:
                    before, whole, first = held
                    half = len(whole) // 2
                    edited = whole[: len(whole) - half] + text[:half]
                    changed = sketch(edited)
                    print_ = pack(first)
                    out.append(
                        (before, len(whole), hashlib.sha256(edited.encode()).hexdigest(), print_, pack(changed), resemblance(first, changed), resemblance(first, own))
                    )
                held, part = None if guest else (doc, text, own), of
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _OUT.split(", ")])

    return dealt.select("doc_id", "text", "part", "lent").mapInArrow(run, _OUT)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every row of ``documents`` and of its edited text; see ``with_edits``.

    Null texts count as empty, whole texts of any length are read, repeated rows and ids are returned each, an empty table
    gives no rows, other columns are not read.
    """
    return with_edits(table(spark, sf_dir, "documents"))


__all__ = ["containment", "distinct", "merge", "merged", "op5_fingerprints", "resemblance", "sketch", "sketches", "with_edits"]
