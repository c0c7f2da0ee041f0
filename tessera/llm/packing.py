"""Best-fit packing by minimum bin slack.

Only the *numbers* of pieces of each length matter to the packer, at most ``capacity`` of them whatever the size of the
corpus. The driver takes this histogram and fills bin after bin: the longest piece left goes in, and a subset-sum
dynamic programme over bitsets finds the fullest feasible combination with what is left. The same combination is taken
as often as the counts allow, so that each step uses up a length and the plan stays short. Pieces then find their
place in the plan by their rank among pieces of their length; ranks are counted within salted parts, so a length that
a third of all pieces share is spread over tasks.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .common import files_for, partitions, prepare, stored, table, texts, tidy
from .encoding import vocabulary

CAPACITY = 2048
#: The id behind every document.
END = 0


@functools.lru_cache(maxsize=2)
def _ranked(path: str):
    """An encoder of the same merges that is quick for whole texts (checked against the tokenizers library in tests)."""
    import tiktoken

    coder = bpe.coder(path)
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=coder.ids, special_tokens={})


def token_ids(text: str, path: str) -> np.ndarray:
    coder = bpe.coder(path)
    if any(s in text for s in coder.special) or not text.isascii() and any(map(bpe._unassigned, set(text))):
        return np.frombuffer(coder.encode_all(text), "<u4")
    return np.array(_ranked(path).encode_ordinary(text), "<u4")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the end id, cut where longer than ``capacity``.

    The first piece takes what the others, all of full length, leave. A null or empty text is the end id alone; repeated
    rows are packed each.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(token_ids(text, path), END).astype("<u4")
                start, end = 0, (len(ids) - 1) % capacity + 1
                for k in range(-(-len(ids) // capacity)):
                    out.append((doc, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end = end, end + capacity
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        tidy()

    return texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths, with at most ``counts`` of each, whose sum is the largest up to ``room``; longest first.

    Bit ``s`` of ``reach`` tells that the sum ``s`` is feasible. A length that may be taken n times enters as 1, 2, 4 ...
    and the rest of them, so that every number up to n is a sum of them. Stops once ``room`` itself is feasible.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:
            take = min(size, left)
            steps.append((reach, length, take))
            reach |= reach << length * take & mask
            left, size = left - take, size * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            out += [length] * take
            total -= length * take
    return sorted(out, reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows ``length, rank from, rank to, first sequence, how many in a sequence, offset``, and the number of sequences."""
    left, used, rows, sequences = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = [longest, *fullest(left, capacity - longest)]
        left[longest] += 1
        own = {x: chosen.count(x) for x in chosen}
        times = min(left[x] // n for x, n in own.items())
        offset = 0
        for x, n in own.items():
            rows.append((x, used[x], used[x] + n * times, sequences, n, offset))
            used[x] += n * times
            left[x] -= n * times
            offset += n * x
            if not left[x]:
                del left[x]
        sequences += times
    return np.array(sorted(rows), dtype="i8").reshape(-1, 6), sequences


def pack(cut: DataFrame, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """``cut`` (as ``pieces`` gives it) with ``sequence_id`` and ``offset``.

    Ties in length go by salt, doc_id and piece. An empty table gives no rows.
    """
    spark = cut.sparkSession
    prepare(spark)
    salts = salts or 4 * partitions(spark)
    cut = cut.select("doc_id", "piece", "start", "length", "ids_crc32")
    cut = stored(cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts))), "pieces")
    parts = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    parts = stored(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts", files=files_for(spark, cut.count()))
    # at most `capacity` rows
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(counts, capacity)
    here = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(here)).join(parts.select("length", "salt", "before").hint("merge"), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("before"))
    span = max([1, *counts.values()]) + 1
    keys = rows[:, 0] * span + rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            _, lo, _, first, many, offset = rows[np.searchsorted(keys, length * span + rank, side="right") - 1].T
            slot = rank - lo
            own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            own += [pa.array(first + slot // many), pa.array(offset + slot % many * length)]
            yield pa.RecordBatch.from_arrays(own, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every row of ``documents`` and their places in sequences of ``CAPACITY`` tokens; see ``pieces`` and ``pack``.

    Null and empty texts are the end id alone, whole texts of any length are cut, repeated rows and ids are packed each,
    an empty table gives no rows, other columns are not read.
    """
    return pack(pieces(table(spark, sf_dir, "documents"), vocabulary()))
