"""Pairs of loci: all of them, on a grid of blocks.

Loci are dealt into blocks by hash. Cell (i, j) with i >= j gets the blocks i and j and compares them in one task; pairs
below the cut-off never become rows. Each locus is sent to as many cells as there are blocks: what all by all costs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import printed, quantized
from ..params import Sketching
from ..session import partitions, ship

#: Loci of one block.
BLOCK = 512
#: Positions that are compared at a time.
WIDTH = 8192
#: Named pairs that leave a task at a time, and cells of them that a task has: a result that grows by the square gets more tasks.
SENT, PER_TASK = 1 << 16, 64
NAMED = "name1 string, name2 string, jaccard string"
KINDS = {"exact": "row long, col long, n_intersect long, n_union long", "hash": "row long, col long, n_eq int", "every": "row long, col long"}


def _dense(lists: pa.ListArray, n: int, start: int) -> np.ndarray:
    out = np.zeros((len(lists), min(WIDTH, n - start)), np.float32)
    inds = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    here = (inds >= start) & (inds < start + WIDTH)
    out[rows[here], inds[here] - start] = 1
    return out


def _exact(n: int) -> Callable:
    def compare(a: pa.ListArray, b: pa.ListArray, cutoff: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        both = np.zeros((len(a), len(b)), np.int64)
        for start in range(0, n, WIDTH):
            both += np.rint(_dense(a, n, start) @ _dense(b, n, start).T).astype(np.int64)
        na, nb = (np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (a, b))
        union = na[:, None] + nb[None, :] - both
        i, j = np.nonzero((union > 0) & (both >= cutoff * union))
        return i, j, [both[i, j], union[i, j]]

    return compare


def _hash(k: int) -> Callable:
    def compare(a: pa.ListArray, b: pa.ListArray, cutoff: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        x, y = (v.flatten().to_numpy(zero_copy_only=False).reshape(-1, k) for v in (a, b))
        equal = np.zeros((len(x), len(y)), np.int32)
        for s in range(k):
            equal += x[:, s][:, None] == y[:, s][None, :]
        i, j = np.nonzero(equal / k >= cutoff)
        return i, j, [equal[i, j]]

    return compare


def every(a: pa.Array, b: pa.Array, cutoff: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All pairs of a cell."""
    i, j = np.divmod(np.arange(len(a) * len(b)), max(1, len(b)))
    return i, j, []


def in_cells(cells: DataFrame, payload: str, compare: Callable, cutoff: float, schema: str) -> DataFrame:
    """Compare the loci of each cell (``cell, side, locus, payload``; all of a cell's rows fit one task).

    Side 0 meets side 1, or itself where there is no side 1. Cells are read one by one from sorted partitions.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int32() if f.split()[1] == "int" else pa.int64() for f in schema.split(", ")]

    def one(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        loci = rows.column("locus").to_numpy()
        u, v, values = _met(rows, payload, compare, cutoff)
        if len(u):
            own = [loci[u], loci[v], *values]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(own, kinds, strict=True)], names)

    return _cell_by_cell(cells.select("cell", "side", "locus", payload), one, schema)


def _met(rows: pa.RecordBatch, payload: str, compare: Callable, cutoff: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a cell's rows, the places of the larger and the smaller locus of each pair at the cut-off, and the pairs' values."""
    side, loci, data = rows.column("side").to_numpy(), rows.column("locus").to_numpy(), rows.column(payload)
    m = int((side == 0).sum())
    alone = m == len(side)
    if not m or alone and m < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64), []
    at = 0 if alone else m
    i, j, values = compare(data.slice(0, m), data.slice(at), cutoff)
    j = j + at
    li, lj = loci[i], loci[j]
    kept = li > lj if alone else li != lj
    if not kept.all():
        i, j, li, lj, values = i[kept], j[kept], li[kept], lj[kept], [x[kept] for x in values]
    first = li > lj
    return np.where(first, i, j), np.where(first, j, i), values


def _cell_by_cell(cells: DataFrame, one: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, tasks: int = 0) -> DataFrame:
    """``one`` over the rows of each cell, those of side 0 first, in at least so many tasks."""
    ship(cells.sparkSession)
    cells = cells.repartition(max(tasks, partitions(cells.sparkSession)), "cell").sortWithinPartitions("cell", "side")

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if key != cell[a]:
                    if held:
                        yield from one(whole(held))
                    key, held = cell[a], []
                held.append(batch.slice(a, b - a))
        if held:
            yield from one(whole(held))

    return cells.mapInArrow(run, schema)


def _blocks(loci: DataFrame, block: int) -> int:
    return max(1, -(-loci.count() // block))


def _grid(loci: DataFrame, payload: str, n: int, chunk: int | None = None, chunks: int = 1, more: tuple[str, ...] = ()) -> DataFrame:
    """``cell, side, locus, payload`` and ``more`` of loci that are dealt into ``n`` blocks."""
    own = F.pmod(F.xxhash64("locus"), F.lit(n))
    there = loci.select("locus", payload, *more, own.alias("b")).select("locus", payload, *more, "b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o"))
    cells = there.withColumn("cell", F.greatest("b", "o") * n + F.least("b", "o"))
    if chunk is not None:
        cells = cells.filter(F.pmod(F.xxhash64("cell"), F.lit(chunks)) == chunk)
    return cells.select("cell", (F.col("b") < F.col("o")).cast("int").alias("side"), "locus", payload, *more)


def all_exact(bits: DataFrame, n: int, cutoff: float = 0.0, block: int = BLOCK, chunk: int | None = None, chunks: int = 1) -> DataFrame:
    """``row, col, n_intersect, n_union`` of all pairs of ``locus, inds`` (distinct loci) with row > col.

    Pairs of two loci without set bits have no similarity and are left out. Of ``chunks`` chunks, ``chunk`` alone: each
    has its share of the cells, so that the pairs of all chunks together are all pairs, each once.
    """
    return in_cells(_grid(bits, "inds", _blocks(bits, block), chunk, chunks), "inds", _exact(n), cutoff, KINDS["exact"])


def all_hash(sketched: DataFrame, p: Sketching, cutoff: float = 0.0, block: int = BLOCK, chunk: int | None = None, chunks: int = 1) -> DataFrame:
    """``row, col, n_eq`` of all pairs of ``locus, sketch`` with at least ``cutoff`` of the sketches equal, or of a chunk of them."""
    return in_cells(_grid(sketched, "sketch", _blocks(sketched, block), chunk, chunks), "sketch", _hash(p.k), cutoff, KINDS["hash"])


def compare_hash(p: Sketching) -> Callable:
    return _hash(p.k)


def with_names(loci: DataFrame, names: DataFrame) -> DataFrame:
    """``loci`` with ``name`` from ``idx, name``; a locus without a name is called by its base-1 number."""
    own = names.select(F.col("idx").alias("locus"), F.col("name").alias("_name"))
    return loci.join(own, "locus", "left").withColumn("name", F.coalesce("_name", (F.col("locus") + 1).cast("string"))).drop("_name")


def _all_named(loci: DataFrame, payload: str, compare: Callable, cutoff: float, block: int, union: int | None = None) -> DataFrame:
    """``name1, name2, jaccard`` of all pairs. Names travel with the loci, and pairs leave the tasks as they are printed, so
    that no pair is shuffled or joined. Pairs come in runs of one locus."""
    similarities = pa.array([f"{q / 255:.4f}" for q in range(256)])

    def one(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = rows.take(pa.array(np.lexsort((rows.column("locus").to_numpy(), rows.column("side").to_numpy()))))
        u, v, values = _met(rows, payload, compare, cutoff)
        name = rows.column("name")
        for k in range(0, len(u), SENT):
            here = [x[k : k + SENT] for x in values]
            q = 255 * here[0].astype(np.int64) // (here[1] if union is None else union)
            own = [name.take(pa.array(u[k : k + SENT])), name.take(pa.array(v[k : k + SENT])), similarities.take(pa.array(q))]
            yield pa.RecordBatch.from_arrays(own, ["name1", "name2", "jaccard"])

    n = _blocks(loci, block)
    return _cell_by_cell(_grid(loci, payload, n, more=("name",)), one, NAMED, n * (n + 1) // 2 // PER_TASK)


def named_exact(bits: DataFrame, n: int, cutoff: float = 0.0, block: int = BLOCK) -> DataFrame:
    """The pairs of ``all_exact``, of ``locus, inds, name``, as ``name1, name2, jaccard``."""
    return _all_named(bits, "inds", _exact(n), cutoff, block)


def named_hash(sketched: DataFrame, p: Sketching, cutoff: float = 0.0, block: int = BLOCK) -> DataFrame:
    """The pairs of ``all_hash``, of ``locus, sketch, name``, as ``name1, name2, jaccard``."""
    return _all_named(sketched, "sketch", _hash(p.k), cutoff, block, p.k)


def listed(pairs: DataFrame, n_union: int | None = None) -> DataFrame:
    """``locus1, locus2, jaccard``: base-1 numbers, the larger first, four decimals of the similarity in 255ths."""
    q = quantized(F.col("n_intersect"), F.col("n_union")) if n_union is None else quantized(F.col("n_eq"), F.lit(n_union))
    return pairs.select((F.col("row") + 1).alias("locus1"), (F.col("col") + 1).alias("locus2"), printed(q).alias("jaccard"))


def named(pairs: DataFrame, names: DataFrame, n_union: int | None = None) -> DataFrame:
    """``name1, name2, jaccard`` with names from ``idx, name``, for few pairs: they meet the names twice. A locus without a name
    is called by its base-1 number."""
    q = quantized(F.col("n_intersect"), F.col("n_union")) if n_union is None else quantized(F.col("n_eq"), F.lit(n_union))
    first = names.select(F.col("idx").alias("row"), F.col("name").alias("_n1"))
    second = names.select(F.col("idx").alias("col"), F.col("name").alias("_n2"))
    found = pairs.join(first, "row", "left").join(second, "col", "left")
    return found.select(
        F.coalesce("_n1", (F.col("row") + 1).cast("string")).alias("name1"), F.coalesce("_n2", (F.col("col") + 1).cast("string")).alias("name2"), printed(q).alias("jaccard")
    )
