"""Densified one-permutation hashing.

All loci share one permutation of the (padded) individuals, cut into k bins. A locus' sketch holds each bin's first set
position. Empty bins are filled in rounds: of the bins that were filled from the start, taken in order, the first whose
seeded target is still empty gives its value, one fill a round. Which bin fills which depends on the set of filled bins
alone, so rounds run for all loci of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..params import Sketching
from ..session import ship

EMPTY = 65535


def pad_map(spark: SparkSession, p: Sketching) -> DataFrame:
    """``pad_pos, src_ind``: whose bit each position past the last individual copies."""
    source = rng.h32("pad", p.seed, F.col("id")) % p.n
    return spark.range(p.n, p.padded).select(F.col("id").alias("pad_pos"), source.alias("src_ind"))


def permuted(bits: DataFrame, p: Sketching) -> DataFrame:
    """``locus, pos``: set bits at their places in the permutation, pads included."""
    places = rng.permutation(p.padded, p.seed)
    sources = rng.pads(p.n, p.padded, p.seed)
    own: dict[int, list[int]] = {i: [int(places[i])] for i in range(p.n)}
    for k, s in enumerate(sources.tolist()):
        own[s].append(int(places[p.n + k]))
    spark = bits.sparkSession
    rows = spark.createDataFrame([(i, x) for i, xs in own.items() for x in xs], "ind int, pos int")
    return bits.select("locus", F.explode("inds").alias("ind")).join(F.broadcast(rows), "ind").select("locus", "pos")


def densify(sketch: np.ndarray, seed: int) -> np.ndarray:
    """Fill the negative (empty) bins of each row; rows without any value stay as they are."""
    k = sketch.shape[1]
    first = sketch >= 0
    out, todo = sketch.copy(), np.flatnonzero(first.any(1) & ~first.all(1))
    round_ = 0
    while len(todo):
        target = rng.fill_targets(k, round_, seed)
        able = first[todo] & (out[todo][:, target] < 0)
        giver = able.argmax(1)
        hit = able[np.arange(len(todo)), giver]
        rows, giver = todo[hit], giver[hit]
        out[rows, target[giver]] = sketch[rows, giver]
        todo = todo[(out[todo] < 0).any(1)]
        round_ += 1
    return out


def sketches(bits: DataFrame, p: Sketching, dense: bool = True, monomorphic: str = "drop") -> DataFrame:
    """``locus, sketch array<int>`` of ``locus, inds``; no shuffle.

    Without ``dense``, empty bins are -1. Loci without set bits are left out, or ("match") are ``EMPTY`` throughout, so
    that they equal each other. Positions outside ``0 .. n - 1`` fail.
    """
    if monomorphic not in ("drop", "match"):
        raise ValueError("monomorphic is drop or match")
    ship(bits.sparkSession)
    k, size, n, seed = p.k, p.size, p.n, p.seed
    shared = bits.sparkSession.sparkContext.broadcast((rng.permutation(p.padded, seed).astype(np.int32), rng.pads(n, p.padded, seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, sources = shared.value
        by_source = np.argsort(sources, kind="stable")
        starts = np.searchsorted(sources[by_source], np.arange(n + 1))
        for batch in batches:
            lists = batch.column("inds")
            lengths = np.diff(lists.offsets.to_numpy())
            inds = lists.flatten().to_numpy(zero_copy_only=False)
            if len(inds) and not 0 <= inds.min() <= inds.max() < n:
                raise ValueError("ERROR: a set bit lies outside the individuals")
            rows = np.repeat(np.arange(len(lengths)), lengths)
            # each set position once for itself and once for each pad that copies it
            pads = starts[inds + 1] - starts[inds]
            which = by_source[np.repeat(starts[inds] - np.cumsum(pads) + pads, pads) + np.arange(pads.sum())]
            at, of = np.concatenate([places[inds], places[n + which]]).astype(np.int64), np.concatenate([rows, np.repeat(rows, pads)])
            none = np.iinfo(np.int32).max
            out = np.full(len(lengths) * k, none, np.int64)
            np.minimum.at(out, of * k + at // size, at % size)
            out = out.reshape(-1, k)
            out[out == none] = -1
            if dense:
                out = densify(out, seed)
            some = (out >= 0).any(1)
            if monomorphic == "match":
                out[~some], some = EMPTY, np.ones(len(out), bool)
            kept = out[some].astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, kept.size + 1, k, dtype=np.int32)), pa.array(kept.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("locus").filter(pa.array(some)), column], ["locus", "sketch"])

    return bits.select("locus", F.coalesce("inds", F.array().cast("array<int>")).alias("inds")).mapInArrow(run, "locus long, sketch array<int>")


def bins(sketched: DataFrame) -> DataFrame:
    """``locus, bin, v`` of filled bins."""
    return sketched.select("locus", F.posexplode("sketch").alias("bin", "v")).filter("v >= 0")
