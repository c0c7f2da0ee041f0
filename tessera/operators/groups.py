"""Groups of loci that share a band of sketches, and the similar pairs within them.

Buckets are never gathered. A bucket is known by its smallest locus (a partial aggregate); a group is the union of the
buckets that share their smallest locus, kept as rows ``first_locus, locus``. Pairs are compared group by group in
cells of bounded size, so that a group of any size spreads over tasks and only pairs at the cut-off become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import Sketching, Sparsity
from ..session import stored
from .pairs import BLOCK, KINDS, compare_hash, every, in_cells


def band_keys(sketched: DataFrame, p: Sketching, rows: int, odd_only: bool = False) -> DataFrame:
    """``locus, band, key``: the sketches of each whole band, comma-joined; a part of a band at the end is not used.

    ``odd_only`` keys bands on every second sketch from the second on, for selectivity like a hash that skips the others.
    """
    Sparsity(rows).check(p.k)

    def key(b: Column) -> Column:
        part = F.slice("sketch", b * rows + 1, rows)
        return F.array_join(F.filter(part, lambda _, i: i % 2 == 1) if odd_only else part, ",")

    bands = F.transform(F.sequence(F.lit(0), F.lit(p.k // rows - 1)), lambda b: F.struct(b.alias("band"), key(b).alias("key")))
    return sketched.select("locus", F.explode(bands).alias("x")).select("locus", "x.band", "x.key")


def buckets(keyed: DataFrame) -> DataFrame:
    """``band, key, first_locus, n`` of buckets of two loci and more."""
    return keyed.groupBy("band", "key").agg(F.min("locus").alias("first_locus"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def in_buckets(keyed: DataFrame) -> DataFrame:
    """``band, key, first_locus, locus``: members of those buckets; large ones are split by AQE's skew join."""
    return keyed.join(buckets(keyed).drop("n").hint("merge"), ["band", "key"])


def members(keyed: DataFrame) -> DataFrame:
    """``first_locus, locus``: groups, the union of buckets with one smallest locus, that locus included."""
    return in_buckets(keyed).select("first_locus", "locus").distinct()


def sizes(grouped: DataFrame) -> DataFrame:
    """``first_locus, n, n_pairs``."""
    found = grouped.groupBy("first_locus").agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("n_pairs", F.expr("n * (n - 1) div 2"))


def distinct_buckets(found: DataFrame) -> DataFrame:
    """``band, key, first_locus, locus`` of buckets that differ: of those with the same loci, the first by band and key.

    Sets are told apart by their size and by sums of two hashes of their loci, which add up where the rows lie.
    """
    sums = [F.sum(F.xxhash64(F.lit(k), F.col("locus")).cast("decimal(38,0)")).alias(f"_s{k}") for k in (1, 2)]
    sets = found.groupBy("band", "key", "first_locus").agg(F.count(F.lit(1)).alias("_n"), *sums)
    firsts = sets.groupBy("first_locus", "_n", "_s1", "_s2").agg(F.min(F.struct("band", "key")).alias("_at")).select("_at.*")
    return found.join(firsts.hint("merge"), ["band", "key"]).select("band", "key", "first_locus", "locus")


def running(rows: DataFrame, order: str, value: str, parts: int = 64) -> DataFrame:
    """``rows`` with ``number`` (from 1) and ``total`` (running sum of value) in the order of a distinct BIGINT column.

    Ranges of the order are numbered each on its own, then shifted by what the ranges before hold: no task sees all rows.
    """
    rows = stored(rows, "ordered")
    bounds = sorted(set(rows.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []))
    part = F.array_size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    rows = rows.withColumn("_part", part)
    per = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # at most `parts` rows
    shifts = per.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s"))
    here = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    own = rows.withColumns({"_r": F.row_number().over(here), "_t": F.sum(value).over(here)})
    out = own.join(F.broadcast(shifts), "_part")
    return out.withColumns({"number": F.col("_n") + F.col("_r"), "total": F.col("_s") + F.col("_t")}).drop("_part", "_n", "_s", "_r", "_t")


def numbered(grouped: DataFrame) -> DataFrame:
    """``first_locus, n, n_pairs, group_id, cum_pairs`` of all groups in the order of their first loci."""
    return running(sizes(grouped), "first_locus", "n_pairs").withColumnsRenamed({"number": "group_id", "total": "cum_pairs"})


def long_list(grouped: DataFrame) -> DataFrame:
    """``groupID, locusIdx``: G1, G2 ... and base-1 loci."""
    named = numbered(grouped).select("first_locus", F.concat(F.lit("G"), F.col("group_id")).alias("groupID"))
    return grouped.join(named, "first_locus").select("groupID", (F.col("locus") + 1).alias("locusIdx"))


def _cells(grouped: DataFrame, block: int) -> DataFrame:
    """``grouped`` with ``cell, side``: groups on a grid of blocks of about ``block`` loci."""
    found = grouped.join(sizes(grouped.select("first_locus")).select("first_locus", F.expr("(n + {b} - 1) div {b}".replace("{b}", str(block))).alias("nb")), "first_locus")
    found = found.withColumn("b", F.pmod(F.xxhash64("locus"), F.col("nb")))
    dealt = found.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)))
    cell = F.concat_ws("/", F.col("first_locus"), F.greatest("b", "o"), F.least("b", "o"))
    return dealt.withColumns({"cell": cell, "side": (F.col("b") < F.col("o")).cast("int")})


def similar_pairs(grouped: DataFrame, sketched: DataFrame, p: Sketching, cutoff: float, block: int = BLOCK) -> DataFrame:
    """``row, col, n_eq``: distinct pairs within groups with at least ``cutoff`` of the sketches equal."""
    return in_cells(_cells(grouped, block).join(sketched, "locus"), "sketch", compare_hash(p), cutoff, KINDS["hash"]).distinct()


def all_pairs(grouped: DataFrame, block: int = BLOCK) -> DataFrame:
    """``row, col``: distinct pairs within groups, as rows, made cell by cell; ``similar_pairs`` compares without making them."""
    return in_cells(_cells(grouped, block).withColumn("nothing", F.lit(0)), "nothing", every, 0.0, KINDS["every"]).distinct()
