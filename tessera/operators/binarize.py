"""One bit per genotype: the minor state is set, missing is not, a heterozygote is set by a seeded coin.

Wide tables have one row a locus (``mac array<int>`` in, ``inds array<int>`` of set positions out), so that a locus is
coded where it is read. Long tables have one row an observation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import h32


def coin(locus: Column, ind: Column, seed: int = 0) -> Column:
    return h32("het", seed, locus, ind) % 2


def first_bit(mac: Column, locus: Column, ind: Column, seed: int = 0) -> Column:
    """Bit before the flip: zero and missing unset, odd counts by coin, other counts set."""
    return F.when(mac <= 0, F.lit(0).cast("bigint")).when(mac % 2 == 1, coin(locus, ind, seed)).otherwise(1)


def _called(geno: DataFrame) -> tuple[Column, Column]:
    """Loci's carriers (counts above zero) and called genotypes; null counts are missing."""
    clean = F.transform("mac", lambda x: F.coalesce(x, F.lit(-9)))
    return F.size(F.filter(clean, lambda x: x > 0)), F.size(F.filter(clean, lambda x: x >= 0))


def flips(geno: DataFrame) -> DataFrame:
    """``locus, n_carrier, n_called, flip``: a locus is flipped if more than half of those called carry the counted allele."""
    carrier, called = _called(geno)
    return geno.select("locus", carrier.alias("n_carrier"), called.alias("n_called")).withColumn("flip", F.col("n_carrier") * 2 > F.col("n_called"))


def missing(geno: DataFrame) -> DataFrame:
    """``locus, n_missing``."""
    return geno.select("locus", F.size(F.filter("mac", lambda x: F.coalesce(x, F.lit(-9)) < 0)).alias("n_missing"))


def hets(geno: DataFrame, seed: int = 0) -> DataFrame:
    """``locus, ind, bit`` of heterozygotes, before the flip."""
    long = geno.select("locus", F.posexplode("mac").alias("ind", "mac")).filter("mac > 0 AND mac % 2 = 1")
    return long.select("locus", "ind", coin(F.col("locus"), F.col("ind"), seed).cast("int").alias("bit"))


def binarize(geno: DataFrame, seed: int = 0) -> DataFrame:
    """``locus, inds``: sorted set positions of each row of ``locus, mac``; no shuffle. A null list of counts has no set bit."""
    carrier, called = _called(geno)
    flip = (carrier * 2 > called).cast("bigint")
    bit = lambda x, i: first_bit(x, F.col("locus"), i, seed).bitwiseXOR(F.col("_flip"))
    kept = lambda x, i: F.when((F.coalesce(x, F.lit(-9)) >= 0) & (bit(x, i) == 1), i)
    inds = F.array_compact(F.transform("mac", kept))
    return geno.withColumn("_flip", flip).select("locus", F.coalesce(inds, F.array().cast("array<int>")).alias("inds"))


def binarize_long(counts: DataFrame, individuals: DataFrame, seed: int = 0) -> DataFrame:
    """``locus, ind``: set bits of sparse ``locus, ind, mac``, where what is not listed counts zero.

    Only loci that are flipped, of which most rows are listed, meet all ``individuals`` (``ind``, distinct).
    """
    n = individuals.select("ind").distinct().count()
    per = counts.groupBy("locus").agg(F.sum(F.when(F.col("mac") > 0, 1).otherwise(0)).alias("c"), F.sum(F.when(F.col("mac") < 0, 1).otherwise(0)).alias("m"))
    flipped = per.filter(F.col("c") * 2 > n - F.col("m")).select("locus")
    coded = counts.withColumn("bit", first_bit(F.col("mac"), F.col("locus"), F.col("ind"), seed)).filter("mac < 0 OR bit = 1")
    plain = coded.filter("mac >= 0").join(flipped, "locus", "left_anti").select("locus", "ind")
    people = individuals.select(F.col("ind").cast("long").alias("ind")).distinct()
    every = flipped.crossJoin(F.broadcast(people) if n <= 1 << 20 else people)  # 8 MB at most
    every = every.withColumn("ind", F.col("ind").cast(individuals.schema["ind"].dataType))
    return plain.union(every.join(coded.select("locus", "ind"), ["locus", "ind"], "left_anti").select("locus", "ind"))


def set_bits(bits: DataFrame) -> DataFrame:
    """``locus, ind`` of ``locus, inds``."""
    return bits.select("locus", F.explode("inds").alias("ind"))


def bit_counts(bits: DataFrame, start: int | None = None, length: int | None = None) -> DataFrame:
    """``locus, n_set``, of all positions or of a window."""
    inds = F.col("inds") if start is None else F.filter("inds", lambda i: (i >= start) & (i < start + length))
    return bits.select("locus", F.size(inds).alias("n_set"))


def monomorphic(bits: DataFrame) -> DataFrame:
    """Loci without a set bit."""
    return bits.filter(F.size("inds") == 0).select("locus")
