"""Queries over the driver's tables, one for each operator, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .functions import murmur
from .functions.murmur import murmur_steps
from .functions.similarity import printed, quantized, rank, unrank
from .operators import binarize, groups, matrix, pairs, ranges
from .operators import sketch as oph
from .params import Sketching, Sparsity
from .plans import ld
from .session import shared_dir, stored
from .sources import bed, fixtures
from .sources.fixtures import GENO_N, INCIDENCE_N

GENO = Sketching(GENO_N, 16)
PADDED = Sketching(GENO_N, 10)
TEXTS = Sketching(INCIDENCE_N, 64)
ROWS, CUT, HASH_CUT = 4, 0.5, 0.25
SEED = 2153025618


def _bits(spark: SparkSession, d: str) -> DataFrame:
    return binarize.binarize(fixtures.geno(spark, d))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return oph.sketches(fixtures.incidence(spark, d), TEXTS)


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return groups.band_keys(_texts(spark, d), TEXTS, ROWS)


def _members(spark: SparkSession, d: str) -> DataFrame:
    return groups.members(stored(_keyed(spark, d), "keyed"))


def scan_mac(spark: SparkSession, d: str) -> DataFrame:
    return bed.exploded(fixtures.geno(spark, d))


def scan_bed(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/geno-{uuid.uuid4().hex}/geno.bed"
    bed.write_bed(fixtures.geno(spark, d), path)
    return bed.exploded(bed.read_bed(spark, path, GENO_N, split=4096))


def scan_bim(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/names-{uuid.uuid4().hex}"
    rows = fixtures.names(spark, d).orderBy("idx")
    rows.select(F.concat_ws(" ", F.lit("1"), "name", F.lit("0"), F.col("idx") * 10, F.lit("A"), F.lit("C")).alias("value")).write.text(path)
    return bed.read_bim(spark, path).select("idx", "name")


def binarize_mac(spark: SparkSession, d: str) -> DataFrame:
    parts = fixtures.table(spark, d, "part").select(F.col("p_partkey").alias("ind"))
    return binarize.binarize_long(fixtures.basket(spark, d), parts)


def popcount(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.table(spark, d, "part").select(F.col("p_partkey").alias("value"), F.bit_count("p_partkey").alias("n_bits"))


def jaccard_hash_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.all_hash(stored(oph.sketches(_bits(spark, d), GENO), "sketches"), GENO)


def sketch_txt(spark: SparkSession, d: str) -> DataFrame:
    return oph.sketches(_bits(spark, d), GENO).select("locus", F.array_join("sketch", ",").alias("sketch_txt"))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    """``k, line, row, col, n_intersect, n_union``: pairs with counts, many of them more than once, ``k`` in their order."""
    items = fixtures.table(spark, d, "lineitem").filter("l_partkey <> l_suppkey")
    line = F.col("l_linenumber").cast("bigint")
    return items.select((F.col("l_orderkey") * 8 + line).alias("k"), line.alias("line"), F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), line.alias("n_intersect"), (line + F.col("l_quantity").cast("bigint")).alias("n_union"))


def quantize(spark: SparkSession, d: str) -> DataFrame:
    q = quantized(F.col("n_intersect"), F.col("n_union"))
    return _counted(spark, d).select("n_intersect", "n_union", q.alias("q"), printed(q).alias("jaccard"))


def band_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d).select("locus", "band", F.lit(ROWS).alias("n_rows"))


def bucket_list(spark: SparkSession, d: str) -> DataFrame:
    found = groups.in_buckets(stored(_keyed(spark, d), "keyed"))
    return found.select("band", "key", "first_locus", "locus")


def buckets_dedup(spark: SparkSession, d: str) -> DataFrame:
    return groups.distinct_buckets(stored(groups.in_buckets(stored(_keyed(spark, d), "keyed")), "buckets"))


def ld_groups(spark: SparkSession, d: str) -> DataFrame:
    found = stored(_members(spark, d), "groups")
    return found.join(groups.sizes(found).hint("merge"), "first_locus").select("first_locus", "locus", "n_pairs")


def _matrix(spark: SparkSession, d: str, lines: str) -> DataFrame:
    return matrix.inserted(matrix.valid(_counted(spark, d).filter(lines)), "k")


def matrix_merge(spark: SparkSession, d: str) -> DataFrame:
    a, b = _matrix(spark, d, "line <= 3"), _matrix(spark, d, "line >= 3")
    one, two = (matrix.merged(x, y).withColumn("side", F.lit(s)) for s, x, y in (("left", a, b), ("right", b, a)))
    return one.union(two)


def triangle_unrank(spark: SparkSession, d: str) -> DataFrame:
    row, col = unrank(F.col("o_orderkey"))
    return fixtures.table(spark, d, "orders").select(F.col("o_orderkey").alias("vec_idx"), row.alias("row"), col.alias("col"))


def triangle_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = _counted(spark, d).select(F.greatest("row", "col").alias("row"), F.least("row", "col").alias("col"))
    return rows.select(rank(F.col("row"), F.col("col")).alias("vec_idx"), "row", "col")


def group_ranges(spark: SparkSession, d: str) -> DataFrame:
    sizes = spark.sql("SELECT CAST(g AS BIGINT) AS group_id, CAST(n * (n - 1) / 2 AS BIGINT) AS n_pairs FROM VALUES (1, 7), (2, 5), (3, 11) AS t(g, n)")
    whole = groups.running(sizes, "group_id", "n_pairs").select("group_id", "n_pairs", F.col("total").alias("cum_pairs"))
    return ranges.group_range_end(whole, 2, 2, 12)


def murmur_u32(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.table(spark, d, "part").select(F.col("p_partkey").alias("value"))
    low, high = F.col("value").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("value", 32)
    for name, column in murmur_steps(low, high, SEED):
        rows = rows.withColumn(name, column)
    return rows.select("value", "hash")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """``locus, inds``: the first line numbers and part keys of each order, in order."""
    items = fixtures.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("locus"))
    return items.agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("inds"))


QUERIES = {
    "scan_mac": scan_mac,
    "scan_bed": scan_bed,
    "scan_bim": scan_bim,
    "flip_decision": lambda s, d: binarize.flips(fixtures.geno(s, d)),
    "missing_mask": lambda s, d: binarize.missing(fixtures.geno(s, d)),
    "het_resolve": lambda s, d: binarize.hets(fixtures.geno(s, d)),
    "binarize_bits": lambda s, d: binarize.set_bits(_bits(s, d)),
    "binarize_mac": binarize_mac,
    "popcount": popcount,
    "popcount_locus": lambda s, d: binarize.bit_counts(_bits(s, d)),
    "popcount_window": lambda s, d: binarize.bit_counts(_bits(s, d), 16, 32),
    "oph_pad": lambda s, d: oph.pad_map(s, PADDED),
    "oph_permute": lambda s, d: oph.permuted(_bits(s, d), PADDED),
    "oph_sketch": lambda s, d: oph.bins(oph.sketches(_bits(s, d), GENO, dense=False)),
    "oph_densify": sketch_txt,
    "oph_monomorphic": lambda s, d: binarize.monomorphic(fixtures.incidence(s, d)),
    "jaccard_exact_pairs": lambda s, d: pairs.all_exact(stored(_bits(s, d), "bits"), GENO_N),
    "jaccard_hash_pairs": jaccard_hash_pairs,
    "quantize": quantize,
    "ld_exact": lambda s, d: ld.exact(_bits(s, d), GENO_N),
    "ld_hash_all": lambda s, d: ld.hashed(_bits(s, d), GENO, HASH_CUT),
    "ld_with_names": lambda s, d: ld.exact(_bits(s, d), GENO_N, fixtures.names(s, d)),
    "bands": band_sizes,
    "band_keys": _keyed,
    "buckets": bucket_list,
    "buckets_dedup": buckets_dedup,
    "ld_groups": ld_groups,
    "group_cum_pairs": lambda s, d: groups.numbered(_members(s, d)).select("group_id", "n_pairs", "cum_pairs"),
    "ld_groups_long": lambda s, d: ld.group_list(fixtures.incidence(s, d), TEXTS, ROWS),
    "group_pairs": lambda s, d: groups.all_pairs(stored(_members(s, d), "groups")),
    "ld_in_groups": lambda s, d: ld.in_groups(fixtures.incidence(s, d), TEXTS, Sparsity(ROWS, CUT)),
    "matrix_insert": lambda s, d: _matrix(s, d, "true"),
    "matrix_merge": matrix_merge,
    "matrix_append": lambda s, d: matrix.appended(_matrix(s, d, "line <= 3"), _matrix(s, d, "line >= 3")),
    "matrix_order": lambda s, d: matrix.ordered(_matrix(s, d, "true")),
    "matrix_stats": lambda s, d: matrix.stats(_matrix(s, d, "true")),
    "triangle_rank": triangle_rank,
    "triangle_unrank": triangle_unrank,
    "chunk_sizes": lambda s, d: ranges.chunk_sizes(s, 35, 4),
    "chunk_ranges": lambda s, d: ranges.chunk_ranges(s, 0, 35, 4),
    "group_ranges": group_ranges,
    "murmur_u32": murmur_u32,
    "murmur_indexes": lambda s, d: _vectors(s, d).select("locus", murmur.indexes(F.col("inds"), SEED).alias("hash")),
    "murmur_vector": lambda s, d: _vectors(s, d).select("locus", murmur.u32(F.col("inds"), SEED).alias("hash")),
    "murmur_window": lambda s, d: _vectors(s, d).select("locus", murmur.window(F.col("inds"), 3, 9, SEED).alias("hash")),
}
ORACLES = oracles.ORACLES
