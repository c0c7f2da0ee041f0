"""The four queries: exact and sketched similarity of all pairs, groups, and similar pairs within groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import groups, pairs
from ..operators.sketch import sketches
from ..params import Sketching, Sparsity, check_individuals
from ..session import stored


def exact(bits: DataFrame, n: int, names: DataFrame | None = None, cutoff: float = 0.0) -> DataFrame:
    """All pairs by exact Jaccard similarity: ``locus1, locus2, jaccard``, or ``name1, name2, jaccard``."""
    check_individuals(n)
    if names is not None:
        return pairs.named_exact(stored(pairs.with_names(bits, names), "bits"), n, cutoff)
    return pairs.listed(pairs.all_exact(stored(bits, "bits"), n, cutoff))


def hashed(bits: DataFrame, p: Sketching, cutoff: float = 0.0, names: DataFrame | None = None) -> DataFrame:
    """All pairs by equal sketches. Sketches are made once and read again from a table."""
    if names is not None:
        return pairs.named_hash(stored(pairs.with_names(sketches(bits, p), names), "sketches"), p, cutoff)
    return pairs.listed(pairs.all_hash(stored(sketches(bits, p), "sketches"), p, cutoff), p.k)


def grouped(sketched: DataFrame, p: Sketching, rows: int) -> DataFrame:
    """``first_locus, locus``: the groups."""
    return groups.members(groups.band_keys(sketched, p, rows))


def group_list(bits: DataFrame, p: Sketching, rows: int) -> DataFrame:
    """``groupID, locusIdx``."""
    return groups.long_list(stored(grouped(stored(sketches(bits, p), "sketches"), p, rows), "groups"))


def counted_groups(bits: DataFrame, p: Sketching, rows: int) -> tuple[DataFrame, dict[str, int]]:
    """``group_list``, and how many buckets, groups and pairs there are."""
    keyed = stored(groups.band_keys(sketches(bits, p), p, rows), "keyed")
    found = stored(groups.members(keyed), "groups")
    total = groups.sizes(found).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("pairs")).first()
    return groups.long_list(found), {"buckets": groups.buckets(keyed).count(), "groups": total.n, "pairs in groups": total.pairs}


def in_groups(bits: DataFrame, p: Sketching, sparsity: Sparsity, names: DataFrame | None = None) -> DataFrame:
    """Pairs within groups at the cut-off, by equal sketches; each pair once."""
    sparsity.check(p.k)
    sketched = stored(sketches(bits, p), "sketches")
    found = stored(grouped(sketched, p, sparsity.rows), "groups")
    out = groups.similar_pairs(found, sketched, p, sparsity.cutoff)
    return pairs.listed(out, p.k) if names is None else pairs.named(out, names, p.k)


def in_chunks(found: Callable[[int], DataFrame], path: str, chunks: int) -> list[str]:
    """Write all pairs in parts that can be resumed: ``found`` gives the pairs of a chunk; those that a former run has
    finished stay as they are. Gives the chunks' folders, each a table."""
    paths = [f"{path.rstrip('/')}/chunk-{k:06d}" for k in range(chunks)]
    for k, place in enumerate(paths):
        df = found(k)
        done = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
        if not done.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(done):
            df.write.mode("overwrite").parquet(place)
    return paths


def exact_in_chunks(bits: DataFrame, n: int, path: str, chunks: int, cutoff: float = 0.0) -> list[str]:
    """All pairs by exact similarity, as ``exact`` lists them, chunk by chunk."""
    check_individuals(n)
    kept = stored(bits, "bits")
    return in_chunks(lambda k: pairs.listed(pairs.all_exact(kept, n, cutoff, chunk=k, chunks=chunks)), path, chunks)


def hashed_in_chunks(bits: DataFrame, p: Sketching, path: str, chunks: int, cutoff: float = 0.0) -> list[str]:
    """All pairs by equal sketches, chunk by chunk."""
    kept = stored(sketches(bits, p), "sketches")
    return in_chunks(lambda k: pairs.listed(pairs.all_hash(kept, p, cutoff, chunk=k, chunks=chunks), p.k), path, chunks)
