"""Two tables of genotypes with methods, for programs that think in tables rather than in operators."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import binarize
from .params import Sketching, Sparsity, check_individuals
from .plans import ld
from .sources import bed, sinks


@dataclass
class _Table:
    bits: DataFrame
    n: int
    log: list[str] = field(default_factory=list)

    def _begun(self, source: str, n: int, **more: int):
        self.note(", ".join([f"genotypes from {source}", f"{n} individuals", *(f"{k} {v}" for k, v in more.items())]))
        return self

    def note(self, text: str) -> None:
        logging.getLogger("tessera").info(text)
        self.log.append(text)

    def save_log(self, path: str) -> None:
        """Write what was noted; a log of a former run is replaced."""
        with open(path, "w", encoding="utf-8") as f:
            f.write("".join(x + "\n" for x in self.log))


class BinaryTable(_Table):
    """Genotypes as bits: exact similarity."""

    @classmethod
    def from_bed(cls, spark: SparkSession, path: str, n: int, seed: int = 0) -> BinaryTable:
        return cls(binarize.binarize(bed.read_bed(spark, path, n), seed), n)._begun(path, n, seed=seed)

    @classmethod
    def from_counts(cls, spark: SparkSession, counts: list[int], n: int, seed: int = 0) -> BinaryTable:
        return cls(binarize.binarize(bed.from_counts(spark, counts, n), seed), n)._begun("a vector of counts", n, seed=seed)

    @classmethod
    def empty(cls, spark: SparkSession, n: int = 2) -> BinaryTable:
        return cls(spark.createDataFrame([], "locus bigint, inds array<int>"), n)

    def all_pairs(self, names: DataFrame | None = None, cutoff: float = 0.0) -> DataFrame:
        self.note(f"all pairs, exact similarity, cut-off {cutoff}")
        return ld.exact(self.bits, self.n, names, cutoff)

    def write_pairs(self, path: str, chunks: int, cutoff: float = 0.0) -> list[str]:
        """All pairs in ``chunks`` parts, each a folder; a run that broke off goes on with those that are missing."""
        self.note(f"all pairs, exact similarity, cut-off {cutoff}, in {chunks} chunks under {path}")
        return ld.exact_in_chunks(self.bits, self.n, path, chunks, cutoff)

    def save_bits(self, path: str) -> None:
        sinks.write_raw(self.bits, self.n, path)


class SketchTable(_Table):
    """Genotypes as sketches: estimated similarity and groups."""

    def __init__(self, bits: DataFrame, params: Sketching):
        super().__init__(bits, params.n)
        self.params = params

    @classmethod
    def from_bed(cls, spark: SparkSession, path: str, params: Sketching) -> SketchTable:
        check_individuals(params.n)
        own = cls(binarize.binarize(bed.read_bed(spark, path, params.n), params.seed), params)
        return own._begun(path, params.n, sketches=params.k, seed=params.seed)

    @classmethod
    def from_counts(cls, spark: SparkSession, counts: list[int], params: Sketching) -> SketchTable:
        own = cls(binarize.binarize(bed.from_counts(spark, counts, params.n), params.seed), params)
        return own._begun("a vector of counts", params.n, sketches=params.k, seed=params.seed)

    def all_pairs(self, cutoff: float = 0.0, names: DataFrame | None = None) -> DataFrame:
        self.note(f"all pairs by {self.params.k} sketches, cut-off {cutoff}")
        return ld.hashed(self.bits, self.params, cutoff, names)

    def write_pairs(self, path: str, chunks: int, cutoff: float = 0.0) -> list[str]:
        """All pairs in ``chunks`` parts, each a folder; a run that broke off goes on with those that are missing."""
        self.note(f"all pairs by {self.params.k} sketches, cut-off {cutoff}, in {chunks} chunks under {path}")
        return ld.hashed_in_chunks(self.bits, self.params, path, chunks, cutoff)

    def groups(self, rows: int, names: DataFrame | None = None) -> DataFrame:
        """``groupID, locusIdx``, or ``groupID, name`` where names are given."""
        found, numbers = ld.counted_groups(self.bits, self.params, rows)
        self.note(f"groups by {self.params.k} sketches, {rows} rows a band: " + ", ".join(f"{v} {k}" for k, v in numbers.items()))
        if names is None:
            return found
        own = names.select((F.col("idx") + 1).alias("locusIdx"), "name")
        return found.join(own, "locusIdx", "left").select("groupID", F.coalesce("name", F.col("locusIdx").cast("string")).alias("name"))

    def pairs_in_groups(self, sparsity: Sparsity, names: DataFrame | None = None) -> DataFrame:
        self.note(f"pairs in groups by {self.params.k} sketches, {sparsity.rows} rows a band, cut-off {sparsity.cutoff}")
        return ld.in_groups(self.bits, self.params, sparsity, names)
