"""Command line: similar loci of a ``.bed`` file as tab-separated text.

``python -m tessera.cli --input-bed FILE --n-individuals N [--hash-size K] [--n-rows-per-band R] ...``
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .api import BinaryTable, SketchTable
from .params import Sketching, Sparsity
from .sources import bed, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__.splitlines()[0])
    p.add_argument("--input-bed", required=True, help="genotypes; locus names come from the .bim file of the same stem")
    p.add_argument("--n-individuals", required=True, type=int, help="number of individuals, at least two")
    p.add_argument("--hash-size", type=int, default=0, help="number of sketches; 0: exact similarity of all pairs")
    p.add_argument("--n-rows-per-band", type=int, default=0, help="sketches of a band; 0: all pairs")
    p.add_argument("--threads", type=int, default=-1, help="cores of a local session; -1: all")
    p.add_argument("--min-similarity", type=float, default=0.0, help="pairs below are left out")
    p.add_argument("--log-file", default="tessera.log", help="'none': no log")
    p.add_argument("--out-file", default="tesseraOut.tsv", help="folder of tab-separated files")
    p.add_argument("--only-groups", action="store_true", help="groups instead of pairs")
    p.add_argument("--add-locus-names", action="store_true")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--single-file", action="store_true", help="one output file in the folder")
    p.add_argument("--ordered", action="store_true", help="rows in the order of their loci or groups, file by file")
    return p


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    builder = SparkSession.builder.appName("tessera")
    if "SPARK_MASTER" not in os.environ and SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{a.threads if a.threads > 0 else '*'}]")
    spark = builder.getOrCreate()
    try:
        names = None
        if a.add_locus_names:
            bim = a.input_bed.removesuffix(".bed") + ".bim"
            try:
                names = bed.read_bim(spark, bim)
            except Exception as e:  # noqa: BLE001  any reader's failure: numbers serve as names
                print(f"WARNING: no locus names from {bim} ({type(e).__name__}); base-1 numbers are used", file=sys.stderr)
        if not a.hash_size:
            table = BinaryTable.from_bed(spark, a.input_bed, a.n_individuals, a.seed)
            out = table.all_pairs(names, a.min_similarity)
        else:
            table = SketchTable.from_bed(spark, a.input_bed, Sketching(a.n_individuals, a.hash_size, a.seed))
            if not a.n_rows_per_band:
                out = table.all_pairs(a.min_similarity, names)
            elif a.only_groups:
                out = table.groups(a.n_rows_per_band, names)
            else:
                out = table.pairs_in_groups(Sparsity(a.n_rows_per_band, a.min_similarity), names)
        sinks.write_tsv(out, a.out_file, a.single_file, tuple(out.columns[:2]) if a.ordered else ())
    except ValueError as e:
        print(e, file=sys.stderr)
        parser().print_help(sys.stderr)
        return 1
    if a.log_file != "none":
        table.save_log(a.log_file)
    return 0


if __name__ == "__main__":
    sys.exit(main())
