"""Files, binarization, sketches and groups on genotypes made here."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.api import BinaryTable, SketchTable
from tessera.operators import binarize, groups, pairs, sketch
from tessera.params import Sketching, Sparsity
from tessera.plans import ld
from tessera.sources import bed, sinks

N, LOCI = 50, 60


@pytest.fixture(scope="module")
def counts():
    r = random.Random(3)
    base = [[r.choice((0, 0, 0, 1, 2, -9)) for _ in range(N)] for _ in range(LOCI // 3)]
    out = []
    for row in base:  # each locus comes with a copy and a near copy
        near = list(row)
        for i in r.sample(range(N), 2):
            near[i] = 0
        out += [row, [2 - x if x >= 0 else x for x in row], near]
    out[4] = [0] * N
    return out


@pytest.fixture(scope="module")
def geno(spark, counts):
    return spark.createDataFrame(list(enumerate(counts)), "locus long, mac array<int>")


@pytest.fixture(scope="module")
def files(geno, tmp_path_factory, counts):
    d = tmp_path_factory.mktemp("geno")
    bed.write_bed(geno, f"{d}/x.bed")
    (d / "x.bim").write_text("".join(f"1 rs{k} 0 {k * 7} A C\n" for k in range(LOCI)))
    (d / "x.fam").write_text("".join(f"f{k} i{k} 0 0 {k % 2} -9\n" for k in range(N)))
    (d / "x.txt").write_text("\n".join(str(m) for row in counts for m in row) + "\n")
    return d


def test_bed_round_trip(spark, files, counts):
    for split in (1, 100, 1 << 20):
        got = {r.locus: r.mac for r in bed.read_bed(spark, f"{files}/x.bed", N, split).collect()}
        assert [got[k] for k in range(LOCI)] == counts


def test_bed_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="^ERROR: failed to open file"):
        bed.read_bed(spark, f"{tmp_path}/none.bed", 5)
    for k, name in enumerate(("first", "second", "third")):
        head = bytearray(bed.MAGIC)
        head[k] ^= 1
        (tmp_path / "bad.bed").write_bytes(bytes(head) + b"\0\0")
        with pytest.raises(ValueError, match=f"^ERROR: {name} magic byte in input .bed file"):
            bed.read_bed(spark, f"{tmp_path}/bad.bed", 5)
    (tmp_path / "none.bed").write_bytes(bed.MAGIC)
    with pytest.raises(ValueError, match="^ERROR: no genotype records in file"):
        bed.read_bed(spark, f"{tmp_path}/none.bed", 5)
    with pytest.raises(ValueError, match="^ERROR: number of individuals"):
        bed.read_bed(spark, f"{tmp_path}/none.bed", 1)


def test_text_files(spark, files, counts):
    assert [(r.idx, r.name) for r in bed.read_bim(spark, f"{files}/x.bim").orderBy("idx").collect()] == [(k, f"rs{k}") for k in range(LOCI)]
    assert bed.read_fam(spark, f"{files}/x.fam").count() == N
    got = bed.read_counts(spark, f"{files}/x.txt", N).orderBy("locus", "ind").collect()
    assert [r.mac for r in got] == [m for row in counts for m in row]


def test_many_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "long.bim").write_text("".join(f"1 n{k} 0 {k}\n" for k in range(30_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = bed.read_bim(spark, f"{tmp_path}/long.bim")
        assert got.filter("name <> concat('n', idx)").count() == 0 and got.count() == 30_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_of_a_folder_follow_each_other(spark, tmp_path):
    (tmp_path / "bims").mkdir()
    for k in range(3):
        (tmp_path / "bims" / f"chr{k}.bim").write_text("".join(f"1 n{3 * k + i} 0 {i}\n" for i in range(3)))
    assert [(r.idx, r.name) for r in bed.read_bim(spark, f"{tmp_path}/bims").orderBy("idx").collect()] == [(k, f"n{k}") for k in range(9)]


def brute_bits(mac, locus):
    from tessera.functions.rng import h32_of

    flip = 2 * sum(m > 0 for m in mac) > sum(m >= 0 for m in mac)
    bit = lambda m, i: 0 if m <= 0 else h32_of("het", 0, locus, i) % 2 if m % 2 else 1
    return [i for i, m in enumerate(mac) if m >= 0 and bit(m, i) != flip]


def test_binarize(spark, geno, counts):
    got = {r.locus: r.inds for r in binarize.binarize(geno).collect()}
    assert got == {k: brute_bits(row, k) for k, row in enumerate(counts)}
    long = bed.exploded(geno)
    people = spark.range(N).select(F.col("id").cast("int").alias("ind"))
    pairs_ = {(r.locus, r.ind) for r in binarize.binarize_long(long.filter("mac <> 0"), people).collect()}
    assert pairs_ == {(k, i) for k, x in got.items() for i in x}


def test_worked_locus(spark):
    # A worked example
    mac = [0, 2, 0, 2, 2, 1, -9, 0, 0, 2, 0, 2, -9, 1, 2, 0, 2]
    got = binarize.binarize(spark.createDataFrame([(0, mac)], "locus long, mac array<int>")).first().inds
    assert 6 <= len(got) <= 8 and {0, 2, 7, 8, 10, 15} <= set(got)


def test_odd_inputs(spark):
    rows = [(0, None), (1, []), (2, [None, 2, None, 0, 0]), (2, [None, 2, None, 0, 0])]
    df = spark.createDataFrame(rows, "locus long, mac array<int>")
    got = binarize.binarize(df)
    assert sorted((r.locus, r.inds) for r in got.collect()) == [(0, []), (1, []), (2, [1]), (2, [1])]
    p = Sketching(5, 3)
    assert {r.locus for r in sketch.sketches(got, p).collect()} == {2}
    matched = {r.locus: r.sketch for r in sketch.sketches(got, p, monomorphic="match").collect()}
    assert matched[0] == matched[1] == [sketch.EMPTY] * 3
    none = spark.createDataFrame([], "locus long, inds array<int>")
    assert not pairs.all_exact(none, 5).collect() and not ld.in_groups(none, p, Sparsity(1)).collect()
    with pytest.raises(Exception, match="outside the individuals"):
        sketch.sketches(spark.createDataFrame([(0, [9])], "locus long, inds array<int>"), p).collect()


def test_grid_does_not_depend_on_blocks(spark, geno):
    bits = binarize.binarize(geno)
    p = Sketching(N, 10)
    sk = sketch.sketches(bits, p)
    got = [sorted(map(tuple, pairs.all_exact(bits, N, 0.3, b).collect())) for b in (7, 1000)]
    assert got[0] == got[1] and got[0]
    got = [sorted(map(tuple, pairs.all_hash(sk, p, 0.3, b).collect())) for b in (7, 1000)]
    assert got[0] == got[1]
    n = sk.count()
    assert pairs.all_hash(sk, p).count() == n * (n - 1) // 2
    keyed = groups.band_keys(sk, p, 2)
    found = groups.members(keyed)
    got = [sorted(map(tuple, groups.similar_pairs(found, sk, p, 0.5, b).collect())) for b in (2, 1000)]
    assert got[0] == got[1] and got[0]


def test_names_travel_with_loci(spark, geno):
    """Named pairs are those of the unnamed queries, for any blocks, and a large grid has more tasks."""
    bits = binarize.binarize(geno)
    p = Sketching(N, 10)
    sk = sketch.sketches(bits, p)
    names = spark.createDataFrame([(k, f"ä{k}" if k % 3 else None) for k in range(1, 40)] + [(5, "twice"), (10**9, "nobody")], "idx int, name string")
    called = {}
    for k, name in names.filter("idx < 100").collect():
        called.setdefault(k, []).append(name or str(k + 1))
    of = lambda k: called.get(k, [str(k + 1)])
    want = lambda rows: sorted((a, b, s) for x, y, s in rows for a in of(x - 1) for b in of(y - 1))
    for found, plain, block in (
        (lambda b: pairs.named_exact(pairs.with_names(bits, names), N, 0.3, b), ld.exact(bits, N, cutoff=0.3), 7),
        (lambda b: pairs.named_exact(pairs.with_names(bits, names), N, 0.3, b), ld.exact(bits, N, cutoff=0.3), 1),
        (lambda b: pairs.named_hash(pairs.with_names(sk, names), p, 0.3, b), ld.hashed(bits, p, 0.3), 1000),
    ):
        assert sorted(map(tuple, found(block).collect())) == want(plain.collect())
    blocks = bits.count()
    assert pairs.named_exact(pairs.with_names(bits, names.filter("idx < 0")), N, block=1).rdd.getNumPartitions() == max(8, blocks * (blocks + 1) // 2 // pairs.PER_TASK) > 8


def test_named_pairs_are_not_shuffled(spark, geno):
    """Only loci are dealt out; their pairs meet no join and no exchange."""
    bits, names = binarize.binarize(geno), spark.createDataFrame([(1, "a")], "idx long, name string")
    for df in (ld.exact(bits, N, names), ld.hashed(bits, Sketching(N, 10), names=names)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.index("MapInArrow") < plan.index("Exchange") and plan.count("Exchange") == 1


def test_similarities_are_printed_alike(spark):
    """Of 255 individuals each pair's similarity is its count of common bits, so that all values are printed."""
    bits = spark.createDataFrame([(0, list(range(255))), *((k + 1, list(range(k))) for k in range(256))], "locus long, inds array<int>")
    names = spark.createDataFrame([(0, "whole")], "idx long, name string")
    got = {x.name1: x.jaccard for x in ld.exact(bits, 255, names).filter("name2 = 'whole'").collect()}
    plain = {str(x.locus1): x.jaccard for x in ld.exact(bits, 255).filter("locus2 = 1").collect()}
    assert got == plain and len(set(got.values())) == 256


def test_groups_are_unions_of_buckets_with_one_first_locus(spark):
    rows = [(x, b, k) for (b, k), xs in {(0, "a"): [1, 2], (1, "a"): [1, 3], (0, "b"): [3, 4], (1, "z"): [9]}.items() for x in xs]
    keyed = spark.createDataFrame(rows, "locus long, band int, key string")
    found = groups.members(keyed)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 2), (1, 3), (3, 3), (3, 4)]
    assert sorted(map(tuple, groups.all_pairs(found).collect())) == [(2, 1), (3, 1), (3, 2), (4, 3)]
    assert sorted(map(tuple, groups.all_pairs(found, block=1).collect())) == [(2, 1), (3, 1), (3, 2), (4, 3)]
    more = keyed.union(spark.createDataFrame([(1, 2, "a"), (2, 2, "a")], "locus long, band int, key string"))
    assert sorted(map(tuple, groups.distinct_buckets(groups.in_buckets(more)).collect())) == [(0, "a", 1, 1), (0, "a", 1, 2), (0, "b", 3, 3), (0, "b", 3, 4), (1, "a", 1, 1), (1, "a", 1, 3)]
    assert [(r.group_id, r.cum_pairs) for r in groups.numbered(found).orderBy("group_id").collect()] == [(1, 3), (2, 4)]
    assert sorted(map(tuple, groups.long_list(found).collect())) == [("G1", 2), ("G1", 3), ("G1", 4), ("G2", 4), ("G2", 5)]


def test_hash_similarity_nears_exact(spark):
    r = random.Random(5)
    rows = []
    for k in range(40):
        base = set(r.sample(range(2000), 400))
        rows += [(2 * k, sorted(base)), (2 * k + 1, sorted(set(list(base)[: r.randint(100, 400)]) | set(r.sample(range(2000), 20))))]
    bits = spark.createDataFrame(rows, "locus long, inds array<int>")
    exact = {(x.row, x.col): x.n_intersect / x.n_union for x in pairs.all_exact(bits, 2000).collect()}
    errors = []
    for k in (4, 64):
        p = Sketching(2000, k)
        errors.append(np.mean([abs(x.n_eq / k - exact[x.row, x.col]) for x in pairs.all_hash(sketch.sketches(bits, p), p).collect()]))
    assert errors[1] < errors[0] / 2 and errors[1] < 0.06


def test_raw_bits(spark, geno, tmp_path, counts):
    bits = binarize.binarize(geno)
    sinks.write_raw(bits, N, f"{tmp_path}/raw", parts=3)
    width = -(-N // 8)
    files = sorted(x for x in (tmp_path / "raw").iterdir() if not x.name.startswith("."))
    assert 1 < len(files) <= 3 and not list((tmp_path / "raw").glob(".tmp-*"))
    raw = b"".join(x.read_bytes() for x in files)
    assert len(raw) == LOCI * width
    rows = {r.locus: bytes(r.bytes) for r in sinks.bit_bytes(bits, N).collect()}
    for k, row in enumerate(counts):
        own = raw[k * width : (k + 1) * width]
        assert rows[k] == own
        assert [i for i in range(N) if own[i // 8] >> i % 8 & 1] == brute_bits(row, k)


def test_tables(spark, files, counts, tmp_path):
    flat = [m for row in counts for m in row]
    a, b = BinaryTable.from_bed(spark, f"{files}/x.bed", N), BinaryTable.from_counts(spark, flat, N)
    one, two = (sorted(map(tuple, t.all_pairs(cutoff=0.5).collect())) for t in (a, b))
    assert one == two and one
    a.save_log(f"{tmp_path}/log")
    assert (tmp_path / "log").read_text().splitlines() == [f"genotypes from {files}/x.bed, {N} individuals, seed 0", "all pairs, exact similarity, cut-off 0.5"]
    paths = a.write_pairs(f"{tmp_path}/chunks", 3, 0.5)
    assert sorted(map(tuple, spark.read.parquet(*paths).collect())) == one
    (tmp_path / "chunks" / "chunk-000001" / "_SUCCESS").unlink()  # as if the run had broken off there
    times = [next((tmp_path / "chunks" / f"chunk-00000{k}").glob("part-*")).stat().st_mtime_ns for k in (0, 2)]
    assert a.write_pairs(f"{tmp_path}/chunks", 3, 0.5) == paths and sorted(map(tuple, spark.read.parquet(*paths).collect())) == one
    assert times == [next((tmp_path / "chunks" / f"chunk-00000{k}").glob("part-*")).stat().st_mtime_ns for k in (0, 2)]
    p = Sketching(N, 25)
    t = SketchTable.from_bed(spark, f"{files}/x.bed", p)
    every = {tuple(r) for r in t.all_pairs(0.6).collect()}
    within = {tuple(r) for r in t.pairs_in_groups(Sparsity(5, 0.6)).collect()}
    assert within and within <= every
    assert {c for r in t.groups(5, bed.read_bim(spark, f"{files}/x.bim")).collect() for c in r.name[:2].split()} == {"rs"}
    assert t.log[-1].startswith("groups by 25 sketches, 5 rows a band: ") and t.log[-1].endswith("pairs in groups")
    assert sorted(map(tuple, spark.read.parquet(*t.write_pairs(f"{tmp_path}/more", 2, 0.6)).collect())) == sorted(every)
    t.save_log(f"{tmp_path}/log")
    assert len((tmp_path / "log").read_text().splitlines()) == len(t.log)  # the former log is replaced
    assert not BinaryTable.empty(spark).all_pairs().collect()


@pytest.mark.parametrize("more", [[], ["--hash-size", "20"], ["--hash-size", "20", "--n-rows-per-band", "4"], ["--hash-size", "20", "--n-rows-per-band", "4", "--only-groups"]])
@pytest.mark.parametrize("names", [[], ["--add-locus-names"]])
def test_command_line(spark, files, tmp_path, more, names):
    out = tmp_path / "out"
    common = ["--input-bed", f"{files}/x.bed", "--n-individuals", str(N), "--out-file", str(out), "--log-file", f"{tmp_path}/log", "--single-file", "--min-similarity", "0.5"]
    assert cli.main(common + more + names) == 0
    lines = next(out.glob("part-*.csv")).read_text().splitlines()
    assert cli.main([*common, *more, *names, "--ordered"]) == 0
    again = next(out.glob("part-*.csv")).read_text().splitlines()
    key = lambda x: tuple(int(y) if y.isdigit() else y for y in x.split("\t")[:2])
    assert sorted(again) == sorted(lines) and again[1:] == sorted(again[1:], key=key)
    if "--only-groups" in more:
        assert lines[0] == ("groupID\tname" if names else "groupID\tlocusIdx")
        return
    assert lines[0] == ("name1\tname2\tjaccard" if names else "locus1\tlocus2\tjaccard")
    assert len(lines) > 1 and all(0 <= float(x.split("\t")[2]) <= 1 for x in lines[1:])
    if not names:
        assert all(int(x.split("\t")[0]) > int(x.split("\t")[1]) for x in lines[1:])


def test_command_line_errors(spark, files, tmp_path, capsys):
    assert cli.main(["--input-bed", f"{tmp_path}/no.bed", "--n-individuals", "5"]) == 1
    assert "failed to open file" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["--n-individuals", "5"])


def test_missing_names_fall_back(spark, files, tmp_path, capsys):
    (tmp_path / "y.bed").write_bytes((files / "x.bed").read_bytes())
    out = tmp_path / "out"
    args = ["--input-bed", f"{tmp_path}/y.bed", "--n-individuals", str(N), "--out-file", str(out), "--log-file", "none", "--add-locus-names"]
    assert cli.main(args) == 0
    assert "WARNING" in capsys.readouterr().err and list(out.glob("part-*.csv"))
