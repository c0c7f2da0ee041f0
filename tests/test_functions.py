import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import murmur, rng, similarity
from tessera.operators import matrix, ranges, sketch
from tessera.params import Sketching, Sparsity, check_counts

# Keys whose hashes, quantized similarities, ranges and bounds below are known.
SEED = 2153025618
INDEXES = [2437, 2444, 41116, 42353, 45949, 58374, 75248, 80113, 93649, 98640, 99638]
WORDS = [1256, 2117, 2866, 7434, 11737, 16256, 22236, 39883, 40023, 46299, 58123, 58167, 62187]


def test_murmur_golden():
    assert murmur.of_key((335636695, 4242517348), SEED) == 2730141477
    assert murmur.of_indexes(INDEXES, SEED) == 2643649892
    assert murmur.of_window(WORDS, 4, 5, SEED) == 3760365877
    assert murmur.of_window(WORDS, 0, 13, SEED) == 2280422248


@given(st.integers(0, 2**16 - 1), st.integers(0, 3))
def test_murmur_window_sees_only_the_window(value, at):
    changed = list(WORDS)
    changed[at] = value
    assert murmur.of_window(changed, 4, 5, SEED) == murmur.of_window(WORDS, 4, 5, SEED)


@given(st.integers(0, 2**32 - 1))
def test_murmur_sees_low_bits_of_indexes(x):
    assert murmur.of_indexes([x], SEED) == murmur.of_indexes([x & 0xFFFF], SEED)
    assert murmur.of_u32([x, 5], SEED) == murmur.of_u32([x & 0xFFFF, 5], SEED)


def test_murmur_columns(spark):
    keys = [(0, 0), (335636695, 4242517348), (2**32 - 1, 2**32 - 1)]
    df = spark.createDataFrame(keys, "lo long, hi long")
    for name, c in murmur.murmur_steps(F.col("lo"), F.col("hi"), SEED):
        df = df.withColumn(name, c)
    assert [r.hash for r in df.orderBy("lo").collect()] == [murmur.of_key(k, SEED) for k in sorted(keys)]


def test_murmur_columns_of_vectors(spark):
    rng_ = np.random.default_rng(3)
    rows = [INDEXES, WORDS, [], [7], [70000, 2**33 + 5], *(rng_.integers(0, 2**40, n).tolist() for n in (3, 4, 9, 16))]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x array<bigint>")
    x = F.col("x")
    got = df.orderBy("k").select(murmur.indexes(x, SEED).alias("i"), murmur.u32(x, SEED).alias("u"), murmur.window(x, 4, 5, SEED).alias("w"), murmur.window(x, 0, 13, SEED).alias("v")).collect()
    for r, own in zip(got, rows):
        assert tuple(r) == (murmur.of_indexes(own, SEED), murmur.of_u32(own, SEED), murmur.of_window(own, 4, 5, SEED), murmur.of_window(own, 0, 13, SEED))
    assert got[0].i == 2643649892 and (got[1].w, got[1].v) == (3760365877, 2280422248)


def test_random_choices_agree(spark):
    row = spark.range(1).select(rng.h32("het", 3, F.lit(5), F.lit(7)).alias("x")).first()
    assert row.x == rng.h32_of("het", 3, 5, 7)
    assert sorted(rng.permutation(70, 1)) == list(range(70))
    assert not np.array_equal(rng.permutation(70, 1), rng.permutation(70, 2))


def test_quantize_golden(spark):
    pairs = [(21, 101), (81, 254), (164, 502), (551, 1001), (16, 35), (8, 11), (2, 5), (89, 234), (44, 51)]
    wanted = "0.2078 0.3176 0.3255 0.5490 0.4549 0.7255 0.4000 0.3765 0.8627".split()
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, i long, u long")
    got = df.orderBy("k").select(similarity.printed(similarity.quantized(F.col("i"), F.col("u"))).alias("s")).collect()
    assert [r.s for r in got] == wanted


def test_bad_pairs(spark):
    bad = lambda *row: matrix.valid(spark.createDataFrame([row], "row long, col long, n_intersect long, n_union long")).collect()
    for row, text in (((3, 3, 1, 2), "must be different"), ((2, 1, 0, 0), "cannot be 0"), ((2, 1, 5, 2), "larger than union")):
        with pytest.raises(Exception, match=text):
            bad(*row)
    assert bad(1, 4, 1, 2)[0].row == 4


def test_far_triangle(spark):
    rows = [(1, 0), (40005, 30005), (379625062, 5), (1_000_000_000, 999_999_999)]
    df = spark.createDataFrame(rows, "r long, c long").withColumn("v", similarity.rank(F.col("r"), F.col("c")))
    row, col = similarity.unrank(F.col("v"))
    assert sorted(tuple(x) for x in df.select(row, col).collect()) == sorted(rows)


def test_ranges(spark):
    assert ranges.thread_ranges(4, 13) == [(0, 13), (13, 26), (26, 39), (39, 52)]
    sizes = lambda n, c: [r["size"] for r in ranges.chunk_sizes(spark, n, c).orderBy("chunk").collect()]
    assert sizes(35, 4) == [9, 9, 9, 8] and sizes(3, 4) == [1, 1, 1, 0]
    bounds = lambda n, c: [tuple(r)[1:] for r in ranges.chunk_ranges(spark, 0, n, c).orderBy("chunk").collect()]
    assert bounds(35, 4) == [(1, 0, 4, 3), (4, 3, 6, 3), (6, 3, 7, 6), (7, 6, 8, 7)]
    assert bounds(3, 4) == [(1, 0, 2, 0), (2, 0, 2, 1), (2, 1, 3, 0), (3, 0, 3, 0)]
    groups = spark.createDataFrame([(1, 21, 21), (2, 10, 31), (3, 55, 86)], "group_id long, n_pairs long, cum_pairs long")
    assert tuple(ranges.group_range_end(groups, 2, 2, 12).first()) == (3, 4)
    assert tuple(ranges.group_range_end(groups, 2, 2, 10**6).first()) == (3, 55)


def test_matrix_merge_is_left_biased(spark):
    make = lambda rows: spark.createDataFrame(rows, "row long, col long, q int")
    a, b = make([(2, 1, 5), (3, 0, 6)]), make([(2, 1, 9), (4, 0, 7)])
    got = lambda x, y: sorted(map(tuple, matrix.merged(x, y).collect()))
    assert got(a, b) == [(2, 1, 5), (3, 0, 6), (4, 0, 7)]
    assert got(b, a) == [(2, 1, 9), (3, 0, 6), (4, 0, 7)]
    assert got(a, a) == got(a, make([])) == got(make([]), a) == [(2, 1, 5), (3, 0, 6)]


@given(st.integers(3, 24), st.data())
def test_densify_is_one_fill_a_round(k, data):
    row = data.draw(st.lists(st.integers(-1, 9), min_size=k, max_size=k))
    wanted, filled, t = list(row), [i for i, v in enumerate(row) if v >= 0], 0
    while filled and min(wanted) < 0:
        for i in filled:
            j = rng.fill_targets(k, t, 0)[i]
            if wanted[j] < 0:
                wanted[j] = row[i]
                break
        t += 1
    assert sketch.densify(np.array([row, row]), 0).tolist() == [wanted, wanted]


def test_parameters():
    with pytest.raises(ValueError, match="^ERROR: number of individuals must be greater than 1"):
        Sketching(1, 3)
    with pytest.raises(ValueError, match="^ERROR: sketch number must be at least three"):
        Sketching(10, 2)
    with pytest.raises(ValueError, match="^ERROR: sketch number"):
        Sketching(10, 11)
    with pytest.raises(ValueError, match="^ERROR: sketch number"):
        Sketching(100_000, 65535)
    with pytest.raises(ValueError, match="^ERROR: empty vector of minor allele counts"):
        check_counts(0, 5)
    with pytest.raises(ValueError, match="^ERROR: length of allele count vector"):
        check_counts(13, 5)
    for rows in (0, 8):
        with pytest.raises(ValueError, match="^ERROR: number of rows per band"):
            Sparsity(rows).check(8)
