import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera import session
from tessera.llm import dedup_exact, simhash, suffix
from tessera.llm.graph import components

from texts import words

SPACE = re.compile("[\x20\x09-\x0d]+")


def shingled(text, n=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


# -- exact --------------------------------------------------------------------------------------------------------


def test_exact_query(agree):
    agree(dedup_exact.op10_exact_dedup, dedup_exact.ORACLE)


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    out = []
    for t, found in groups.items():
        keep = min((x for x in found if x is not None), default=None)
        out += [(i, keep, len(found), hashlib.sha256(t.encode()).hexdigest()) for i in found]
    return sorted(out, key=str)


def test_exact_odd_rows(spark, odd, odd_rows, none):
    digested = dedup_exact.digests(odd)
    index = dedup_exact.DigestIndex(spark)
    index.add(digested)
    got = dedup_exact.resolve(digested, index).select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("h")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_exact([r[:2] for r in odd_rows])
    kept = dedup_exact.keep_first(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    texts = [SPACE.sub(" ", r.text or "") for r in rows]
    assert len(set(texts)) == len(texts) == len({SPACE.sub(" ", r[1] or "") for r in odd_rows})
    first = {}
    for i, t in ((r[0], SPACE.sub(" ", r[1] or "")) for r in odd_rows):
        first[t] = min((x for x in (first.get(t), i) if x is not None), default=None)
    assert {t: r.doc_id for t, r in zip(texts, rows)} == first
    assert dedup_exact.keep_first(none).count() == 0


def test_index_persists_over_batches(spark, tmp_path):
    make = lambda rows: dedup_exact.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    index = dedup_exact.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    index.add(make([(5, "a"), (6, "b"), (7, "a")]))
    index = dedup_exact.DigestIndex(spark, f"file://{tmp_path}/index", buckets=6)  # another session's
    index.add(make([(1, "a"), (2, "c"), (3, "c")]))
    index.add(make([]))
    got = {(r.keep_id, r.group_size) for r in index.entries().collect()}
    assert got == {(5, 3), (6, 1), (2, 2)}  # the first batch that held a text names the row that stays
    first, second, third = index.parts()
    assert (first.count(), second.count(), third.count()) == (2, 1, 0)
    plan = first.join(first.hint("merge").withColumnRenamed("keep_id", "k"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # the buckets are used
    (tmp_path / "index" / "commits" / ".tmp-crashed").write_text("{")
    assert len(index.levels()) == 3


def test_index_merges_levels(spark, tmp_path):
    """Many batches: few levels, one file a bucket, and a look-up that joins as often as there are levels."""
    index = dedup_exact.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    first, size = {}, {}
    for k in range(9):
        rows = [(100 * k + i, f"t{(7 * k + i * i) % 40}") for i in range(12)]
        for i, t in rows:
            first.setdefault(t, i)
            size[t] = size.get(t, 0) + 1
        index.add(dedup_exact.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
        assert len(index.levels()) <= 3
    assert sorted((r.keep_id, r.group_size) for r in index.entries().collect()) == sorted((first[t], size[t]) for t in first)
    for level in index.levels():
        files = [f for f in (tmp_path / "index" / "levels" / level["new"].rpartition("/")[2]).iterdir() if f.name.startswith("part")]
        assert len(files) <= level["buckets"]
    plan = dedup_exact.DigestIndex(spark, index.root).entries()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_two_writers_of_an_index(spark, tmp_path, second_writer):
    make = lambda rows: dedup_exact.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    a, b = (dedup_exact.DigestIndex(spark, f"file://{tmp_path}/index", buckets=2) for _ in "12")
    a.add(make([(1, "a")]))
    second_writer(a.commits, lambda: b.add(make([(2, "b"), (3, "c")])))
    a.add(make([(4, "b"), (5, "d")]))
    assert sorted((r.keep_id, r.group_size) for r in b.entries().collect()) == [(1, 1), (2, 2), (3, 1), (5, 1)]


# -- SimHash ------------------------------------------------------------------------------------------------------


def brute_print(text, n=3):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def brute_simhash(rows):
    prints = {i: brute_print(t) for i, t in rows}
    ids = sorted(prints)
    linked = [(a, b) for a, b in combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    named = brute_components(ids, linked)
    return {i: (f"{prints[i]:016x}", named[i]) for i in ids}


def test_simhash_query(spark, sf, rows_of):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, sf).collect()}
    assert got == brute_simhash(rows_of("documents", ["doc_id", "text"]))


def test_simhash_odd_rows(odd, odd_rows, none):
    got = simhash.link(odd).collect()
    assert len(got) == len(odd_rows)
    prints = sorted((r.doc_id, r.w0 % 2**64) for r in got if r.doc_id is not None)
    assert prints == sorted((r[0], brute_print(r[1])) for r in odd_rows if r[0] is not None)
    by_print = {}
    for i, t in (r[:2] for r in odd_rows):
        p = brute_print(t)
        by_print[p] = min((x for x in (by_print.get(p), i) if x is not None), default=None)
    nodes = {p: i for p, i in by_print.items() if i is not None}
    linked = [(nodes[a], nodes[b]) for a, b in combinations(nodes, 2) if (a ^ b).bit_count() <= 3]
    named = brute_components(set(nodes.values()), linked)
    for r in got:
        p = r.w0 % 2**64
        assert r.component_id == (named[nodes[p]] if p in nodes else None)
    assert not simhash.link(none).collect()


@pytest.mark.parametrize("bucket", [4096, 64])
def test_exact_links_of_any_bucket_size(spark, bucket):
    """Small buckets force the finer rounds; components must be those of all pairs."""
    r = random.Random(bucket)
    prints = {0, (1 << 64) - 1}
    for size, bits in ((110, range(8, 20)), (20, range(64)), (20, range(64)), (20, range(40, 60))):
        center = r.getrandbits(64)
        for _ in range(size):
            p = center
            for b in r.sample(list(bits), r.randint(0, 5)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    rows = [(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)]
    got = components(simhash.exact_links(spark.createDataFrame(rows, "node long, w0 long"), limit=bucket))
    linked = [(a, b) for a, b in combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    named = brute_components(range(len(prints)), linked)
    seen = {r.node: r.component_id for r in got.collect()}
    assert {k: seen.get(k, k) for k in range(len(prints))} == named


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_pigeonhole_keys_meet(distance):
    r = random.Random(distance)
    masks = simhash._masks(simhash.BLOCKS, 2)
    assert len(masks) == 10
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), distance):
            b ^= 1 << k
        assert any(a & m == b & m for m in masks)
        m = next(m for m in masks if a & m == b & m)
        while m.bit_count() < 52:  # down to twelve free bits
            m = next(x for x in simhash._finer(m) if a & x == b & x)


def test_components_of_a_long_path(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    path = spark.createDataFrame(list(zip(ids, ids[1:])) + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r.node: r.component_id for r in components(path).collect()}
    assert got == {i: 0 for i in ids} | {1000: 1000, 1001: 1000}
    assert components(path.filter("false")).count() == 0


def test_near_copies(spark):
    r = random.Random(6)
    rows, groups = [], {}
    for g in range(25):
        base = words(r, 400).split()
        groups[g * 10] = g
        rows.append((g * 10, " ".join(base)))
        for k in range(1, 4):  # three words changed: over 0.9 of the shingles are common
            t = list(base)
            for at in r.sample(range(len(t)), 3):
                t[at] = "changed" + str(r.random())
            rows.append((g * 10 + k, " ".join(t)))
    rows += [(1000 + k, words(r, 300)) for k in range(100)]  # clean ones
    half = words(r, 200)
    rows += [(2000 + k, half + " " + words(r, 200)) for k in range(10)]  # a third of the shingles in common
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id for x in simhash.one_of_each(docs).collect()}
    assert kept == {i for i, _ in rows if i >= 1000 or i % 10 == 0}


def test_near_copies_in_large_buckets(spark):
    """One bucket in parts: a group far larger than a part stays one group."""
    r = random.Random(9)
    base = words(r, 800).split()
    rows = []
    for k in range(120):
        t = list(base)
        for at in r.sample(range(800), 2):
            t[at] = f"x{r.random()}"
        rows.append((k, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.component_id for x in simhash.near_groups(docs, limit=16).collect()} == {0}


def test_small_tables_of_near_groups_are_one_file(spark):
    """However many shuffle partitions there are: only texts are as many files as the tasks that move them."""
    r = random.Random(10)
    bases = [words(r, 300).split() for _ in range(6)]
    rows = [(20 * g + k, " ".join(f"x{r.random()}" if r.random() < 0.04 * (k > 0) else w for w in t)) for g, t in enumerate(bases) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    session.clean(spark)
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesced)
    spark.conf.set(coalesced, "false")
    try:
        found = {x.doc_id: x.component_id for x in simhash.near_groups(docs).collect()}
    finally:
        spark.conf.set(coalesced, before)
    sets = {i: shingled(t) for i, t in rows}
    assert len(set(found.values())) > 6
    for (a, x), (b, y) in combinations(sets.items(), 2):  # no group is joined by less than its links
        if jaccard(x, y) >= 0.9:
            assert found[a] == found[b]
    files = {}
    for path in session.written():
        kind = path.rpartition("/")[2].rpartition("-")[0]
        files[kind] = max(files.get(kind, 0), len(spark.read.parquet(path).inputFiles()))
    assert {"wide", "classes", "met", "tried", "first", "ids", "links", "joins", "parts", "named"} <= set(files)
    assert not {k: n for k, n in files.items() if n > 1 and k != "texts"}


@pytest.mark.parametrize("cell", [3, 256])
def test_doubtful_groups_lose_no_link(spark, cell):
    """Versions around the likeness: links connect what all pairs would, and are as few as a forest has."""
    r = random.Random(cell)
    rows, base = [], [f"w{r.random()}" for _ in range(120)]
    for k in range(40):
        t = list(base)
        for _ in range(r.randint(0, 3)):
            at = r.randrange(110)
            t[at : at + 2] = [f"w{r.random()}" for _ in range(2)]
        rows.append((k, " ".join(t)))
    classes = spark.createDataFrame([(0, k if k % 5 else 0, k, 0) for k in range(40)], "group long, part long, node long, w0 long")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = [(x.u, x.v) for x in simhash.within(classes, docs, 5, 0.8, 64, 1, cell).collect()]
    sets = {k: shingled(t) for k, t in rows}
    alike = [(a, b) for a, b in combinations(range(40), 2) if jaccard(sets[a], sets[b]) >= 0.8]
    same = [(0, k) for k in range(0, 40, 5)]
    assert 0 < len(alike) < 600 and set(map(tuple, map(sorted, links))) <= set(alike)
    assert brute_components(range(40), links + same) == brute_components(range(40), alike + same)
    assert cell == 3 or len(links) < 40


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Parts of two classes and batches of one row: components of sets that have the likeness are those of all pairs."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    r = random.Random(19)
    rows = []
    for g in range(3):  # chains of versions: only neighbours are alike
        t = [f"w{r.random()}" for _ in range(300)]
        for k in range(12):
            at = r.randrange(290)
            t[at : at + 8] = [f"w{r.random()}" for _ in range(8)]
            t[0:3] = ["same", "first", "words"]
            rows.append((100 * g + k, " ".join(t)))
    try:
        got = {x.doc_id: x.component_id for x in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), limit=2).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {i: i // 100 * 100 for i, _ in rows}


@pytest.mark.parametrize("limit", [8, 64, 4096])
def test_a_chain_longer_than_a_bucket_is_one_group(spark, limit):
    """Successive versions in one bucket, each 20 bits from the one before: only near neighbours are within the distance."""
    r = np.random.default_rng(limit)
    bits, rows = r.integers(0, 2, 512, np.uint8), []
    for k in range(200):
        bits[r.choice(512, 20, replace=False)] ^= 1
        rows.append((0, 7, k, *np.packbits(bits, bitorder="little").view("i8").tolist()))
    r.shuffle(rows)
    names = [f"w{k}" for k in range(8)]
    docs = spark.createDataFrame([tuple(map(int, x)) for x in rows], ", ".join(f"{c} long" for c in ("mask", "key", "node", *names)))
    within, large = simhash.part_links(docs, 8, 30, limit)
    assert (large is None) == (limit == 4096)
    links = [(x.u, x.v) for x in within.collect()]
    if large is not None:
        labels = components(spark.createDataFrame(links, "u long, v long")).withColumnRenamed("component_id", "part")
        rest = [(x.u, x.v) for x in simhash.rest_links(large, labels, 8, 30, limit).collect()]
        named = brute_components(range(200), links)
        assert rest and all(named[a] != named[b] for a, b in rest)
        links += rest
    assert brute_components(range(200), links) == dict.fromkeys(range(200), 0)


def test_a_repeated_line_does_not_make_copies(spark):
    r = random.Random(4)
    line = words(r, 11)
    rows = [(k, " ".join([line] * 60 + [words(r, 205)])) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert max(jaccard(shingled(a), shingled(b)) for (_, a), (_, b) in combinations(rows, 2)) < 0.1
    assert simhash.one_of_each(docs).count() == 4
    copy = spark.createDataFrame([(9, rows[0][1] + f" {line}" * 300)], "doc_id long, text string")  # the line more often: hardly another set
    assert {x.doc_id for x in simhash.one_of_each(docs.union(copy)).collect()} == {0, 1, 2, 3}


def test_near_groups_are_judged_by_their_sets(spark):
    """Pairs just over and just under the similarity, whatever their fingerprints."""
    r = random.Random(8)
    rows, groups = [], {}
    for k in range(150):
        base = [f"v{r.random()}" for _ in range(300)]
        other = [f"v{r.random()}" for _ in range(r.randint(16, 130))]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: len(base) - len(other) // 2] + other[: len(other) // 2]))]
        groups[k] = jaccard(shingled(rows[-1][1]), shingled(rows[-2][1]))
    found = {x.doc_id: x.component_id for x in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {k for k in groups if found[2 * k + 1] == 2 * k}
    assert not {k for k in linked if groups[k] < 0.8}
    over = {k for k in groups if groups[k] >= 0.8}
    assert len(over - linked) <= 0.05 * len(over) and len(over) < 140


def test_blocks_widen_with_the_corpus():
    assert simhash.layout(0, 0.8) == simhash.layout(230_000, 0.8) == simhash.layout(1 << 26, 0.8) == (40, 16)
    for n in (10**9, 10**10, 10**12):
        blocks, width = simhash.layout(n, 0.8)
        assert n / 2**width <= simhash.SPARSE and width <= 32
        assert 1 - (1 - (1 - simhash.differing(0.8)) ** width) ** blocks > 0.945


@pytest.mark.parametrize("width", [16, 21, 32])
def test_keys_are_bits_of_the_fingerprint(spark, width):
    r = random.Random(width)
    words_ = [r.getrandbits(64) for _ in range(12)]
    whole = sum(w << 64 * k for k, w in enumerate(words_))
    df = spark.createDataFrame([tuple(w - (1 << 64) if w >> 63 else w for w in words_)], ", ".join(f"w{k} long" for k in range(12)))
    got = df.select(*[simhash._cut(b * width, width).alias(f"k{b}") for b in range(768 // width)]).first()
    assert list(got) == [whole >> b * width & (1 << width) - 1 for b in range(768 // width)]


def test_recall_by_tenths(spark):
    """Of pairs at a likeness of 0.8 and more, the share that is found, by steps of the likeness; no pair under it."""
    r = random.Random(14)
    rows, likeness = [], {}
    for k in range(700):
        n = 300
        base = [f"v{r.random()}" for _ in range(n)]
        j = r.uniform(0.74, 1.0)
        cut = round((n - 4) * (1 - j) / (1 + j))  # shingles that either has alone
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: n - cut] + [f"v{r.random()}" for _ in range(cut)]))]
        likeness[k] = jaccard(shingled(rows[-1][1]), shingled(rows[-2][1]))
    found = {x.doc_id: x.component_id for x in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = {k: found[2 * k + 1] == 2 * k for k in likeness}
    assert not [k for k in hit if hit[k] and likeness[k] < 0.8]
    for low, high, least in ((0.8, 0.82, 0.87), (0.82, 0.85, 0.93), (0.85, 0.9, 0.97), (0.9, 1.01, 1.0)):
        some = [hit[k] for k, j in likeness.items() if low <= j < high]
        assert len(some) > 30 and np.mean(some) >= least, (low, np.mean(some), len(some))
    assert np.mean([hit[k] for k, j in likeness.items() if j >= 0.8]) >= 0.95


def test_near_odd_rows(odd, odd_rows, none):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(x.doc_id) for x in kept.collect())
    gone = {20, 21, 22, 23, 30, 31, 32, 33}  # copies of 0 to 3
    assert ids == sorted(str(r[0]) for r in odd_rows if r[0] not in gone)
    assert simhash.one_of_each(none).count() == 0


# -- suffix arrays ------------------------------------------------------------------------------------------------


def brute_suffix(rows):
    first, data = {}, [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: (i is None, i)
    for i, b in data:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            if w not in first or rank(i) < rank(first[w]):
                first[w] = i
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if rank(first[b[p : p + 50]]) < rank(i):
                gone[p : p + 50] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_suffix_query(spark, sf, rows_of):
    got = sorted((tuple(r) for r in suffix.op8_suffix_dedup(spark, sf).collect()), key=str)
    assert got == brute_suffix(rows_of("documents", ["doc_id", "text"]))


def test_suffix_query_in_sql(agree):
    agree(suffix.op8_suffix_dedup, suffix.ORACLE)


def test_suffix_odd_rows(odd, odd_rows, none):
    got = sorted((tuple(r) for r in suffix.removals(odd).collect()), key=str)
    assert got == brute_suffix([r[:2] for r in odd_rows])
    done = suffix.without_repeats(odd)
    assert done.columns == odd.columns and done.count() == len(odd_rows)
    assert {r.lang for r in done.collect()} == {r[2] for r in odd_rows}
    assert not suffix.removals(none).collect() and not suffix.without_repeats(none).collect()
    named = odd.select("doc_id", "text", F.lit(1).alias("a b"), F.array(F.struct(F.lit("x").alias("c.d"))).alias("e;f")).limit(5)
    done = suffix.without_repeats(named)
    assert done.columns == named.columns and done.dtypes == named.dtypes and done.count() == 5


def test_suffix_one_anchor_with_many_surroundings(spark):
    """A passage between ever new words: more different stretches of one anchor than are compared in one shard."""
    r = random.Random(21)
    passage = words(r, 6)[:34]
    rows = [(k, f"{words(r, 3)[-9:]}{k % 7}{passage}{k % 11}{words(r, 3)[:9]}") for k in range(3 * suffix.MANY // 2)]
    assert len({t for _, t in rows}) > suffix.MANY
    rows += [(1000 + k, "x" * (k % 40) + rows[k][1] + "y" * (k % 30)) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x) for x in suffix.removals(docs).collect()), key=str)
    assert got == brute_suffix(rows) and sum(x[2] for x in got) > 1000


def test_suffix_few_letters(spark):
    """Strings with many repeats, zero bytes, periods, and texts around the window's length and the hashing step."""
    r = random.Random(12)
    rows = []
    for k in range(60):
        kind = k % 4
        if kind == 0:
            t = "".join(r.choice("ab") for _ in range(r.randint(0, 300)))
        elif kind == 1:
            t = r.choice("ab\0") * r.randint(48, 120)
        elif kind == 2:
            t = ("abc" * 40)[: r.randint(40, 110)] + "\0" * r.randint(0, 60)
        else:
            t = rows[r.randrange(len(rows))][1][r.randint(0, 5) :] + "é" * r.randint(0, 40)
        rows.append((r.randrange(40), t))
    rows += [(100, words(r, 60_000)), (101, words(r, 100))]
    rows.append((102, rows[-2][1][200_000:330_000] + words(r, 50)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in suffix.removals(docs).collect()), key=str) == brute_suffix(rows)


def test_index_over_batches(spark, tmp_path):
    """Batches in any order of ids: what an earlier batch holds counts as smaller; levels merge when they are of equal size."""
    r = random.Random(31)
    root, sizes, rows, got = f"file://{tmp_path}/index", [], [], []
    passages = [words(r, 25) for _ in range(12)]
    for k in range(6):
        batch = [(r.randrange(50), f"{words(r, 12)} {r.choice(passages)[r.randint(0, 30):]} {words(r, 12)} {r.choice(passages)}") for _ in range(15)] + [(None, passages[k])]
        index = suffix.SuffixIndex(spark, root, size=200_000)  # another session's
        blocks, known = index.add(spark.createDataFrame(batch, "doc_id long, text string").repartition(3))
        kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        done = blocks.select("block", "doc_id", "text").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(suffix._tidied(suffix._finish(whole=False)), kind)
        got += [(k, *x) for x in done.collect()]
        rows += [((k, i is None, i), t) for i, t in batch]
        sizes.append([x["size"] for x in index.levels()])
        assert all(a > suffix.EQUAL * b for a, b in zip(sizes[-1], sizes[-1][1:]))  # geometric
    assert [len(x) for x in sizes] == [1, 1, 2, 1, 2, 2]
    wanted = sorted(((i[0], i[2], *x) for i, *x in brute_suffix(rows)), key=str)
    assert sorted(got, key=str) == wanted and sum(x[3] for x in got) > 5000
    index.vacuum()
    stored = [f for f in (tmp_path / "index").rglob("part-*") if "kind=2" in f.parts]
    assert {f.parent.parent.parent.name for f in stored} == {x["path"].split("/")[-3] for x in index.levels()}  # merged ones are gone


def test_a_batch_is_added_once(spark, tmp_path):
    passage = "a passage of more than fifty bytes that is delivered again and again"
    docs = spark.createDataFrame([(1, passage, "x"), (2, "0" + passage, None)], "doc_id long, text string, more string")
    index = suffix.SuffixIndex(spark, f"file://{tmp_path}/index")
    for k in range(2):
        blocks, known = index.add(docs, "monday")
        schema = blocks.select("doc_id", "text", "rest").schema
        done = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(suffix._tidied(suffix._finish(whole=True)), schema)
        assert sorted((x.doc_id, x.text, x.rest.more) for x in done.collect()) == [(1, passage, "x"), (2, "0", None)]
        index = suffix.SuffixIndex(spark, f"file://{tmp_path}/index")  # another session delivers the batch again
        assert len(index.levels()) == 1


def test_two_writers_of_a_suffix_index(spark, tmp_path, second_writer):
    make = lambda i, t: spark.createDataFrame([(i, t)], "doc_id long, text string")
    a, b = (suffix.SuffixIndex(spark, f"file://{tmp_path}/index") for _ in "12")
    passage, removed = "x" * 30 + "passage that both writers have, of more than fifty bytes", {}
    second_writer(a.commits, lambda: removed.update(b=b.add(make(7, passage))))
    removed["a"] = a.add(make(1, "0" + passage))
    for name, (blocks, known) in removed.items():
        kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        done = blocks.select("block", "doc_id", "text").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(suffix._tidied(suffix._finish(whole=False)), kind)
        assert done.first().n_removed == (len(passage) if name == "a" else 0)  # the slower scans what the other brought


@pytest.mark.parametrize("doc", [None, 5])
def test_suffix_one_id_for_all_rows(spark, monkeypatch, doc):
    """Rows of one id, or of none, keep what they share, and lie in blocks of bounded size like any others."""
    monkeypatch.setattr(suffix, "BLOCK", 1 << 12)
    monkeypatch.setattr(suffix, "SPARSE", 1)
    r = random.Random(2)
    passage = words(r, 20)
    rows = [(doc, f"{words(r, 20)} {passage} {words(r, 20)}") for _ in range(60)]
    other = [(9, f"{words(r, 3)} {passage[3:]} z")]
    docs = spark.createDataFrame(rows + other, "doc_id long, text string").repartition(4)
    assert sorted((tuple(x) for x in suffix.removals(docs).collect()), key=str) == brute_suffix(rows + other)
    kept = [b for b, _ in suffix._search(docs)]
    sizes = [x.n for b in kept for x in b.groupBy("block").agg(F.sum(F.length("text")).alias("n")).collect()]
    assert len(sizes) >= 4 and max(sizes) < (1 << 12) + 1000


def test_blocks_are_written_where_they_are_read(spark):
    """One file a task, and Spark finds each block in the bucket that its task has written."""
    docs = spark.createDataFrame([(k, words(random.Random(k), 50)) for k in range(100)], "doc_id long, text string").repartition(13)
    index = suffix.SuffixIndex(spark, size=100 << 20)
    blocks, _ = index.add(docs)
    files = blocks.select(F.input_file_name().alias("f"), "block").distinct().collect()
    assert len({x.f for x in files}) <= 13
    for x in files:
        bucket = int(re.search(r"_(\d+)\.c", x.f)[1])
        assert spark.range(1).select(F.pmod(F.hash(F.lit(x.block).cast("long")), F.lit(index.buckets))).first()[0] == bucket
    plan = blocks.select("block", "text").groupBy("block").agg(F.count("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and blocks.count() == 100


def test_batches_make_few_files(spark, tmp_path):
    """A batch of many small parts is written by few tasks, one file each and kind, and nothing of it is lost."""
    r = random.Random(41)
    passage = words(r, 30)
    rows = [[(100 * k + i, f"{words(r, 8)} {passage} {words(r, 8)}") for i in range(40)] for k in range(2)]
    index, got = suffix.SuffixIndex(spark, f"file://{tmp_path}/index", size=100 << 20), []
    for batch in rows:
        blocks, known = index.add(spark.createDataFrame(batch, "doc_id long, text string").repartition(13))
        done = blocks.select("block", "doc_id", "text").groupBy("block").cogroup(known.groupBy("block"))
        kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        got += done.applyInArrow(suffix._tidied(suffix._finish(whole=False)), kind).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_suffix(rows[0] + rows[1])
    n = max(8 // suffix.BATCHES, 4)
    assert index.buckets == n
    files = {}
    for f in (tmp_path / "index").rglob("part-*"):
        files[f.parent] = files.get(f.parent, 0) + 1
    assert len(files) >= 5 and all(v <= n * (1 + (d.parent.name == "known")) for d, v in files.items())


@pytest.mark.parametrize("collide", [False, True])
def test_windows_are_compared_as_bytes(monkeypatch, collide):
    r = random.Random(collide)
    if collide:
        monkeypatch.setattr(suffix, "_hashed", lambda wins: (wins[:, 0] & 1).astype(np.uint64))
    data = ["".join(r.choice("ab\0") for _ in range(3)).rjust(r.choice([50, 52, 75]), "x").encode() for _ in range(200)]
    docs = [r.choice([r.randrange(20), suffix.FIRST]) for _ in data]
    wins, row, bit = suffix.windows(suffix.pa.array([b"?", *(b"\0" + d for d in data)], suffix.pa.binary())[1:])
    texts = [data[i][k : k + 50] for i, k in zip(row, bit)]
    assert [bytes(w) for w in wins] == texts and len(texts) == sum(len(d) - 49 for d in data)
    least = {}
    for t, i in zip(texts, row):
        least[t] = min(least.get(t, docs[i]), docs[i])
    assert suffix.earlier(wins, np.array(docs)[row]).tolist() == [least[t] < docs[i] for t, i in zip(texts, row)]
