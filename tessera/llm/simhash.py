"""SimHash near-dedup by pigeonhole blocks.

A fingerprint bit is set if it is set in more than half of a text's shingle hashes. Equal fingerprints are one class.
Fingerprints are split into blocks such that a close pair agrees in some key made of blocks; classes meet on such keys,
and each bucket gives a spanning forest of its pairs within the distance, never all pairs.

Exact links (``exact_keys``): of five blocks of 64 bits, at most three can hold the three differing bits, so that two
blocks agree; the ten pairs of blocks are the keys, of about 26 bits. A bucket above ``BUCKET`` classes is not gathered:
its rows go on to another round, where the bits that the key leaves free are split into four and, again, one part must
agree. The free bits shrink from round to round; twelve free bits hold no more than ``BUCKET`` classes.

Likeness (``wide``): shingle sets of Jaccard similarity s differ in a share p = acos(2s / (1 + s)) / pi of the bits. A
fingerprint of 640 bits in 40 blocks of 16 shares a block with chance 1 - (1 - (1 - p) ** 16) ** 40, 0.95 at s = 0.8
and 0.99 at 0.85; the first 512 bits are then compared, and pairs that may have the similarity are judged by their
shingle sets. Several hundred bits are needed since 64 cannot tell 0.8. Blocks widen with the number of documents, and
their number with their width (``layout``), so that unlike documents do not fill the buckets of a large corpus.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import files_for, partitions, prepare, row_hashes, stored, table, texts, tidy
from .graph import components

SEED = 42
#: Classes of one bucket that are compared in one task.
BUCKET = 4096
#: Documents that a bucket of unlike ones holds on average, at most, and the share of pairs at the similarity that meet.
SPARSE = 1024
MEET = 0.95
#: Standard deviations above the mean distance of a similarity up to which a pair is a candidate.
DEVIATIONS = 3
#: Blocks of a 64-bit fingerprint, as (first bit, bits).
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
FULL = (1 << 64) - 1
SPREAD = 0x9E3779B97F4A7C15


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of the space-joined shingles of lower-cased (A-Z) words, repeats included; fewer words: the whole sequence."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), "i8", len(found)) + 1)
    starts = np.append(0, ends[:-1])[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash derived from h; the first is h itself."""
    if not k:
        return h
    x = h ^ np.uint64(SPREAD * k & FULL)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def majority(h: np.ndarray, longs: int = 1) -> np.ndarray:
    """Bits set in over half of the hashes, as ``longs`` unsigned 64-bit numbers; no hashes: zero."""
    if not len(h):
        return np.zeros(longs, np.uint64)
    data = np.stack([mixed(h, k) for k in range(longs)], axis=1).view(np.uint8).reshape(len(h), -1)
    if len(h) < 64 or longs == 1:
        counts = np.zeros(data.shape[1] * 8, np.int64)
        for part in range(0, len(data), 4096):
            counts += np.unpackbits(data[part : part + 4096], axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        width = data.shape[1]
        seen = np.zeros(width * 256, np.int64)
        for part in range(0, len(data), 4096):
            at = data[part : part + 4096] + (np.arange(width, dtype=np.int64) << 8)
            seen += np.bincount(at.ravel(), minlength=width * 256)
        counts = (seen.reshape(width, 256).astype(np.float32) @ _BITS).ravel()
    return np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, words: int = 3, longs: int = 1, *keep: str, distinct: bool = False) -> DataFrame:
    """``doc_id, w0 ...`` (signed longs that hold the fingerprint's bits) of every whole text, and BIGINT columns ``keep``.

    Null texts count as empty; ids are passed through. With ``distinct``, a shingle counts once in a text, and another
    long behind the fingerprint's is a hash of the text's shingle set.
    """
    prepare(docs.sparkSession)
    names = [f"w{k}" for k in range(longs + distinct)]

    def bits(text: str) -> np.ndarray:
        if not distinct:
            return majority(shingle_hashes(text, words), longs)
        own = np.unique(shingle_hashes(text, words))
        return np.append(majority(own, longs), np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([bits(t) for t in batch.column("text").to_pylist()], np.uint64).reshape(-1, len(names)).view("i8")
            own = [batch.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, prints.T.copy())], ["doc_id", *keep, *names])
        tidy()

    return texts(docs, *keep).mapInArrow(run, ", ".join(f"{n} long" for n in ("doc_id", *keep, *names)))


def _masks(blocks: list[tuple[int, int]], agree: int) -> list[int]:
    return [sum((1 << n) - 1 << at for at, n in chosen) for chosen in combinations(blocks, agree)]


def _finer(mask: int) -> list[int]:
    """Masks that each add a fourth of the bits that ``mask`` leaves free: one fourth holds none of three differing bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k::4]) for k in range(4)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(nodes: np.ndarray, prints: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of the pairs within ``distance``."""
    while len(nodes) > 1:
        grown, nodes, prints = [(nodes[0], prints[0])], nodes[1:], prints[1:]
        while grown and len(nodes):
            node, own = grown.pop()
            near = np.bitwise_count(prints ^ own).sum(1, dtype=np.int64) <= distance
            if near.any():
                yield np.full(int(near.sum()), node), nodes[near]
                grown += zip(nodes[near], prints[near], strict=True)
                nodes, prints = nodes[~near], prints[~near]


def _nearest(nodes: np.ndarray, prints: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a least spanning forest of the pairs within ``distance``: each tree grows by its nearest class."""
    n = len(nodes)
    if n <= 64:
        near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2, dtype=np.int64) <= distance
        if near.sum() == n:
            return
        some = near.sum(1) > 1
        nodes, prints = nodes[some], prints[some]
        n = len(nodes)
    nodes, prints = nodes.copy(), prints.copy()
    least, of = np.full(n, np.iinfo("i8").max), np.zeros(n, "i8")
    u, v = [], []
    while n > 1:
        n -= 1
        node, own = int(nodes[n]), prints[n].copy()
        now = np.bitwise_count(prints[:n] ^ own).sum(1, dtype=np.int64)
        closer = now < least[:n]
        least[:n][closer], of[:n][closer] = now[closer], node
        k = int(least[:n].argmin())
        if least[k] <= distance:
            u.append(of[k])
            v.append(nodes[k])
        # the chosen class is the next to go, from the end
        for x in (nodes, prints, least, of):
            x[[k, n - 1]] = x[[n - 1, k]]
    if u:
        yield np.array(u, "i8"), np.array(v, "i8")


def _between(nodes: np.ndarray, prints: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of every two labels (the last long but one) of side 0 and side 1 (the last) the nearest pair within ``distance``."""
    label, side, prints = prints[:, -2], prints[:, -1], prints[:, :-2]
    others = np.flatnonzero(side == 1)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k in np.flatnonzero(side == 0):
        there = others[label[others] != label[k]]
        far = np.bitwise_count(prints[there] ^ prints[k]).sum(1, dtype=np.int64)
        near = np.flatnonzero(far <= distance)
        near = near[np.argsort(far[near], kind="stable")]
        for j in near[np.unique(label[there[near]], return_index=True)[1]]:
            pair = (int(label[k]), int(label[there[j]]))
            best[pair] = min(best.get(pair, (distance + 1, 0, 0)), (int(far[j]), int(nodes[k]), int(nodes[there[j]])))
    if best:
        _, u, v = np.array(list(best.values()), "i8").T
        yield u, v


def _meet(rows: DataFrame, longs: int, distance: int, limit: int | None = BUCKET, forest: Callable = _forest) -> DataFrame:
    """Rows ``mask, key, node, w0 ...`` meet on mask and key: ``u, v`` are links; rows with null ``v`` are of large buckets.

    Without a ``limit`` no bucket is large.
    """
    names = [f"w{k}" for k in range(longs)]
    prepare(rows.sparkSession)
    n = partitions(rows.sparkSession)
    limit = limit or sys.maxsize
    rows = rows.repartition(n, "mask", "key").sortWithinPartitions("mask", "key")
    schema = ", ".join(["u long", "v long", "mask long", "key long", *(f"{w} long" for w in names)])

    def out(u: np.ndarray, v: np.ndarray | None, mask: int = 0, key: int = 0, prints: np.ndarray | None = None) -> pa.RecordBatch:
        empty = pa.nulls(len(u), pa.int64())
        own = [pa.array(u), empty if v is None else pa.array(v), *(pa.array(np.full(len(u), x, "i8")) for x in (mask, key))]
        own += [empty] * longs if prints is None else [pa.array(p) for p in prints.view("i8").T.copy()]
        return pa.RecordBatch.from_arrays(own, ["u", "v", "mask", "key", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, large = None, False
        nodes, prints = np.empty(0, "i8"), np.empty((0, longs), np.uint64)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if found:
                yield out(*(np.concatenate(x) for x in zip(*found, strict=True)))
                found.clear()

        for batch in batches:
            mask, keys, of = (batch.column(c).to_numpy() for c in ("mask", "key", "node"))
            values = np.stack([batch.column(w).to_numpy() for w in names], axis=1).view(np.uint64)
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (keys[1:] != keys[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
                if a == b:
                    continue
                if key != (mask[a], keys[a]):
                    if len(nodes) > 1:
                        found += forest(nodes, prints, distance)
                    key, large, nodes, prints = (mask[a], keys[a]), False, of[a:b], values[a:b]
                else:
                    nodes, prints = np.append(nodes, of[a:b]), np.append(prints, values[a:b], axis=0)
                if len(nodes) > limit or large:
                    yield out(nodes, None, int(mask[a]), int(keys[a]), prints)
                    large, nodes, prints = True, nodes[:0], prints[:0]
            yield from flush()
        if len(nodes) > 1:
            found += forest(nodes, prints, distance)
        yield from flush()
        tidy()

    return rows.mapInArrow(run, schema)


def part_links(rows: DataFrame, longs: int, distance: int, limit: int = BUCKET, forest: Callable = _forest, files: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``u, v``: links that connect the classes of each bucket of ``mask, key, node, w0 ...`` as its pairs would, and the
    rows of buckets above ``limit`` classes, if there are any. Such a bucket is dealt into parts, by another hash in each
    block; classes of one part are linked. What these links leave apart is for ``rest_links``. Keys have 32 bits at most.
    """
    names = [f"w{k}" for k in range(longs)]
    met = stored(_meet(rows, longs, distance, limit, forest), "met", files=files, dealt=True)
    out = met.filter("v IS NOT NULL").select("u", "v")
    large = met.filter("v IS NULL").select("mask", "key", F.col("u").alias("node"), *names)
    if large.isEmpty():
        return out, None
    sizes = large.groupBy("mask", "key").agg(_parts(F.count(F.lit(1)), limit).alias("parts"))
    dealt = large.join(sizes.hint("merge"), ["mask", "key"]).withColumn("part", F.pmod(F.xxhash64("node", "mask"), F.col("parts")))
    cells = dealt.select("mask", F.shiftleft("part", 32).bitwiseOR(F.col("key")).alias("key"), "node", *names)
    return out.union(_meet(cells, longs, distance, None, forest).select("u", "v")), large


def _parts(n: Column, limit: int) -> Column:
    return F.ceil(n / max(1, limit // 2)).cast("long")


def rest_links(large: DataFrame, labels: DataFrame, longs: int, distance: int, limit: int = BUCKET) -> DataFrame:
    """``u, v``: of every two labels (``node, part``; a class without one is its own) in one large bucket, pairs within
    ``distance`` if there are any, the nearest of each cell.

    Most classes of a large bucket are near copies that have one label by now. Classes of another label, part by part, meet
    all classes of the bucket, part by part: the cost is the number of the former times that of all, not the square.
    """
    names = [f"w{k}" for k in range(longs)]
    own = large.join(labels.hint("merge"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    own = stored(own.select("mask", "key", "node", "part", *names), "labelled")
    counts = own.groupBy("mask", "key", "part").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("mask", "key").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("n")).filter("n > top.n")
    most = most.select("mask", "key", F.col("top.part").alias("top"), _parts(F.col("n"), limit).alias("all"), _parts(F.col("n") - F.col("top.n"), limit).alias("few"))
    rows = own.join(most.hint("merge"), ["mask", "key"])
    sides = []
    for side, here, there, some in ((0, "few", "all", F.col("part") != F.col("top")), (1, "all", "few", F.lit(True))):
        at = F.pmod(F.xxhash64("node", "mask", F.lit(side)), F.col(here)).alias("at")
        met = rows.filter(some).withColumn("at", at).withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), F.col(there) - 1)))
        cell = F.col("at") * F.col("all") + F.col("of") if side == 0 else F.col("of") * F.col("all") + F.col("at")
        sides.append(met.select("mask", F.shiftleft(cell, 32).bitwiseOR(F.col("key")).alias("key"), "node", *names, F.col("part").alias(f"w{longs}"), F.lit(side).cast("long").alias(f"w{longs + 1}")))
    return _meet(sides[0].union(sides[1]), longs + 2, distance, None, _between).select("u", "v")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("node", "w0", "mask").withColumn("key", F.col("w0").bitwiseAND(F.col("mask")))


def exact_links(classes: DataFrame, distance: int = 3, limit: int = BUCKET) -> DataFrame:
    """``u, v``: links that connect the classes ``node, w0`` (distinct fingerprints) as all pairs within ``distance`` would."""
    if not 0 < distance <= 3 or limit < 64:
        raise ValueError("five blocks hold distances of one to three bits, and buckets must hold six free bits")
    first = F.explode(F.array(*[F.lit(_signed(m)) for m in _masks(BLOCKS, 2)])).alias("mask")
    met = stored(_meet(_keyed(classes.select("node", "w0", first)), 1, distance, limit), "met")
    out = met.filter("v IS NOT NULL").select("u", "v")
    # masks of buckets that were too large: at most ten in the first round, and four of each in the next
    while left := [r[0] for r in met.filter("v IS NULL").select("mask").distinct().collect()]:
        finer = classes.sparkSession.createDataFrame([(m, _signed(x)) for m in left for x in _finer(m & FULL)], "was long, mask long")
        rest = met.filter("v IS NULL").select(F.col("u").alias("node"), "w0", F.col("mask").alias("was")).join(F.broadcast(finer), "was")
        met = stored(_meet(_keyed(rest), 1, distance, limit), "met")
        out = out.union(met.filter("v IS NOT NULL").select("u", "v"))
    return out


def link(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """``doc_id, w0, component_id``: fingerprints link at up to ``distance`` bits; the component is named by its smallest doc_id.

    One row per input row. Texts without words have fingerprint zero and link like any other. Rows with a null doc_id
    have a component only if another row of their component has an id.
    """
    prints = stored(fingerprints(docs, words), "prints")
    classes = stored(prints.groupBy("w0").agg(F.min("doc_id").alias("node")), "classes")
    found = components(exact_links(classes.filter("node IS NOT NULL"), distance))
    named = stored(classes.join(found, "node", "left").select("w0", F.coalesce("component_id", "node").alias("component_id")), "named")
    return prints.join(named.hint("merge"), "w0").select("doc_id", "w0", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``documents``; see ``link``.

    Null and empty texts, and those without words, have fingerprint zero and link like any other; texts of any length are
    read whole; repeated rows are returned each; an empty table gives no rows; other columns are not read.
    """
    found = link(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")


def differing(similarity: float) -> float:
    """The share of bits in which two sets of the Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def layout(n: int, similarity: float) -> tuple[int, int]:
    """Blocks and bits of each for ``n`` documents: 40 of 16 up to 67 million, then a bit more with each doubling."""
    width = max(16, math.ceil(math.log2(max(1, n) / SPARSE)))
    return math.ceil(math.log(1 - MEET) / math.log1p(-((1 - differing(similarity)) ** width)) - 0.05), width


#: Ids (8 bytes each) that are sent to all tasks, so that the texts of all others need not be moved.
PICKED = 1 << 21


def picked(docs: DataFrame, ids: DataFrame, files: int | None = None) -> DataFrame:
    """``doc_id, text`` of rows whose id is among the distinct ``ids``: up to ``PICKED`` of them go to the texts, more meet them."""
    ids = stored(ids, "ids", files=files)
    return texts(docs).join(F.broadcast(ids) if ids.count() <= PICKED else ids.hint("merge"), "doc_id", "left_semi")


def alike(pairs: DataFrame, docs: DataFrame, words: int, similarity: float, files: int | None = None) -> DataFrame:
    """Rows of ``u, v`` (doc_ids) whose texts' shingle sets have the Jaccard similarity or more.

    Where an id has several texts, it is enough that two of them do.
    """
    prepare(docs.sparkSession)
    wanted = pairs.select("u").union(pairs.select("v")).distinct()
    own = stored(picked(docs, wanted.withColumnRenamed("u", "doc_id"), files).distinct(), "texts")
    sides = [own.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")).hint("merge") for c in ("u", "v")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(64)
        def shingles(text: str) -> np.ndarray:
            return np.unique(shingle_hashes(text, words))

        for batch in batches:
            kept = []
            for one, two in zip(batch.column("tu").to_pylist(), batch.column("tv").to_pylist(), strict=True):
                a, b = shingles(one), shingles(two)
                both = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(both > 0 and both / (len(a) + len(b) - both) >= similarity)
            yield batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    # an id with very many pairs: both sides are dealt by exchanges that AQE may split
    return pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long").distinct()


def crossing(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``u, v, pu, pv``: pairs whose classes lie in different parts (``node, part``)."""
    sides = [parts.select(F.col("node").alias(c), F.col("part").alias(f"p{c}")).hint("merge") for c in ("u", "v")]
    return pairs.join(sides[0], "u").join(sides[1], "v").filter("pu <> pv").select("u", "v", "pu", "pv")


def joined(parts: DataFrame, links: DataFrame, files: int | None = None) -> DataFrame:
    """``node, part`` with those parts made one that links ``u, v`` join: each has the smallest node of what it is made of."""
    pairs = stored(crossing(links, parts).select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "joins", files=files)
    if pairs.isEmpty():
        return stored(parts, "parts", files=files)
    found = components(pairs, files).select(F.col("node").alias("part"), "component_id").hint("merge")
    return stored(parts.join(found, "part", "left").select("node", F.coalesce("component_id", "part").alias("part")), "parts", files=files)


def _cut(at: int, width: int) -> Column:
    """Bits of a fingerprint in longs ``w0, w1 ...``, up to 32 of them, as a number."""
    k, low = divmod(at, 64)
    bits = F.shiftrightunsigned(f"w{k}", low)
    if low + width > 64:
        bits = bits.bitwiseOR(F.shiftleft(f"w{k + 1}", 64 - low))
    return bits.bitwiseAND((1 << width) - 1)


#: Classes of a doubtful group that meet the others in one task.
CELL = 256


def within(classes: DataFrame, docs: DataFrame, words: int, similarity: float, distance: int, check: int, cell: int = CELL, files: int | None = None) -> DataFrame:
    """``u, v``: links that connect the classes ``group, part, node, w0 ...`` of each group as all their pairs would that
    are within ``distance`` and whose texts have the similarity.

    Texts come to the task that compares them, so that no pair becomes a row. ``part`` tells which classes are joined
    already: those of other parts than the group's largest meet all of the group, ``cell`` by ``cell`` classes.
    """
    prepare(docs.sparkSession)
    names = [f"w{k}" for k in range(check)]
    classes = stored(classes.select("group", "part", "node", *names), "doubtful", files=files)
    own = picked(docs, classes.select(F.col("node").alias("doc_id")).distinct(), files)
    own = stored(own.select(F.col("doc_id").alias("node"), "text").distinct(), "texts")
    counts = classes.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("group").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("n"))
    most = most.select("group", F.col("top.part").alias("top"), F.ceil(F.col("n") / cell).cast("long").alias("all"), F.ceil((F.col("n") - F.col("top.n")) / cell).cast("long").alias("few"))
    dealt, sides = classes.join(most.hint("merge"), "group"), []
    fewer = F.col("part") != F.col("top")  # in a group of one cell these come once, for both sides
    for side, here, there, some in ((0, "few", "all", fewer), (1, "all", "few", ~fewer | (F.col("all") > 1))):
        met = dealt.filter(some).withColumn("at", F.pmod(F.xxhash64("node", F.lit(side)), F.col(here)))
        met = met.withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), F.col(there) - 1)))
        x, y = ("at", "of") if side == 0 else ("of", "at")
        sides.append(met.select("group", F.col(x).alias("x"), F.col(y).alias("y"), (F.lit(side) if side else F.when(F.col("all") == 1, 2).otherwise(0)).alias("side"), "part", "node", *names))
    cells = sides[0].union(sides[1])
    cells = cells.join(own.hint("merge"), "node")

    def run(rows: pa.Table) -> pa.Table:
        node, part = (rows.column(c).to_numpy() for c in ("node", "part"))
        prints = np.stack([rows.column(w).to_numpy() for w in names], axis=1).view(np.uint64)
        sets = [np.unique(shingle_hashes(t, words)) for t in rows.column("text").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ends = np.cumsum(sizes)
        owner, label = np.repeat(np.arange(len(sets)), sizes), np.unique(part, return_inverse=True)[1]
        mark = np.zeros(int(ids.max(initial=0)) + 1, bool)
        side = rows.column("side").to_numpy()
        u, v = [], []
        for k in np.flatnonzero(side != 1):
            near = (side != 0) & (label != label[k])
            near[near] = np.bitwise_count(prints[near] ^ prints[k]).sum(1, dtype=np.int64) <= distance
            if not near.any():
                continue
            mine = ids[ends[k] - sizes[k] : ends[k]]
            mark[mine] = True
            both = np.bincount(owner, mark[ids], len(sets))
            mark[mine] = False
            for j in np.flatnonzero(near & (both > 0) & (both >= similarity * (sizes[k] + sizes - both))):
                if label[j] != label[k]:
                    label[label == label[j]] = label[k]
                    u.append(node[k])
                    v.append(node[j])
        tidy()
        return pa.Table.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return cells.groupBy("group", "x", "y").applyInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, blocks: int = 0, width: int = 0, check: int = 8, limit: int = BUCKET, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, component_id`` by likeness (and BIGINT columns ``keep``), for each row of ``doc_id, text``.

    Fingerprints of ``blocks * width`` bits (as ``layout`` has them for the rows' number if not given), of distinct
    shingles, are compared in the first ``64 * check``. Pairs up to
    ``DEVIATIONS`` above the mean distance of the similarity are candidates; only those whose shingle sets have the
    similarity link. Of the least spanning forests of the buckets first one pair a class is judged. The parts that are
    left, as far as other links of the forests lead from one to another, are groups whose texts meet: there all candidates
    are judged, and only links are returned (``within``).

    Texts without words do not link here: they share no shingle. Classes of a bucket above ``limit`` are first compared
    within parts, and what stays apart with all of the bucket (``part_links``, ``rest_links``).
    """
    keep = keep or []
    n = docs.count()
    files = files_for(docs.sparkSession, n)  # of the tables below, but for texts: none has more than a few short rows a document
    if not blocks:
        blocks, width = layout(n, similarity)
    longs = max(check, -(-blocks * width // 64))
    names, carried = [f"w{k}" for k in range(longs + 1)], [f"w{k}" for k in range(check)]
    prints = stored(fingerprints(docs, words, longs, *keep, distinct=True), "wide", files=files, dealt=True)
    classes = stored(prints.groupBy(*names).agg(F.min("doc_id").alias("node")), "classes", files=files)
    key = [_cut(b * width, width) for b in range(blocks)]
    worded = reduce(Column.__or__, (F.col(n) != 0 for n in names[:-1]))
    share = differing(similarity)
    distance = round(64 * check * share + DEVIATIONS * math.sqrt(64 * check * share * (1 - share)))

    def in_blocks(rows: DataFrame, *more: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("mask"), k.alias("key")) for b, k in enumerate(key)]))
        return rows.select("node", *carried, *more, each.alias("k")).select("k.mask", "k.key", "node", *carried, *more)

    def ordered(links: DataFrame) -> DataFrame:
        return links.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    rows = classes.filter(worded & F.col("node").isNotNull())
    links, large = part_links(in_blocks(rows), check, distance, limit, _nearest, files)
    tried = stored(ordered(links), "tried", files=files)
    # first one pair a class; what other pairs would join is judged where the texts of their groups meet
    first = stored(tried.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "first", files=files)
    parts = joined(tried.select(F.col("u").alias("node")).union(tried.select("v")).distinct().withColumn("part", F.col("node")), alike(first, docs, words, similarity, files), files)
    if large is not None:
        far = stored(ordered(rest_links(large, parts, check, distance, limit)), "far", files=files)
        alone = far.select(F.col("u").alias("node")).union(far.select("v")).distinct().join(parts, "node", "left_anti")
        parts = stored(parts.union(alone.withColumn("part", F.col("node"))), "parts", files=files)
        tried = tried.union(far)
    failed = stored(crossing(tried, parts), "failed", files=files)
    if not failed.isEmpty():
        doubt = components(failed.select(F.col("pu").alias("u"), F.col("pv").alias("v")), files).select(F.col("node").alias("part"), F.col("component_id").alias("group"))
        some = parts.join(doubt.hint("merge"), "part").join(rows.select("node", *carried).hint("merge"), "node")
        parts = joined(parts, within(some, docs, words, similarity, distance, check, files=files), files)
    found = parts.withColumnRenamed("part", "component_id")
    named = stored(classes.join(found, "node", "left").select(*names, F.coalesce("component_id", "node").alias("component_id")), "named", files=files)
    on = [prints[n] == named[n] for n in names]
    some = reduce(Column.__or__, (prints[n] != 0 for n in names[:-1]))
    return prints.join(named.hint("merge"), on).select("doc_id", F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *keep)


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay: of each group of near copies those with the smallest doc_id; all columns unchanged.

    Rows with a null doc_id have no rank and stay. Of rows with one doc_id, each is judged by its own text.
    """
    marks = [f"_{uuid.uuid4().hex}" for _ in "12"]
    rows = docs.withColumns(dict(zip(marks, row_hashes("text"), strict=True)))
    groups = near_groups(rows.filter("doc_id IS NOT NULL").select("doc_id", "text", *marks), keep=marks)
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), *[F.col(m).alias(f"{m}d") for m in marks])
    dropped = stored(gone.distinct(), "dropped", files=files_for(docs.sparkSession, docs.count()))
    same = rows["doc_id"] == dropped["gone_id"]
    for m in marks:
        same = same & (rows[m] == dropped[f"{m}d"])
    return rows.join(dropped, same, "left_anti").drop(*marks)


__all__ = ["fingerprints", "link", "near_groups", "one_of_each", "op3_simhash"]
