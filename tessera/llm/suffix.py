"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts in a document that came before.

A ``SuffixIndex`` is a logarithmic family of stored, sorted levels. Each batch of documents gets a sparse suffix array,
is merge-scanned against the existing levels for long matches, and becomes a level of its own; levels of equal size merge.

1. *Suffixes.* In each window of LENGTH bytes the 25-byte string with the least hash (the leftmost, if equal) is its
   anchor, so equal windows have equal anchors wherever they lie. A run of windows with one anchor is a *stretch* of 50
   to 75 bytes. The array of a block of texts has one entry for each stretch, sorted by hashes of its anchor and of its
   bytes, with its place in the text. (An entry for every byte would be thirteen times as many: see the README.)
2. *Merge-scan.* Shards of the order take the arrays of all blocks of a batch and the levels, which lie there already,
   bucketed by shard. An entry that a level has, or a smaller doc_id of the batch, is a match of the whole stretch. What
   is left are first holders; the new level is made of them, and of the levels that it merges with.
3. *Windows.* If the anchor of a first holder also has other bytes behind or before it, in the batch or in a level, the
   match may cover a part of the stretch: these stretches are read from the stored texts, and their windows are compared
   as bytes. Those of an anchor that has very many different stretches are sent window by window, each window once a
   block, to shards by the windows' hashes.
4. Blocks mark the bytes and drop them.

Texts lie in a table that is bucketed by block, so that they are written once and read without a shuffle. A block is a
part of what one task has read: neither a key nor a shuffle decides where a row goes, so repeated ids or null ids do not
meet in one task, and each task writes one file. A stretch that very many documents share makes one record a block.

Whole stretches are equal if 112 bits of hashes are (48 of the anchor, 64 of XXH3 of all bytes; for 10^13 stretches the
chance of one false match is under 10^-7), windows if their bytes are. Null texts are empty. Texts under LENGTH bytes lose
nothing. Rows with one doc_id never remove each other's bytes; null ids come after all others, as one id.
"""

from __future__ import annotations

import atexit
import hashlib
import inspect
import math
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, temporary, writer
from .commits import Commits
from .common import cleaned, drop, partitions, prepare, shared_dir, table, tidy

LENGTH = 50
ANCHOR = 25
#: Bytes of text that one block holds at least, that a shard covers, and that are hashed at a time.
BLOCK = 4 << 20
SHARD = 2 << 20
STEP = 1 << 18
#: Entries of a level that one row holds.
CHUNK = 1 << 16
#: Stretches of one anchor above which their windows are dealt out.
MANY = 2048
#: Every block sends a record to every shard. Blocks grow with the root of the text times this, so that the number of
#: records grows in proportion to the text: blocks hold 8 MB at 100 GB of text and 25 MB at 1 TB.
SPARSE = 650
#: Bytes of text to each of these records, at least: shards are as large as that takes.
RECORD = 650
#: Batches of a table that is deduplicated at once: at least so many, and more if one would be larger than this.
BATCHES = 3
BATCH = 1 << 40
#: A level merges with what comes behind it unless it is this much larger.
EQUAL = 1.5
#: Blocks that one task can make; the last takes what is left.
BLOCKS = 256
FIRST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

_SLOT = np.uint64(24)
_ODD = 0x9E3779B97F4A7C15
_LETTER = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_ODD, 2 * STEP + 1)
_DOWN = _powers(pow(_ODD, -1, 1 << 64), 2 * STEP + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def stretches(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts ``buf[starts:ends]`` that fill ``buf``: text, first and last window and anchor hash of each stretch."""
    n = len(buf)
    if n < LENGTH:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[buf] * _UP[:n], out=sums[1:])
    h = (sums[ANCHOR:] - sums[:-ANCHOR]) * _DOWN[: n - ANCHOR + 1]
    least = h * np.uint64(0xD6E8FEB86659FD93)
    least ^= least << np.uint64(33)
    least >>= _SLOT
    least <<= _SLOT
    least |= np.arange(len(least), dtype=np.uint64)
    size, span = 1, LENGTH - ANCHOR + 1
    while size < span:
        step = min(size, span - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    edge = np.zeros(n + 1, np.int8)
    edge[np.maximum(starts, ends - LENGTH + 1)] += 1
    np.add.at(edge, ends, -1)
    windows = np.flatnonzero(np.cumsum(edge[: len(least)], dtype=np.int8) == 0)
    if not len(windows):
        return stretches(buf[:0], starts[:0], ends[:0])
    at = (least[windows] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi = windows[first], windows[np.append(first[1:], len(windows)) - 1]
    return np.searchsorted(ends, lo, side="right"), lo, hi, _mix(h[at[first]])


class Block:
    """The texts of one block end to end, with ``doc`` (id) and ``base`` (where it starts) of each."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        data = [t.encode() for t in rows.column("text").to_pylist()]
        self.doc = np.array([LAST if d is None else d for d in rows.column("doc_id").to_pylist()], np.int64)
        size = np.fromiter(map(len, data), np.int64, len(data))
        self.end = np.cumsum(size)
        self.base = self.end - size
        self.data = b"".join(data)
        self.buf = np.frombuffer(self.data, np.uint8)

    def stretches(self) -> tuple[np.ndarray, ...]:
        """Row, first and last window (in ``buf``), hash of the anchor (48 bits) and of all bytes of each stretch."""
        found, row = [], 0
        while row < len(self.base):
            a, stop = self.base[row], row + 1
            while stop < len(self.base) and self.end[stop] - a <= STEP:
                stop += 1
            if self.end[row] - a > STEP:  # parts of a long text overlap by all but one byte of a window
                for at in range(a, self.end[row], STEP):
                    to = min(at + STEP + LENGTH - 1, self.end[row])
                    part = stretches(self.buf[at:to], np.array([0]), np.array([to - at]))
                    found.append((part[0] + row, part[1] + at, part[2] + at, part[3]))
            else:
                to = self.end[stop - 1]
                filled = np.flatnonzero(self.end[row:stop] > self.base[row:stop]) + row
                part = stretches(self.buf[a:to], self.base[filled] - a, self.end[filled] - a)
                found.append((filled[part[0]], part[1] + a, part[2] + a, part[3]))
            row = stop
        row, lo, hi, anchor = (np.concatenate(x) for x in zip(*found, strict=True)) if found else stretches(self.buf[:0], *[np.empty(0, int)] * 2)
        digest, data = xxhash.xxh3_64_intdigest, self.data
        own = np.fromiter((digest(data[a:b], 17) for a, b in zip(lo.tolist(), (hi + LENGTH).tolist(), strict=True)), np.uint64, len(lo))
        return row, lo, hi, anchor >> np.uint64(16), own


def _planes(*columns: np.ndarray) -> bytes:
    """Columns byte by byte of their numbers: the shuffle's compression finds the bytes that hardly change."""
    return b"".join(c.astype(c.dtype.newbyteorder("<")).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)


def _columns(body: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind).reshape(n))
        at += n * width
    return out


def _parsed(bodies: Sequence[bytes], sizes: Sequence[int], *kinds: str) -> list[np.ndarray]:
    parts = [_columns(b, n, *kinds) for b, n in zip(bodies, sizes, strict=True)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, k) for k in kinds]


def _halves(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (anchor >> np.uint64(16)).astype(np.uint32), (anchor & np.uint64(0xFFFF)).astype(np.uint16)


def _whole(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << np.uint64(16) | low


def _distinct(anchor: np.ndarray, own: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by anchor, own hash and doc, and where in it a new stretch begins: its smallest doc."""
    order = np.lexsort((doc, own, anchor))
    return order, _changes(anchor[order], own[order])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))
    return new


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _runs(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Key, from and to of the runs of a sorted array."""
    cuts = np.append(np.flatnonzero(_changes(key)) if len(key) else [], len(key)).astype(int).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(key[a]), a, b


# -- blocks -----------------------------------------------------------------------------------------------------------

_M32 = 0xFFFFFFFF


def _rotated(x: int, n: int) -> int:
    return (x << n | x >> 32 - n) & _M32


def _back(x: int, shift: int) -> int:
    """The number whose xor with itself shifted right is ``x``."""
    out = x
    for _ in range(32 // shift):
        out = x ^ out >> shift
    return out


def block_number(target: int, low: int) -> int:
    """A long with these low 32 bits whose hash, as Spark deals rows to buckets and partitions (Murmur3, seed 42), is ``target``.

    The hash of a long takes in its low and then its high half by steps that can be undone, so the high half follows from
    the hash that is wanted.
    """
    mixed = lambda k: _rotated(k * 0xCC9E2D51 & _M32, 15) * 0x1B873593 & _M32
    inverse = lambda x: pow(x, -1, 1 << 32)
    state = _rotated(42 ^ mixed(low), 13) * 5 + 0xE6546B64 & _M32
    last = _back(target, 16) * inverse(0xC2B2AE35) & _M32
    last = _back(_back(last, 13) * inverse(0x85EBCA6B) & _M32, 16) ^ 8
    high = _rotated((last - 0xE6546B64) * inverse(5) & _M32, 19) ^ state
    high = _rotated(high * inverse(0x1B873593) & _M32, 17) * inverse(0xCC9E2D51) & _M32
    out = high << 32 | low
    return out - (1 << 64) if out >> 63 else out


def _blocks(buckets: int, base: int, size: int) -> Callable:
    """Rows as they are read, with the number of their block: it hashes to the task's own bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number, held = -1, 0
        for batch in batches:
            out = []
            for n in pa.compute.binary_length(batch.column("text").cast(pa.binary())).to_pylist():
                if number < 0 or held >= size and number < BLOCKS - 1:
                    number, held = number + 1, 0
                    block = block_number(task % buckets, base + task * BLOCKS + number & _M32)
                held += n
                out.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *batch.columns], ["block", *batch.schema.names])

    return run


_NAMED = "shard long, block long, n int, wide boolean, body binary"


def _name(shards: int) -> Callable:
    """Step 1: the sorted array of a block's distinct stretches, by shard."""

    def run(rows: pa.Table) -> pa.Table:
        block = Block(rows)
        row, lo, hi, anchor, own = block.stretches()
        order, new = _distinct(anchor, own, block.doc[row])
        kept = order[new]
        kept = kept[np.argsort(anchor[kept] % np.uint64(shards), kind="stable")]
        out = []
        for shard, a, b in _runs((anchor[kept] % np.uint64(shards)).astype(np.int64)):
            part = kept[a:b]
            doc = block.doc[row[part]]
            wide = bool((doc < 0).any() or (doc >> 32).any())
            body = _planes(*_halves(anchor[part]), own[part], doc if wide else doc.astype(np.uint32), lo[part].astype(np.uint32), (hi - lo)[part].astype(np.uint8))
            out.append((shard, rows.column("block")[0].as_py(), b - a, wide, body))
        return _table(out, _NAMED)

    return run


#: What a shard says. Kind 0 goes to blocks of the batch: n stretches (their first window; 0 held, 1 and 2 to be compared,
#: 2 if their anchor has many; the smallest doc that holds them). Kind 1 goes to blocks of former batches: stretches whose
#: bytes are wanted. Kind 2 is the shard of a new level, in chunks with the number of their first entry as block.
_SCANNED = "kind int, home long, block long, n int, body binary"
_ENTRY = ("<u4", "<u2", "<u8", "<i8", "<u4", "u1")


def _entries(anchor: np.ndarray, own: np.ndarray, block: np.ndarray, lo: np.ndarray, size: np.ndarray) -> bytes:
    return _planes(*_halves(anchor), own, block.astype(np.int64), lo.astype(np.uint32), size.astype(np.uint8))


def _found(anchor: np.ndarray, own: np.ndarray, level: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether a level has each entry: both are sorted."""
    have, theirs = level[0] << np.uint64(16) | level[1] >> np.uint64(48), level[1]
    want = anchor << np.uint64(16) | own >> np.uint64(48)
    at, out = np.searchsorted(have, want), np.zeros(len(want), bool)
    left = np.arange(len(want))
    while len(left):
        left = left[at[left] < len(have)]
        left = left[have[at[left]] == want[left]]
        same = theirs[at[left]] == own[left]
        out[left[same]] = True
        left = left[~same]
        at[left] += 1
    return out


def _scan(merging: list[int]) -> Callable:
    """Step 2 in a shard: the batch's arrays are merge-scanned against each other and the levels.

    ``merging`` are the levels that become one with the batch's.
    """

    def run(key: tuple, rows: pa.Table, old: pa.Table) -> pa.Table:
        home = key[0].as_py()
        parts = []
        for block, n, wide, body in zip(*(rows.column(c).to_pylist() for c in ("block", "n", "wide", "body")), strict=True):
            high, low, own, doc, lo, size = _columns(body, n, "<u4", "<u2", "<u8", "<i8" if wide else "<u4", "<u4", "u1")
            parts.append((_whole(high, low), own, doc.astype(np.int64), np.full(n, block, np.int64), lo, size))
        anchor, own, doc, block, lo, size = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.empty(0, k) for k in ("<u8", "<u8", "<i8", "<i8", "<u4", "u1")]
        order, new = _distinct(anchor, own, doc)
        anchor, own, doc, block, lo, size = (x[order] for x in (anchor, own, doc, block, lo, size))
        levels: dict[int, tuple[np.ndarray, ...]] = {}
        chunks: dict[int, list[tuple[int, bytes, int]]] = {}
        for number, at, n, body in zip(*(old.column(c).to_pylist() for c in ("level", "block", "n", "body")), strict=True):
            chunks.setdefault(number, []).append((at, body, n))
        for number, own_chunks in chunks.items():
            _, bodies, sizes = zip(*sorted(own_chunks), strict=True)
            high, low, *rest = _parsed(bodies, sizes, *_ENTRY)
            levels[number] = (_whole(high, low), *rest)
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        g_anchor, g_own = anchor[first], own[first]
        known = np.zeros(len(first), bool)
        for level in levels.values():
            known |= _found(g_anchor, g_own, level)
        # how many different stretches each anchor has
        change = _changes(g_anchor) if len(first) else np.empty(0, bool)
        of, heads = np.cumsum(change) - 1, np.flatnonzero(change)
        contents = np.add.reduceat((~known).astype(np.int64), heads) if len(heads) else np.empty(0, np.int64)
        spans = {k: [np.searchsorted(x[0], g_anchor[heads], side) for side in ("left", "right")] for k, x in levels.items()}
        for left, right in spans.values():
            contents += right - left
        ask = ~known & (contents[of] > 1)
        least = np.where(known, FIRST, doc[first])[group]
        held, asked = least < doc, ask[group] & (doc == least)
        many = contents > MANY
        out = []
        said = np.flatnonzero(held | asked)
        said = said[np.argsort(block[said], kind="stable")]
        kind = np.where(held, 0, 1 + many[of][group]).astype(np.uint8)
        for number, a, b in _runs(block[said]):
            part = said[a:b]
            out.append((0, home, number, b - a, _planes(lo[part], kind[part], np.where(held[part], least[part], 0))))
        wanted = np.zeros(len(heads), bool)
        wanted[of[ask]] = True
        for k, (left, right) in spans.items():
            left, right = left[wanted], right[wanted]
            size_of = right - left
            at = np.repeat(left - np.cumsum(size_of) + size_of, size_of) + np.arange(size_of.sum())
            some, far = np.repeat(many[wanted], size_of), levels[k]
            turn = np.argsort(far[2][at], kind="stable")
            at, some = at[turn], some[turn]
            for number, a, b in _runs(far[2][at]):
                out.append((1, home, number, b - a, _planes(*_halves(far[0][at[a:b]]), far[3][at[a:b]], far[4][at[a:b]], some[a:b].astype(np.uint8))))
        own_level = [x[first][~known] for x in (anchor, own, block, lo, size)]
        joined = [np.concatenate(x) for x in zip(own_level, *(levels[k] for k in merging if k in levels), strict=True)]
        turn = np.lexsort((joined[1], joined[0]))
        for a in range(0, len(turn), CHUNK):
            part = turn[a : a + CHUNK]
            out.append((2, home, a, len(part), _entries(*(x[part] for x in joined))))
        return _table(out, _SCANNED)

    return run


#: What is known of a block (kind 0) and stretches or windows whose bytes are to be compared (kind 1: unit q of the block,
#: the number of the first window in its stretch and the bytes).
_SORTED = "kind int, shard long, block long, q int, doc long, body binary"


def _units(out: list[tuple], shards: int, number: int, anchor: list[int], doc: list[int], stretch: list[bytes], many: list[bool]) -> tuple[list, list]:
    """Rows of stretches to be compared, one each, or one a different window of those with ``many``.

    Gives the bits of windows that the block itself knows to be held, as ``(stretch, bit)``, and which unit answers for
    which window of the others, as ``(unit, stretch, bit)``.
    """
    seen: dict[bytes, list[tuple[int, int, int]]] = {}
    for q, (a, d, text) in enumerate(zip(anchor, doc, stretch, strict=True)):
        if not many[q]:
            out.append((1, a % shards, number, q, d, b"\0" + text))
            continue
        for k in range(len(text) - LENGTH + 1):
            seen.setdefault(text[k : k + LENGTH], []).append((d, q, k))
    known, links, unit = [], [], len(doc)
    for window, where in seen.items():
        least = min(where)[0]
        out.append((1, zlib.crc32(window) % shards, number, unit, least, b"\0" + window))
        for d, q, k in where:
            if d > least:
                known.append((q, k))
            else:
                links.append((unit, q, k))
        unit += 1
    return known, links


#: Covered stretches (first window, how many more), those to be compared (first window, unit), windows that the block knows
#: to be held (stretch, bit), and which unit answers for which window (unit, stretch, bit).
_KNOWN = ("<u4", "u1", "<u4", "<u4", "<u4", "u1", "<u4", "<u4", "u1")


def _triples(rows: list[tuple], width: int) -> list[np.ndarray]:
    return list(np.array(rows, np.int64).reshape(-1, width).T)


def _sort_out(shards: int) -> Callable:
    """Step 3 in a block of the batch: what is known, and the bytes of stretches whose windows are to be compared."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([], _SORTED)
        block, number = Block(rows), rows.column("block")[0].as_py()
        row, lo, hi, anchor, own = block.stretches()
        doc = block.doc[row]
        t_lo, kind, t_doc = _parsed(told.column("body").to_pylist(), told.column("n").to_pylist(), "<u4", "u1", "<i8")
        # the smallest doc of each stretch: this block's own, or what the shard told of its entry
        order, new = _distinct(anchor, own, doc)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        reps = order[new]
        least = doc[reps]
        by_place = np.argsort(lo[reps])
        pos = by_place[np.searchsorted(lo[reps][by_place], t_lo)]
        least[pos[kind == 0]] = t_doc[kind == 0]
        ask = np.full(len(least), -1, np.int64)
        asked = pos[kind > 0]
        ask[asked] = np.arange(len(asked))
        covered = least[group] < doc
        left = ~covered & (ask[group] >= 0)
        places = reps[asked]
        out: list[tuple] = []
        texts = [block.data[a:b] for a, b in zip(lo[places].tolist(), (hi[places] + LENGTH).tolist(), strict=True)]
        known, links = _units(out, shards, number, anchor[places].tolist(), doc[places].tolist(), texts, (kind[kind > 0] > 1).tolist())
        sizes = [int(covered.sum()), int(left.sum()), len(known), len(links)]
        width = (hi - lo).astype(np.uint8)
        parts = [lo[covered], width[covered], lo[left], ask[group][left], *_triples(known, 2), *_triples(links, 3)]
        body = _planes(np.array(sizes, np.int64), *(x.astype(k) for x, k in zip(parts, _KNOWN, strict=True)))
        out.append((0, None, number, 0, None, body))
        return _table(out, _SORTED)

    return run


def _fetch(shards: int) -> Callable:
    """Step 3 in a block of a former batch: the bytes of the stretches that are wanted."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and told.num_rows:
            block, number = Block(rows), rows.column("block")[0].as_py()
            high, low, lo, size, many = _parsed(told.column("body").to_pylist(), told.column("n").to_pylist(), "<u4", "<u2", "<u4", "u1", "u1")
            texts = [block.data[a : a + n + LENGTH] for a, n in zip(lo.tolist(), size.tolist(), strict=True)]
            _units(out, shards, number, _whole(high, low).tolist(), [FIRST] * len(texts), texts, (many > 0).tolist())
        return _table(out, _SORTED)

    return run


_ANSWER = "block long, n int, body binary"


def windows(body: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of binary rows (their first byte left out), one row each, the row that each is of, and its number there."""
    ends = np.frombuffer(body.buffers()[1], "<i4")[body.offset : body.offset + len(body) + 1].astype(np.int64)
    data = np.frombuffer(body.buffers()[2], np.uint8)
    starts, many = ends[:-1] + 1, np.diff(ends) - LENGTH
    row = np.repeat(np.arange(len(body)), many)
    bit = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return np.lib.stride_tricks.sliding_window_view(data, LENGTH)[starts[row] + bit] if len(row) else np.empty((0, LENGTH), np.uint8), row, bit


def _hashed(wins: np.ndarray) -> np.ndarray:
    words = np.zeros((len(wins), -(-LENGTH // 8) * 8), np.uint8)
    words[:, :LENGTH] = wins
    out = np.zeros(len(wins), np.uint64)
    for w in words.view(np.uint64).T:
        out = _mix(out ^ w) * np.uint64(_ODD)
    return out


def earlier(wins: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller doc has each window. Sorted by a hash; where equal hashes hide different bytes, by the bytes."""
    h = _hashed(wins)
    order = np.lexsort((doc, h))
    new = _changes(h[order]) if len(h) else np.empty(0, bool)
    odd = ~new
    odd[1:] &= (wins[order[1:]] != wins[order[:-1]]).any(1)
    if odd.any():
        h = np.unique(np.ascontiguousarray(wins).view(f"V{LENGTH}").reshape(-1), return_inverse=True)[1]
        order = np.lexsort((doc, h))
        new = _changes(h[order])
    out = np.empty(len(h), bool)
    out[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1] < doc[order]
    return out


def _compare(rows: pa.Table) -> pa.Table:
    """Step 3 in a shard: a bit for each window of each unit, set if a smaller doc_id has the window.

    Former batches' units have the smallest doc of all and get no answer.
    """
    doc = rows.column("doc").to_numpy()
    wins, row, bit = windows(rows.column("body").combine_chunks())
    seen = earlier(wins, doc[row])
    bits = np.zeros(rows.num_rows, np.uint64)
    np.bitwise_or.at(bits, row[seen], np.uint64(1) << bit[seen].astype(np.uint64))
    said = np.flatnonzero(bits)
    block, q = rows.column("block").to_numpy()[said], rows.column("q").to_numpy()[said]
    turn = np.argsort(block, kind="stable")
    block, q, bits = block[turn], q[turn], bits[said][turn]
    return _table([(number, b - a, _planes(q[a:b].astype(np.int64), bits[a:b])) for number, a, b in _runs(block)], _ANSWER)


def _mark(rows: pa.Table, known: pa.Table) -> tuple[Block, np.ndarray]:
    """Step 4: which bytes of a block go. Of ``known`` the row with null ``n`` is the block's own, the others are answers."""
    block = Block(rows)
    edge = np.zeros(len(block.buf) + 1, np.int32)
    answers, own = [], None
    for n, body in zip(known.column("n").to_pylist(), known.column("body").to_pylist(), strict=True):
        if n is None:
            own = body
        else:
            answers.append(_columns(body, n, "<i8", "<u8"))
    if own is not None:
        sizes = _columns(own[:32], 4, "<i8")[0].tolist()
        parts, at = [], 32
        for n, kinds in zip(sizes, (_KNOWN[:2], _KNOWN[2:4], _KNOWN[4:6], _KNOWN[6:]), strict=True):
            size = n * sum(np.dtype(k).itemsize for k in kinds)
            parts.append([x.astype(np.int64) for x in _columns(own[at : at + size], n, *kinds)])
            at += size
        (lo, width), (p_lo, p_q), (k_q, k_bit), (unit, l_q, l_bit) = parts
        np.add.at(edge, lo, 1)
        np.add.at(edge, lo + width + LENGTH, -1)
        q, bits = (np.concatenate(x) for x in zip(*answers, strict=True)) if answers else (np.empty(0, np.int64), np.empty(0, np.uint64))
        of = np.zeros(1 + max((int(x.max()) for x in (q, p_q, k_q, unit, l_q) if len(x)), default=0), np.uint64)
        np.bitwise_or.at(of, q, bits)
        answered = of[unit] > 0
        np.bitwise_or.at(of, k_q, np.uint64(1) << k_bit.astype(np.uint64))
        np.bitwise_or.at(of, l_q[answered], np.uint64(1) << l_bit[answered].astype(np.uint64))
        for k in range(LENGTH - ANCHOR + 1):
            at = p_lo[of[p_q] >> np.uint64(k) & np.uint64(1) == 1] + k
            np.add.at(edge, at, 1)
            np.add.at(edge, at + LENGTH, -1)
    return block, np.cumsum(edge[:-1]) > 0


def _finish(whole: bool) -> Callable:
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        block, gone = _mark(rows, known)
        edges = np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1
        removed, spans, kept = [], [], []
        for a, b in zip(block.base.tolist(), block.end.tolist(), strict=True):
            n = int(gone[a:b].sum())
            removed.append(n)
            # a run that goes on from the text before begins anew
            spans.append(int(edges[a:b].sum()) + int(b > a and gone[a] and not edges[a]))
            data = block.buf[a:b][~gone[a:b]].tobytes() if n else block.data[a:b]
            kept.append(data.decode(errors="ignore") if whole else hashlib.sha256(data).hexdigest())
        if whole:
            return pa.Table.from_arrays([rows.column("doc_id"), pa.array(kept, pa.string()), rows.column("rest")], ["doc_id", "text", "rest"])
        size = pa.array(block.end - block.base)
        return pa.Table.from_arrays(
            [rows.column("doc_id"), size, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return run


def _tidied(run: Callable) -> Callable:
    """``run`` with the memory of its arrays given back behind it. It takes as many tables as ``run``."""

    def one(rows: pa.Table) -> pa.Table:
        try:
            return run(rows)
        finally:
            tidy()

    def two(rows: pa.Table, more: pa.Table) -> pa.Table:
        try:
            return run(rows, more)
        finally:
            tidy()

    def three(key: tuple, rows: pa.Table, more: pa.Table) -> pa.Table:
        try:
            return run(key, rows, more)
        finally:
            tidy()

    return [one, two, three][len(inspect.signature(run).parameters) - 1]


class SuffixIndex:
    """A logarithmic index family of sparse suffix arrays under ``root`` in a shared file system.

    ``size`` is about the bytes of text that the index is to hold: it fixes the number of shards. Batches come in any
    number; what an earlier batch holds counts as held by a smaller doc_id. A batch is one commit (see ``commits``): of two
    writers, the slower scans again what the other has brought. Levels that were merged stay until ``vacuum``. Without
    ``root`` the index is one writer's, and ends with the session.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, size: int = 1 << 30):
        self.spark = spark
        self.root, self.private = (root or f"{shared_dir(spark)}/suffixes-{uuid.uuid4().hex}").rstrip("/"), root is None
        if self.private:
            temporary(spark, self.root)
        self.commits = Commits(spark, f"{self.root}/commits")
        n = max(8, -(-size // max(BLOCK, math.isqrt(SPARSE * size))))
        if not self.commits.numbers():
            shards = max(8, min(-(-size // SHARD), size // (RECORD * n)))
            # a batch is a part of the texts: as many buckets as all of them would get make small files, and on a local
            # disk Hadoop starts a process for each
            buckets = min(n, max(partitions(spark) // BATCHES, spark.sparkContext.defaultParallelism))
            self.commits.commit(1, {"shards": shards, "buckets": buckets, "next": 0, "batches": [], "levels": []})
        self.shards, self.buckets = (self.commits.latest()[1][k] for k in ("shards", "buckets"))

    def levels(self) -> list[dict]:
        """``path``, ``number`` and ``size`` (bytes of the texts that are in it) of each level, the oldest and largest first."""
        return self.commits.latest()[1]["levels"]

    # -- tables, bucketed by the hash of a long -------------------------------------------------------------------

    def _write(self, rows: DataFrame, path: str, bucket: str, *parts: str) -> None:
        """Tasks hold whole buckets already: each writes its own and no other, and nothing is moved."""
        name = f"suffix_{uuid.uuid4().hex}"
        out = writer(rows).option("path", path).bucketBy(self.buckets, bucket)
        (out.partitionBy(*parts) if parts else out).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay

    def _read(self, kind: str, bucket: str, part: str, paths: dict[int, str]) -> DataFrame:
        """The folders of several batches or levels as one bucketed table."""
        name = f"suffix_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({kind}, {part} INT) USING parquet PARTITIONED BY ({part}) CLUSTERED BY ({bucket}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/none'")
        atexit.register(drop, self.spark, name)
        for number, path in paths.items():
            self.spark.sql(f"ALTER TABLE {name} ADD PARTITION ({part} = {number}) LOCATION '{path}'")
        return self.spark.table(name)

    def _has(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    # -- batches --------------------------------------------------------------------------------------------------

    def add(self, docs: DataFrame, batch: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Take a batch ``doc_id, text, ...``; gives its blocks (other columns in ``rest``) and what is known of each.

        A batch whose id is there already (delivered again, or after a crash) is not added; what was known of it is given.
        """
        prepare(self.spark)
        made = f"{self.root}/{uuid.uuid4().hex}"
        others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
        rest = F.struct(*others) if others else F.lit(None).cast("string")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), rest.alias("rest"))
        kind = f"block BIGINT, {rows.schema.toDDL()}"
        while True:
            number, at = self.commits.latest()
            for entry in at["batches"]:
                if batch is not None and entry["id"] == batch:
                    return self._results(entry)
            size = max(BLOCK, math.isqrt(SPARSE * max(1, sum(x["size"] for x in at["levels"]))))
            base = at["next"]
            numbered = rows.coalesce(self.buckets).mapInArrow(_blocks(self.buckets, base, size), kind)
            self._write(numbered, f"{made}/blocks", "block")
            entry = {"number": number, "id": batch, "path": f"{made}/blocks", "known": f"{made}/known", "kind": kind}
            blocks = self._texts([entry], kind)
            low = F.pmod(F.col("block").bitwiseAND(_M32) - base, F.lit(1 << 32))
            text, last = blocks.agg(F.sum(F.octet_length("text")), F.max(low)).first()
            merging, weight = [], text or 0
            for level in reversed(at["levels"]):
                if level["size"] > EQUAL * weight:
                    break
                merging.append(level)
                weight += level["size"]
            self._scan_and_sort(blocks, at, [x["number"] for x in merging], made)
            new = {
                "next": base + (-1 if last is None else last) + 1,
                "batches": [*at["batches"], entry],
                "levels": [*(x for x in at["levels"] if x not in merging), {"number": number, "path": f"{made}/scan/kind=2", "size": weight}],
            }
            if self.commits.commit(number + 1, at | new):
                break
            remove(self.spark, made)  # another batch came between
        for k in (0, 1):
            remove(self.spark, f"{made}/scan/kind={k}")
        if self.private:
            for x in merging:
                remove(self.spark, x["path"])
        return self._results(entry)

    def _texts(self, batches: list[dict], kind: str = "block BIGINT, doc_id BIGINT, text STRING") -> DataFrame:
        return self._read(kind, "block", "batch", {x["number"]: x["path"] for x in batches}).drop("batch")

    def _scan_and_sort(self, blocks: DataFrame, at: dict, merging: list[int], made: str) -> None:
        """Steps 2 and 3 as far as tables: the shards' answers with the new level, and what is known of the blocks."""
        lean = blocks.select("block", "doc_id", "text")
        levels = self._read("home BIGINT, block BIGINT, n INT, body BINARY", "home", "level", {x["number"]: x["path"] for x in at["levels"] if self._has(x["path"])})
        named = lean.groupBy("block").applyInArrow(_tidied(_name(self.shards)), _NAMED)
        scanned = named.groupBy("shard").cogroup(levels.groupBy("home")).applyInArrow(_tidied(_scan(merging)), _SCANNED)
        with cleaned(self.spark):
            self._write(scanned, f"{made}/scan", "home", "kind")
        told = self.spark.read.schema("home long, block long, n int, body binary, kind int").parquet(f"{made}/scan")
        of = lambda k: told.filter(F.col("kind") == k).select("block", "n", "body").groupBy("block")
        known = lean.groupBy("block").cogroup(of(0)).applyInArrow(_tidied(_sort_out(self.shards)), _SORTED)
        if at["batches"]:
            former = self._texts(at["batches"]).groupBy("block").cogroup(of(1))
            known = known.union(former.applyInArrow(_tidied(_fetch(self.shards)), _SORTED))
        with cleaned(self.spark):
            writer(known).partitionBy("kind").parquet(f"{made}/known")

    def _results(self, entry: dict) -> tuple[DataFrame, DataFrame]:
        known = self.spark.read.schema(f"{_SORTED.removeprefix('kind int, ')}, kind int").parquet(entry["known"])
        asked = known.filter("kind = 1").select("shard", "block", "q", "doc", "body")
        answers = asked.groupBy("shard").applyInArrow(_tidied(_compare), _ANSWER)
        own = known.filter("kind = 0").select("block", F.lit(None).cast("int").alias("n"), "body")
        return self._texts([entry], entry["kind"]), own.union(answers)

    def vacuum(self) -> None:
        """Delete levels that later ones have taken in; for when no writer is at work."""
        valid = {x["path"] for x in self.levels()}
        for content in self.commits.all():
            for x in content["levels"]:
                if x["path"] not in valid:
                    remove(self.spark, x["path"])


def _search(docs: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Blocks and what is known of them, batch by batch: ranges of ascending doc_ids, null ones in the last."""
    spark = docs.sparkSession
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    n = max(BATCHES, -(-(size or 0) // BATCH))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / n for k in range(1, n)], 1000 * n)).first()[0] or [] if rows else []
    index, low = SuffixIndex(spark, size=size or 0), None
    for high in [*sorted(set(cuts)), None]:
        part = F.lit(True) if low is None else F.col("doc_id") > low
        part = part & (F.col("doc_id") <= high) if high is not None else F.col("doc_id").isNull() | part
        yield index.add(docs.filter(part))
        low = high


def removals(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    done = [b.select("block", "doc_id", "text").groupBy("block").cogroup(k.groupBy("block")).applyInArrow(_tidied(_finish(whole=False)), schema) for b, k in _search(docs)]
    return reduce(DataFrame.union, done)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with those bytes dropped from ``text`` (what is left of a cut character goes too); other columns unchanged."""
    done = []
    for blocks, known in _search(docs):
        schema = blocks.select("doc_id", "text", "rest").schema
        done.append(blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_tidied(_finish(whole=True)), schema))
    done = reduce(DataFrame.union, done)
    return done.select(*[F.col(f"`{c}`") if c in ("doc_id", "text") else F.col(f"rest.`{c}`") for c in docs.columns])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``documents``, added to an index in batches of
    ascending doc_id. Null and empty texts have no bytes, texts of any length are read whole, rows with one doc_id (or
    null) keep what they share, an empty table gives no rows, other columns are not read."""
    return removals(table(spark, sf_dir, "documents"))


#: All windows as hexadecimal strings; hits less than a window apart are one run.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - {LENGTH - 1})) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
hit AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM w JOIN f USING (s) WHERE m < doc_id),
run AS (SELECT doc_id, p, count(*) FILTER (gap IS NULL OR gap > {LENGTH}) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM hit),
span AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM run GROUP BY doc_id, r),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM span),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head, max(b) AS tail, sum(b - a) AS removed, count(*) AS n
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
