"""MurmurHash3 (32 bits) of 64-bit keys, as columns and as Python functions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public algorithm.
MASK = 0xFFFFFFFF
C1, C2 = 0xCC9E2D51, 0x1B873593
TIMES, PLUS = 5, 0xE6546B64
F1, F2 = 0x85EBCA6B, 0xC2B2AE35
KEY_BYTES = 8


def _times(x: Column, c: int) -> Column:
    """Product modulo 2**32 of a BIGINT below 2**32 and a constant, in halves so that nothing overflows."""
    high = F.shiftleft((x * F.lit(c >> 16)).bitwiseAND(0xFFFF), 16)
    return (x * F.lit(c & 0xFFFF) + high).bitwiseAND(F.lit(MASK))


def _turn(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseAND(F.lit(MASK)).bitwiseOR(F.shiftright(x, 32 - n))


def murmur_steps(low: Column, high: Column, seed: int) -> list[tuple[str, Column]]:
    """Columns to be added one after the other (each uses those before); the last one, ``hash``, is the result."""
    steps: list[tuple[str, Column]] = [("_h", F.lit(seed).cast("bigint"))]
    h, b = F.col("_h"), F.col("_b")
    for block in (low, high):
        steps += [("_b", _times(block.cast("bigint"), C1)), ("_b", _turn(b, 15)), ("_b", _times(b, C2)), ("_h", h.bitwiseXOR(b)), ("_h", _turn(h, 13))]
        steps += [("_h", (h * TIMES + F.lit(PLUS)).bitwiseAND(F.lit(MASK)))]
    steps += [("_h", h.bitwiseXOR(F.lit(KEY_BYTES).cast("bigint")))]
    for shift, factor in ((16, F1), (13, F2)):
        steps += [("_h", h.bitwiseXOR(F.shiftright(h, shift))), ("_h", _times(h, factor))]
    return [*steps, ("hash", h.bitwiseXOR(F.shiftright(h, 16)))]


def mixed(blocks: Iterable[int], h: int) -> int:
    for b in blocks:
        b = b * C1 & MASK
        b = (b << 15 | b >> 17) & MASK
        h ^= b * C2 & MASK
        h = (h << 13 | h >> 19) & MASK
        h = h * TIMES + PLUS & MASK
    return h


def finished(h: int) -> int:
    h ^= KEY_BYTES
    h = (h ^ h >> 16) * F1 & MASK
    h = (h ^ h >> 13) * F2 & MASK
    return h ^ h >> 16


def of_key(key: tuple[int, int], seed: int) -> int:
    """Hash of one key of two 32-bit blocks."""
    return finished(mixed(key, seed))


def of_indexes(key: Sequence[int], seed: int) -> int:
    """Hash of a list of indexes; each counts by its low 16 bits."""
    h = seed
    for x in key:
        h = mixed((x & 0xFFFF, 0), h)
    return finished(h)


def of_u32(key: Sequence[int], seed: int) -> int:
    """The same with a last round for the low byte of the last element if their number is odd, else for nothing."""
    whole = len(key) - len(key) % 2
    h = seed
    for x in key[:whole]:
        h = mixed((x & 0xFFFF, 0), h)
    return finished(mixed((key[-1] & 0xFF if len(key) % 2 else 0, 0), h))


def of_window(key: Sequence[int], start: int, length: int, seed: int) -> int:
    """Hash of every second 16-bit element of a window."""
    h = seed
    for x in key[start : start + length : 2]:
        h = mixed((x & 0xFFFF, 0), h)
    return finished(h)


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once: a lambda's variable stands for it."""
    return F.transform(F.array(value), f)[0]


def _step(h: Column, block: Column | None) -> Column:
    """One block; none is a block of zero, which leaves the value as it is before it is turned."""
    if block is not None:
        b = _bound(_times(block, C1), lambda x: _turn(x, 15))
        h = h.bitwiseXOR(_bound(b, lambda x: _times(x, C2)))
    return _bound(h, lambda x: (_turn(x, 13) * TIMES + F.lit(PLUS)).bitwiseAND(F.lit(MASK)))


def _finish(h: Column) -> Column:
    h = h.bitwiseXOR(F.lit(KEY_BYTES).cast("bigint"))
    folded = lambda n: lambda x: x.bitwiseXOR(F.shiftright(x, n))
    for shift, factor in ((16, F1), (13, F2)):
        h = _bound(h, folded(shift))
        h = _bound(h, (lambda c: lambda x: _times(x, c))(factor))
    return _bound(h, folded(16))


def _folded(blocks: Column, seed: int) -> Column:
    return _finish(F.aggregate(blocks, F.lit(seed).cast("bigint"), lambda h, x: _step(_step(h, x), None)))


def indexes(key: Column, seed: int) -> Column:
    """``of_indexes`` of an array column of whole numbers, on the JVM's side; an empty array has the hash of no block."""
    return _folded(F.transform(key, lambda x: x.cast("bigint").bitwiseAND(0xFFFF)), seed)


def u32(key: Column, seed: int) -> Column:
    """``of_u32`` of an array column."""
    odd = F.size(key) % 2 == 1
    last = F.when(odd, F.element_at(key, -1).cast("bigint").bitwiseAND(0xFF)).otherwise(F.lit(0).cast("bigint"))
    whole = F.slice(key, 1, F.size(key) - F.size(key) % 2)
    return _folded(F.concat(F.transform(whole, lambda x: x.cast("bigint").bitwiseAND(0xFFFF)), F.array(last)), seed)


def window(key: Column, start: int, length: int, seed: int) -> Column:
    """``of_window`` of an array column."""
    part = F.filter(F.slice(key, start + 1, length), lambda _, i: i % 2 == 0)
    return _folded(F.transform(part, lambda x: x.cast("bigint").bitwiseAND(0xFFFF)), seed)
