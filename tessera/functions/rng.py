"""Seeded random choices that any SQL engine can repeat: the first 32 bits of an MD5 of a text that names the choice."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def h32(*parts: Column | str | int) -> Column:
    """The hash of the parts, joined by colons, as a BIGINT."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def h32_of(*parts: object) -> int:
    """The same for Python values."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@lru_cache(maxsize=4)
def permutation(n: int, seed: int) -> np.ndarray:
    """Position of each of n padded individuals: their rank by hash, ties by index."""
    order = sorted(range(n), key=lambda i: (h32_of("perm", seed, i), i))
    out = np.empty(n, np.int64)
    out[order] = np.arange(n)
    return out


@lru_cache(maxsize=4)
def pads(n: int, padded: int, seed: int) -> np.ndarray:
    """The individual, sampled with replacement, that stands at each position past the last individual."""
    return np.array([h32_of("pad", seed, p) % n for p in range(n, padded)], np.int64)


@lru_cache(maxsize=1 << 16)
def fill_targets(k: int, round_: int, seed: int) -> np.ndarray:
    """The bin that each bin would fill in a round of densification."""
    return np.array([h32_of("fill", seed, round_, i) % k for i in range(k)], np.int64)
