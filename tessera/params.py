"""Parameters and their checks; messages start alike for all entry points."""

from __future__ import annotations

from dataclasses import dataclass


def check_individuals(n: int) -> None:
    if n <= 1:
        raise ValueError(f"ERROR: number of individuals must be greater than 1 (got {n})")


def check_counts(n_values: int, n: int) -> None:
    check_individuals(n)
    if not n_values:
        raise ValueError("ERROR: empty vector of minor allele counts")
    if n_values % n:
        raise ValueError(f"ERROR: length of allele count vector ({n_values}) must be divisible by the number of individuals ({n})")


@dataclass(frozen=True)
class Sketching:
    """One-permutation hashing: ``k`` sketches of ``n`` individuals; ``seed`` fixes all random choices."""

    n: int
    k: int
    seed: int = 0

    def __post_init__(self):
        check_individuals(self.n)
        if self.k < 3:
            raise ValueError(f"ERROR: sketch number must be at least three (got {self.k})")
        if self.k > self.n:
            raise ValueError(f"ERROR: sketch number ({self.k}) must not exceed the number of individuals ({self.n})")
        if self.k >= 65535:
            raise ValueError(f"ERROR: sketch number ({self.k}) must be smaller than 65535")

    @property
    def size(self) -> int:
        """Positions of one bin."""
        return -(-self.n // self.k)

    @property
    def padded(self) -> int:
        return self.k * self.size


@dataclass(frozen=True)
class Sparsity:
    """``rows`` sketches make a band; pairs under ``cutoff`` are left out."""

    rows: int
    cutoff: float = 0.0

    def check(self, k: int) -> None:
        if self.rows <= 0:
            raise ValueError("ERROR: number of rows per band must be positive")
        if self.rows >= k:
            raise ValueError(f"ERROR: number of rows per band ({self.rows}) must be less than the number of sketches ({k})")
