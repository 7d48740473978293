"""Hashes of runs of characters, for whole batches of code points at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _powers(n: int = 1 << 14) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0xD1342543DE82EF95, np.uint64))


def scrambled(values: np.ndarray) -> np.ndarray:
    """A random-looking number for each value."""
    with np.errstate(over="ignore"):
        x = (values.astype(np.uint64) + np.uint64(1)) * ODD
        x ^= x >> np.uint64(32)
        return x * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of members, where in them each run of neighbours in one row begins, and the row of each run."""
    where = np.flatnonzero(member)
    if not len(where):
        zero = np.zeros(0, np.int64)
        return where, zero, zero
    fresh = np.ones(len(where), bool)
    fresh[1:] = np.diff(where) > 1
    bounds = np.searchsorted(where, offsets[1:-1])
    fresh[bounds[bounds < len(where)]] = True
    start = np.flatnonzero(fresh)
    return where, start, np.searchsorted(offsets, where[start], side="right") - 1


def hashes(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of each run of values: of what stands where in it."""
    if not len(start):
        return np.zeros(0, np.uint64)
    rank = np.arange(len(values)) - np.repeat(start, np.diff(np.r_[start, len(values)]))
    power = _powers()
    with np.errstate(over="ignore"):
        far = rank >= len(power)
        weight = power[np.where(far, rank % len(power), rank)]
        if far.any():
            weight = weight + (rank // len(power)).astype(np.uint64) * (ODD + np.uint64(1))
        return np.add.reduceat(scrambled(values) * weight, start)
