"""SetSketch registers: exponentially spaced truncated minima.

Register i of a set is ``max over elements of floor(1 - log_b x_i)``, cut to
0..q+1, where ``x_i`` is exponential with rate ``a`` and comes from a hash of
the element (Ertl, "SetSketch: Filling the Gap between MinHash and
HyperLogLog", VLDB 2021).  Registers of a union are the larger of both, and
equal registers are the likelier the more the sets share.
"""

from __future__ import annotations

import numpy as np

BASE, RATE, LIMIT = 1.001, 20.0, 65_534
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS

_rng = np.random.default_rng(20_260_105)
_FLIP = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_KEYS = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a set of 64-bit hashes; all 0 for the empty set."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        u = low[at : at + 1024, None] ^ _FLIP
        u *= _TIMES
        np.minimum(least, u.min(0), out=least)
    x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    x = registers.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = (x * _KEYS).sum(2, dtype=np.uint64)
    key ^= key >> np.uint64(32)
    key *= np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    return key + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def similarity(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sets of known sizes.

    ``above`` and ``below`` count the registers where the first set's value is
    larger and smaller.  The likelihood is concave; a ternary search finds its
    top.
    """
    n_a, n_b = np.asarray(n_a, float), np.asarray(n_b, float)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    same = REGISTERS - above - below
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        more, less = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return above * np.log(more) + below * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-12))

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (hi - lo) / 3
        left = likelihood(lo + third) < likelihood(hi - third)
        lo, hi = np.where(left, lo + third, lo), np.where(left, hi, hi - third)
    return (lo + hi) / 2
