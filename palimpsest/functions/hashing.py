"""The 32-bit key hash of the membership filters, and the generator behind the test fixtures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_M = 0xC6A4A793
_ALL = 0xFFFFFFFF


def _folded(h: int, data: bytes, at: int) -> int:
    """The hash of ``data`` from byte ``at`` on, continuing from ``h``."""
    whole = len(data) - len(data) % 4
    for k in range(at, whole, 4):
        h = (h + int.from_bytes(data[k : k + 4], "little")) * _M & _ALL
        h ^= h >> 16
    if len(data) > whole:
        h = (h + int.from_bytes(data[whole:], "little")) * _M & _ALL
        h ^= h >> 24
    return h


def hash32(data: bytes, seed: int) -> int:
    """Multiply-and-fold hash over little-endian words; sums wrap."""
    return _folded((seed ^ _M * len(data)) & _ALL, data, 0)


def hash32_many(values: list[bytes], seed: int, few: int = 16) -> np.ndarray:
    """Hash of each of many byte strings, one word of all of them at a time; what only few reach is done alone."""
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    sizes = np.array([len(values[i]) for i in order], dtype=np.uint64)
    words = (sizes // np.uint64(4)).astype(np.int64)
    flat = np.frombuffer(b"".join([values[i] for i in order]), dtype=np.uint8)
    place = (np.cumsum(sizes) - sizes).astype(np.int64)
    h = (np.uint64(seed) ^ sizes * np.uint64(_M)) & np.uint64(_ALL)
    together = int(words[few - 1]) if len(words) >= few else 0
    for t, n in enumerate(np.searchsorted(-words, -np.arange(together), side="left").tolist()):
        at = place[:n] + 4 * t
        word = sum(flat[at + k].astype(np.uint64) << np.uint64(8 * k) for k in range(4))
        h[:n] = (h[:n] + word) * np.uint64(_M) & np.uint64(_ALL)
        h[:n] ^= h[:n] >> np.uint64(16)
    out = np.empty(len(values), dtype=np.int64)
    # most rows only miss their last bytes
    tails = sizes.astype(np.int64) - 4 * words
    short = words <= together
    word = np.zeros(len(values), dtype=np.uint64)
    for k in range(3):
        has = short & (tails > k)
        word[has] += flat[place[has] + 4 * words[has] + k].astype(np.uint64) << np.uint64(8 * k)
    last = (h + word) * np.uint64(_M) & np.uint64(_ALL)
    h = np.where(short & (tails > 0), last ^ (last >> np.uint64(24)), h)
    out[order] = h.astype(np.int64)
    for k in np.flatnonzero(~short).tolist():
        out[order[k]] = _folded(int(h[k]), values[order[k]], 4 * together)
    return out


def _times_m(x: Column) -> Column:
    """``x * M mod 2^32`` in two halves, so that nothing overflows."""
    return (x * (_M & 0xFFFF) + ((x * (_M >> 16)).bitwiseAND(F.lit(0xFFFF)) * 65536)).bitwiseAND(F.lit(_ALL))


def hash_fixed32_col(value: Column, seed: int) -> Column:
    """Hash of the four-byte form of a number, without leaving the JVM."""
    start = (seed ^ _M * 4) & _ALL
    h = _times_m((F.lit(start).cast("long") + value.cast("long")).bitwiseAND(F.lit(_ALL)))
    return h.bitwiseXOR(F.shiftright(h, 16))


def hash32_col(data: Column, seed: int) -> Column:
    """Hash of any bytes."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        out = pd.array([None] * len(values), dtype="Int64")
        if known.any():
            out[known] = hash32_many([bytes(x) for x in values[known]], seed)
        return pd.Series(out)

    return run(data)


class Random:
    """Lehmer generator (16807 modulo 2^31 - 1)."""

    def __init__(self, seed: int):
        seed &= 0x7FFFFFFF
        self.state = 1 if seed in (0, 0x7FFFFFFF) else seed

    def next(self) -> int:
        self.state = self.state * 16807 % 0x7FFFFFFF
        return self.state

    def uniform(self, n: int) -> int:
        return self.next() % n

    def one_in(self, n: int) -> bool:
        return self.uniform(n) == 0

    def skewed(self, max_log: int) -> int:
        """Uniform below a power of two whose exponent is uniform up to ``max_log``."""
        return self.uniform(1 << self.uniform(max_log + 1))
