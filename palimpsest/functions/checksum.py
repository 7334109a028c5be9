"""Castagnoli CRC-32 and its masked form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_POLYNOMIAL = 0x82F63B78
_MASK_DELTA = 0xA282EAD8
_ALL = 0xFFFFFFFF


def _tables() -> list[list[int]]:
    first = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (_POLYNOMIAL if n & 1 else 0)
        first.append(n)
    out = [first]
    for _ in range(3):
        out.append([first[x & 255] ^ x >> 8 for x in out[-1]])
    return out


_T0, _T1, _T2, _T3 = _tables()


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC of ``data``, continuing from ``crc``; four bytes a step."""
    crc ^= _ALL
    whole = len(data) & ~3
    words = memoryview(data)[:whole].cast("I") if whole else ()
    for w in words:
        crc ^= w
        crc = _T3[crc & 255] ^ _T2[crc >> 8 & 255] ^ _T1[crc >> 16 & 255] ^ _T0[crc >> 24]
    for b in data[whole:]:
        crc = _T0[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ _ALL


def mask(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + _MASK_DELTA) & _ALL


def unmask(masked: int) -> int:
    rot = (masked - _MASK_DELTA) & _ALL
    return (rot >> 17 | rot << 15) & _ALL


#: Bytes of one chunk, and bytes that are worked on together.
_CHUNK, _TOGETHER = 32, 1 << 20


def _shifts() -> list[np.ndarray]:
    """For each b, four tables of 256 that move a register past 2^b zero bytes."""
    first = np.array(_T0, dtype=np.uint32)
    v = np.arange(256, dtype=np.uint32)
    out = [np.stack([first, *[v << 8 * (k - 1) for k in (1, 2, 3)]])]
    for _ in range(39):
        out.append(_shift(out[-1], out[-1]))
    return out


def _shift(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


_SHIFTS = _shifts()


def _places() -> np.ndarray:
    """For each place in a chunk, what a byte there adds to the register at the chunk's end."""
    rows = [np.array(_T0, dtype=np.uint32)]
    while len(rows) < _CHUNK:
        rows.append(_shift(_SHIFTS[0], rows[-1]))
    return np.stack(rows[::-1])


_PLACES = _places()


def _moved(crc: np.ndarray, units: np.ndarray, unit_bits: int) -> np.ndarray:
    """Each register moved past its number of units of 2^unit_bits zero bytes."""
    for b in range(int(units.max(initial=0)).bit_length()):
        at = np.flatnonzero(units >> b & 1)
        crc[at] = _shift(_SHIFTS[b + unit_bits], crc[at])
    return crc


def crc32c_many(values: list, begin: np.ndarray) -> np.ndarray:
    """CRC of each of many byte strings, continuing from those in ``begin``; steps are numpy's, whatever the lengths."""
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    begin = np.asarray(begin, dtype=np.int64)
    out = np.empty(len(values), dtype=np.int64)
    block = np.cumsum(sizes) // _TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(values)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if int(sizes[a:b].sum()) < 1024:
            out[a:b] = [crc32c(v, c) for v, c in zip(values[a:b], begin[a:b].tolist(), strict=True)]
        else:
            out[a:b] = _crc32c_block(values[a:b], sizes[a:b], begin[a:b])
    return out


def _crc32c_block(values: list, sizes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A CRC is linear: bytes add to the register by their place in a chunk, chunks by the number of chunks after them.

    Values are filled up to whole chunks with zeros in front, which don't count without a start value.
    """
    chunks = -(-sizes // _CHUNK)
    zeros = bytes(_CHUNK)
    filled = []
    for v, pad in zip(values, (chunks * _CHUNK - sizes).tolist(), strict=True):
        filled.append(zeros[:pad])
        filled.append(v)
    places = np.ascontiguousarray(np.frombuffer(b"".join(filled), dtype=np.uint8).reshape(-1, _CHUNK).T)
    crc = _PLACES[0][places[0]]
    for table, here in zip(_PLACES[1:], places[1:], strict=True):
        crc ^= table[here]
    after = np.repeat(np.cumsum(chunks), chunks) - 1 - np.arange(len(crc))
    crc = _moved(crc, after, _CHUNK.bit_length() - 1)
    out = _moved((begin ^ _ALL).astype(np.uint32), sizes, 0)
    some = np.flatnonzero(chunks)
    out[some] ^= np.bitwise_xor.reduceat(crc, (np.cumsum(chunks) - chunks)[some])
    return (out ^ np.uint32(_ALL)).astype(np.int64)


def crc32c_col(data: Column, start: Column | None = None) -> Column:
    """``BIGINT`` CRC of bytes; ``start`` continues an earlier one."""

    @F.pandas_udf("long")
    def run(values: pd.Series, begin: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        out = pd.array([None] * len(values), dtype="Int64")
        if known.any():
            out[known] = crc32c_many([bytes(x) for x in values[known]], begin[known].to_numpy(dtype=np.int64))
        return pd.Series(out)

    return run(data, F.lit(0).cast("long") if start is None else start)


def mask_col(crc: Column) -> Column:
    rotated = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc.bitwiseAND(F.lit(0x7FFF)), 17))
    return (rotated + _MASK_DELTA).bitwiseAND(F.lit(_ALL))


def unmask_col(masked: Column) -> Column:
    rot = (masked + ((1 << 32) - _MASK_DELTA)).bitwiseAND(F.lit(_ALL))
    return F.shiftright(rot, 17).bitwiseOR(F.shiftleft(rot.bitwiseAND(F.lit(0x1FFFF)), 15))
