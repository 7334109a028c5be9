"""Binary codecs, as plain Python for the driver and as Spark columns.

Columns stay in the JVM where Spark can express the codec; variable-length and unsigned 64-bit
decoding are Arrow UDFs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.errors import Corruption, InvalidArgument

MAX_SEQUENCE = (1 << 56) - 1
DELETION, VALUE = 0, 1

# ---- plain Python ----


def fixed(value: int, width: int) -> bytes:
    return (value & ((1 << (8 * width)) - 1)).to_bytes(width, "little")


def read_fixed(data: bytes, width: int, at: int = 0) -> int:
    if len(data) - at < width:
        raise InvalidArgument(f"{width} bytes are needed")
    return int.from_bytes(data[at : at + width], "little")


def varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(data: bytes, at: int = 0, bits: int = 64) -> tuple[int, int] | None:
    """Value and bytes used, or None if cut short or too long; bits beyond ``bits`` are lost."""
    value = 0
    for used, byte in enumerate(data[at : at + (bits + 6) // 7], 1):
        value |= (byte & 127) << (7 * (used - 1))
        if byte < 128:
            return value & ((1 << bits) - 1), used
    return None


def varint_length(value: int) -> int:
    return max(1, (value.bit_length() + 6) // 7)


def sized(data: bytes) -> bytes:
    return varint(len(data) & 0xFFFFFFFF) + data


def read_sized(data: bytes, at: int = 0) -> tuple[bytes, int] | None:
    """Slice and bytes used, or None if cut short."""
    head = read_varint(data, at, 32)
    if head is None or at + head[1] + head[0] > len(data):
        return None
    start = at + head[1]
    return data[start : start + head[0]], head[1] + head[0]


def internal_key(user_key: bytes, seq: int, kind: int) -> bytes:
    """User key followed by sequence and type in eight bytes."""
    if not 0 <= seq <= MAX_SEQUENCE or kind not in (DELETION, VALUE):
        raise InvalidArgument(f"sequence {seq}, type {kind}")
    return user_key + fixed(seq << 8 | kind, 8)


def parse_internal_key(data: bytes) -> tuple[bytes, int, int] | None:
    """User key, sequence and type; None if shorter than the tag."""
    if len(data) < 8:
        return None
    tag = read_fixed(data, 8, len(data) - 8)
    if tag & 255 not in (DELETION, VALUE):
        raise Corruption(f"unknown value type {tag & 255}")
    return data[:-8], tag >> 8, tag & 255


def lookup_key(user_key: bytes, snap: int) -> bytes:
    """Sized internal key that seeks the newest version visible at ``snap``."""
    return sized(internal_key(user_key, snap, VALUE))


# ---- columns ----


def _little(hexed: Column, width: int) -> Column:
    padded = F.lpad(hexed, 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(padded, 2 * i - 1, 2) for i in range(width, 0, -1)]))


def fixed32_col(value: Column) -> Column:
    """Four bytes, least first, of a number's lowest 32 bits."""
    return _little(F.hex(value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 4)


def fixed64_col(value: Column) -> Column:
    """Eight bytes, least first; takes ``BIGINT`` or ``DECIMAL(20,0)`` below 2^64."""
    wide = value.cast("decimal(20,0)")
    unit = F.lit(1 << 32).cast("decimal(20,0)")
    high = F.floor(wide / unit).cast("long")
    low = (wide % unit).cast("long")
    return F.concat(_little(F.hex(low), 4), _little(F.hex(high), 4))


def read_fixed_col(data: Column, width: int) -> Column:
    """``DECIMAL(20,0)`` of the first ``width`` bytes; null if there are fewer."""
    hexed = F.hex(F.substring(data, 1, width))
    big = F.concat(*[F.substring(hexed, 2 * i - 1, 2) for i in range(width, 0, -1)])
    return F.when(F.length(data) >= width, F.conv(big, 16, 10).cast("decimal(20,0)"))


def varint_length_col(value: Column) -> Column:
    """Bytes that the variable-length form of a non-negative number takes."""
    wide = value.cast("decimal(20,0)")
    out = F.lit(10)
    for n in range(9, 0, -1):
        out = F.when(wide < F.lit(str(1 << (7 * n))).cast("decimal(20,0)"), n).otherwise(out)
    return out


def varint_col(value: Column) -> Column:
    """Variable-length form of a ``BIGINT`` that isn't negative."""
    v, n = value.cast("long"), varint_length_col(value)
    digits = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(F.call_function("shiftright", v, (i * 7).cast("int")).bitwiseAND(F.lit(127)) + F.when(i < n - 1, 128).otherwise(0)), 2, "0"))
    return F.unhex(F.array_join(digits, ""))


def sized_col(data: Column) -> Column:
    return F.concat(varint_col(F.length(data)), data)


def internal_key_col(user_key: Column, seq: Column, kind: Column) -> Column:
    checked = F.when(seq.between(0, MAX_SEQUENCE) & kind.isin(0, 1), kind).otherwise(F.raise_error(F.lit("InvalidArgument: sequence or type out of range")).cast("int"))
    sequence = F.substring(_little(F.hex(seq.cast("long")), 8), 1, 7)
    return F.concat(user_key, F.unhex(F.lpad(F.hex(checked.cast("long")), 2, "0")), sequence)


def lookup_key_col(user_key: Column, snap: Column) -> Column:
    """Struct (memtable_key, internal_key, user_key): the three views of the key that seeks the newest version visible at ``snap``."""
    key = internal_key_col(user_key, snap, F.lit(VALUE))
    return F.struct(sized_col(key).alias("memtable_key"), key.alias("internal_key"), user_key.alias("user_key"))


def user_key_col(key: Column) -> Column:
    """An internal key without its tag."""
    return F.substring(key, F.lit(1), F.length(key) - 8)


def parse_internal_key_col(key: Column) -> Column:
    """Struct (user_key, seq, type), null for fewer than eight bytes; other types raise Corruption."""
    n = F.length(key)
    kind = F.conv(F.hex(F.substring(key, n - 7, F.lit(1))), 16, 10).cast("int")
    seq = read_fixed_col(F.concat(F.substring(key, n - 6, F.lit(7)), F.unhex(F.lit("00"))), 8).cast("long")
    checked = F.when(kind.isin(0, 1), kind).otherwise(F.raise_error(F.lit("Corruption: unknown value type")).cast("int"))
    return F.when(n >= 8, F.struct(user_key_col(key).alias("user_key"), seq.alias("seq"), checked.alias("type")))


def _decoder(bits: int):
    @F.pandas_udf("value decimal(20,0), used int")
    def read(data: pd.Series) -> pd.DataFrame:
        from decimal import Decimal

        got = [None if x is None else read_varint(bytes(x), 0, bits) for x in data]
        return pd.DataFrame({"value": [None if g is None else Decimal(g[0]) for g in got], "used": pd.array([None if g is None else g[1] for g in got], dtype="Int32")})

    return read


def read_varint_col(data: Column, bits: int = 64) -> Column:
    """Struct (value, used); both null if the bytes are cut short or too long."""
    return _decoder(bits)(data)


def varint_wide_col(value: Column) -> Column:
    """Variable-length form of any unsigned 64-bit number."""

    @F.pandas_udf("binary")
    def write(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else varint(int(v)))

    return write(value.cast("decimal(20,0)"))


def read_sized_col(data: Column) -> Column:
    """Struct (slice, used); both null if cut short."""

    @F.pandas_udf("slice binary, used int")
    def read(values: pd.Series) -> pd.DataFrame:
        got = [None if x is None else read_sized(bytes(x)) for x in values]
        return pd.DataFrame({"slice": [None if g is None else g[0] for g in got], "used": pd.array([None if g is None else g[1] for g in got], dtype="Int32")})

    return read(data)
