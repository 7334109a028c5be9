"""Key orders: unsigned bytes, and internal keys (user key up, sequence and type down)."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.codec import MAX_SEQUENCE, VALUE, internal_key, parse_internal_key


class KeyOrder(Protocol):
    """An order of user keys. ``sort_key`` maps a key to a value whose plain order is this order."""

    name: str

    def compare(self, a: bytes, b: bytes) -> int: ...

    def sort_key(self, key: Column) -> Column: ...

    def separator(self, start: bytes, limit: bytes) -> bytes: ...

    def successor(self, key: bytes) -> bytes: ...


class Bytewise:
    """Unsigned lexicographic order, which is Spark's own order of ``BINARY``."""

    name = "palimpsest.bytewise"

    def compare(self, a: bytes, b: bytes) -> int:
        return (a > b) - (a < b)

    def sort_key(self, key: Column) -> Column:
        return key

    def separator(self, start: bytes, limit: bytes) -> bytes:
        """A short key in ``[start, limit)``, where raising the first differing byte gives one."""
        at = next((i for i, (x, y) in enumerate(zip(start, limit, strict=False)) if x != y), None)
        if at is None or start[at] == 255 or start[at] + 1 >= limit[at]:
            return start
        return start[:at] + bytes([start[at] + 1])

    def successor(self, key: bytes) -> bytes:
        """A short key not below ``key``."""
        at = next((i for i, x in enumerate(key) if x != 255), None)
        return key if at is None else key[:at] + bytes([key[at] + 1])


class Reversed(Bytewise):
    """Descending bytes: an example of a custom order through a derived sort key."""

    name = "palimpsest.reversed"

    def compare(self, a: bytes, b: bytes) -> int:
        return (a < b) - (a > b)

    def sort_key(self, key: Column) -> Column:
        # complement of each byte as hexadecimal text, closed by a character above all digits, so that a prefix comes after what extends it
        return F.concat(F.translate(F.hex(key), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))

    def separator(self, start: bytes, limit: bytes) -> bytes:
        return start

    def successor(self, key: bytes) -> bytes:
        return key


class InternalOrder:
    """Internal keys over an order of user keys."""

    name = "palimpsest.internal"

    def __init__(self, user: KeyOrder | None = None):
        self.user = user or Bytewise()

    def compare(self, a: bytes, b: bytes) -> int:
        (ka, *ta), (kb, *tb) = parse_internal_key(a), parse_internal_key(b)
        return self.user.compare(ka, kb) or (ta < tb) - (ta > tb)

    def columns(self, key: str = "user_key", seq: str = "seq", kind: str = "type") -> list[Column]:
        """Sort columns for a version table; never a packed tag, which has the sign bit."""
        return [self.user.sort_key(F.col(key)).asc(), F.col(seq).desc(), F.col(kind).desc()]

    def ascending(self, key: str = "user_key", seq: str = "seq", kind: str = "type") -> list[Column]:
        """Values whose ascending order is this order."""
        return [self.user.sort_key(F.col(key)), -F.col(seq), -F.col(kind)]

    def _shortened(self, key: bytes, made: bytes, user: bytes) -> bytes:
        if len(made) < len(user) and self.user.compare(user, made) < 0:
            return internal_key(made, MAX_SEQUENCE, VALUE)
        return key

    def separator(self, start: bytes, limit: bytes) -> bytes:
        a, b = start[:-8], limit[:-8]
        return self._shortened(start, self.user.separator(a, b), a)

    def successor(self, key: bytes) -> bytes:
        return self._shortened(key, self.user.successor(key[:-8]), key[:-8])


def separator_col(start: Column, limit: Column, internal: bool = False) -> Column:
    order = InternalOrder() if internal else Bytewise()

    @F.pandas_udf("binary")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else order.separator(bytes(x), bytes(y)) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(start, limit)


def successor_col(key: Column, internal: bool = False) -> Column:
    order = InternalOrder() if internal else Bytewise()

    @F.pandas_udf("binary")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else order.successor(bytes(x)) for x in a], dtype=object)

    return run(key)
