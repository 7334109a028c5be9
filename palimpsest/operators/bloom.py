"""Membership filters: a bit array and a last byte with the number of probes."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.codec import user_key_col
from palimpsest.functions.hashing import hash32, hash32_col

SEED = 0xBC9F1D34
_ALL = 0xFFFFFFFF


class FilterPolicy(Protocol):
    name: str

    def create(self, keys: Iterable[bytes]) -> bytes: ...

    def may_match(self, key: bytes, filter_: bytes) -> bool: ...


class BloomPolicy:
    """``bits_per_key`` bits for each key, and 0.69 times as many probes."""

    name = "palimpsest.bloom"

    def __init__(self, bits_per_key: int = 10):
        self.bits_per_key = bits_per_key
        self.probes = int(min(30, max(1, np.trunc(np.float32(bits_per_key) * np.float32(0.69)))))

    def bits(self, keys: int) -> int:
        return (max(64, keys * self.bits_per_key) + 7) // 8 * 8

    def create(self, keys: Iterable[bytes]) -> bytes:
        keys = list(keys)
        size = self.bits(len(keys))
        h = np.array([hash32(k, SEED) for k in keys], dtype=np.uint64)
        delta = (h >> np.uint64(17) | h << np.uint64(15)) & np.uint64(_ALL)
        array = np.zeros(size, dtype=np.uint8)
        for i in range(self.probes):
            array[((h + np.uint64(i) * delta) & np.uint64(_ALL)) % np.uint64(size)] = 1
        return np.packbits(array, bitorder="little").tobytes() + bytes([self.probes])

    def may_match(self, key: bytes, filter_: bytes) -> bool:
        if len(filter_) < 2:
            return False
        probes, size = filter_[-1], 8 * (len(filter_) - 1)
        if probes > 30:
            return True
        h = hash32(key, SEED)
        delta = (h >> 17 | h << 15) & _ALL
        spots = [(h + i * delta & _ALL) % size for i in range(probes)]
        return all(filter_[s // 8] >> s % 8 & 1 for s in spots)


class InternalKeyPolicy:
    """A policy over internal keys, which looks at the user key only."""

    def __init__(self, inner: FilterPolicy):
        self.inner, self.name = inner, inner.name

    def create(self, keys: Iterable[bytes]) -> bytes:
        return self.inner.create(k[:-8] for k in keys)

    def may_match(self, key: bytes, filter_: bytes) -> bool:
        return self.inner.may_match(key[:-8], filter_)


def probe_bits(h: Column, size: Column, probes: int) -> Column:
    """Array of bit numbers of a key with hash ``h`` in a filter of ``size`` bits."""
    delta = F.shiftright(h, 17).bitwiseOR(F.shiftleft(h.bitwiseAND(F.lit(0x1FFFF)), 15))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(probes - 1).cast("long")), lambda i: (h + i * delta).bitwiseAND(F.lit(_ALL)) % size)


def build_bits(keys: DataFrame, policy: BloomPolicy, group: str = "filter_id", hashed: Column | None = None) -> DataFrame:
    """``group, byte, mask``: the filter's bytes that aren't zero, one filter for each group.

    Bits are or-ed before they are dealt out, so a filter's size bounds what is moved.
    """
    h = hash32_col(F.col("key"), SEED) if hashed is None else hashed
    sizes = keys.groupBy(group).agg(F.greatest(F.lit(64), F.count(F.lit(1)) * policy.bits_per_key).alias("_n")).select(group, (F.floor((F.col("_n") + 7) / 8) * 8).cast("long").alias("bits"))
    spots = keys.withColumn("_h", h).join(sizes, group).select(group, F.explode(probe_bits(F.col("_h"), F.col("bits"), policy.probes)).alias("_bit"))
    byte, one = F.floor(F.col("_bit") / 8).cast("long"), F.call_function("shiftleft", F.lit(1), (F.col("_bit") % 8).cast("int"))
    return spots.select(group, byte.alias("byte"), one.alias("_one")).groupBy(group, "byte").agg(F.bit_or("_one").alias("mask"))


def may_match(probes: DataFrame, bits: DataFrame, sizes: DataFrame, policy: BloomPolicy, group: str = "filter_id", hashed: Column | None = None) -> DataFrame:
    """Rows of ``probes`` (group, key) with ``may_match``; ``sizes`` has each group's ``bits``."""
    h = hash32_col(F.col("key"), SEED) if hashed is None else hashed
    spots = probes.withColumn("_h", h).join(sizes.select(group, "bits"), group).select(group, "key", F.explode(F.array_distinct(probe_bits(F.col("_h"), F.col("bits"), policy.probes))).alias("_bit"))
    spots = spots.withColumn("byte", F.floor(F.col("_bit") / 8).cast("long"))
    set_ = F.coalesce(F.col("mask"), F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.col("_bit") % 8).cast("int"))) != 0
    return spots.join(bits, [group, "byte"], "left").groupBy(group, "key").agg(F.bool_and(set_).alias("may_match"))


def filters(keys: DataFrame, policy: BloomPolicy, group: str = "filter_id", internal: bool = False, hashed: Column | None = None) -> DataFrame:
    """``group, filter``: whole filters as bytes, the form other programs read; of internal keys only the user key counts.

    The filter's bytes that aren't zero are sorted and the gaps between them filled, without Python.
    """
    if internal:
        keys = keys.withColumn("key", user_key_col(F.col("key")))
    sizes = keys.groupBy(group).agg(F.greatest(F.lit(64), F.count(F.lit(1)) * policy.bits_per_key).alias("_n")).select(group, F.floor((F.col("_n") + 7) / 8).cast("int").alias("_bytes"))
    found = build_bits(keys, policy, group, hashed).groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col("byte").cast("int").alias("byte"), "mask"))).alias("_f"))
    before = lambda i: F.when(i > 0, F.get("_f", i - 1)["byte"]).otherwise(-1)
    zeros = lambda n: F.repeat(F.lit("00"), n.cast("int"))
    body = F.array_join(F.transform("_f", lambda e, i: F.concat(zeros(e["byte"] - before(i) - 1), F.lpad(F.hex(e["mask"].cast("long")), 2, "0"))), "")
    last = F.concat(zeros(F.col("_bytes") - F.element_at("_f", -1)["byte"] - 1), F.lit(f"{policy.probes:02X}"))
    return found.join(sizes, group).select(group, F.unhex(F.concat(body, last)).alias("filter"))
