"""Write batches: ordered puts and deletes that take consecutive sequence numbers.

Encoded form: base sequence (8 bytes), count (4 bytes), then each operation as a type byte, the
sized key and, for a put, the sized value.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.errors import Corruption
from palimpsest.functions.codec import DELETION, VALUE, fixed, read_fixed, read_sized, sized, varint_length, varint_length_col

HEADER = 12
OPS = "op_index bigint, type int, user_key binary, value binary"


class Handler(Protocol):
    def put(self, key: bytes, value: bytes) -> None: ...

    def delete(self, key: bytes) -> None: ...


class WriteBatch:
    """A batch on the driver."""

    def __init__(self, ops: list[tuple[bytes, bytes | None]] | None = None, sequence: int = 0):
        self.ops, self.sequence = list(ops or []), sequence

    @property
    def count(self) -> int:
        return len(self.ops)

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self.ops.append((key, value))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self.ops.append((key, None))
        return self

    def clear(self) -> None:
        self.ops, self.sequence = [], 0

    def append(self, other: WriteBatch) -> None:
        """The other's operations after ours; our sequence stays."""
        self.ops += other.ops

    def byte_size(self) -> int:
        part = lambda x: varint_length(len(x)) + len(x)
        return HEADER + sum(1 + part(k) + (0 if v is None else part(v)) for k, v in self.ops)

    def contents(self) -> bytes:
        body = b"".join(bytes([DELETION]) + sized(k) if v is None else bytes([VALUE]) + sized(k) + sized(v) for k, v in self.ops)
        return fixed(self.sequence, 8) + fixed(self.count, 4) + body

    @classmethod
    def from_contents(cls, data: bytes, lenient: bool = False) -> WriteBatch:
        """Decode; a fault raises Corruption, or if ``lenient`` ends the batch before it."""
        out = cls()
        try:
            for key, value in operations(data):
                out.ops.append((key, value))
        except Corruption:
            if not lenient:
                raise
        out.sequence = read_fixed(data, 8) if len(data) >= HEADER else 0
        return out

    def iterate(self, handler: Handler) -> None:
        for key, value in self.ops:
            if value is None:
                handler.delete(key)
            else:
                handler.put(key, value)

    def rows(self) -> list[tuple[bytes, int, int, bytes | None]]:
        """Version rows; operation i gets sequence base + i, deletes included."""
        return [(k, self.sequence + i, DELETION if v is None else VALUE, v) for i, (k, v) in enumerate(self.ops)]

    def versions(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "user_key binary, seq bigint, type int, value binary")


def operations(data: bytes) -> Iterator[tuple[bytes, bytes | None]]:
    """Operations of an encoded batch up to the first fault, which raises Corruption."""
    if len(data) < HEADER:
        raise Corruption("malformed WriteBatch (too small)")
    at = seen = HEADER
    seen = 0
    while at < len(data):
        kind = data[at]
        if kind not in (DELETION, VALUE):
            raise Corruption(f"unknown WriteBatch tag {kind}")
        name = "Put" if kind == VALUE else "Delete"
        parts, at = [], at + 1
        for _ in range(kind + 1):
            if (got := read_sized(data, at)) is None:
                raise Corruption(f"bad WriteBatch {name}")
            parts.append(got[0])
            at += got[1]
        seen += 1
        yield parts[0], parts[1] if kind == VALUE else None
    if seen != read_fixed(data, 4, 8):
        raise Corruption("WriteBatch has wrong count")


# ---- batches as DataFrames (op_index, type, user_key, value) ----


def apply(ops: DataFrame, base: int | Column) -> DataFrame:
    """Version rows of a batch."""
    start = F.lit(base).cast("long") if isinstance(base, int) else base
    return ops.select("user_key", (start + F.col("op_index")).alias("seq"), "type", "value")


def append(left: DataFrame, right: DataFrame) -> DataFrame:
    """The right batch's operations after the left's."""
    width = left.agg(F.coalesce(F.max("op_index") + 1, F.lit(0)).alias("_shift"))
    # one row, of one number
    moved = right.crossJoin(F.broadcast(width)).withColumn("op_index", F.col("op_index") + F.col("_shift")).drop("_shift")
    return left.unionByName(moved)


def encoded_size(ops: DataFrame) -> DataFrame:
    """``byte_size, op_count`` of the encoded batch, without encoding it."""
    part = lambda c: varint_length_col(F.octet_length(c)) + F.octet_length(c)
    one = 1 + part("user_key") + F.when(F.col("type") == VALUE, part("value")).otherwise(0)
    return ops.agg((F.lit(HEADER) + F.coalesce(F.sum(one), F.lit(0))).cast("long").alias("byte_size"), F.count(F.lit(1)).alias("op_count"))


#: Bytes, and operations, that Python makes before it hands them on.
CHUNK_BYTES, CHUNK_OPS = 4 << 20, 10_000


def encode(ops: DataFrame, group: str, base: str) -> DataFrame:
    """``group, contents``: one encoded batch for each group; a batch is one value and so must fit in memory.

    Python unpacks one batch at a time.
    """
    ordered = F.array_sort(F.collect_list(F.struct("op_index", "type", F.col("user_key").cast("binary").alias("k"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("v"))))
    lists = ops.groupBy(group).agg(F.min(base).cast("long").alias("_base"), ordered.alias("_ops"))
    schema = T.StructType([lists.schema[group], T.StructField("contents", T.BinaryType())])

    def run(parts):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def made(part, begin: int, contents: list[bytes]):
            return pa.RecordBatch.from_arrays([part.column(0).slice(begin, len(contents)).cast(arrow[0].type), pa.array(contents, type=arrow[1].type)], schema=arrow)

        for part in parts:
            contents, held, begin = [], 0, 0
            for i, start in enumerate(part.column(1).to_pylist()):
                _, kinds, keys, values = (x.to_pylist() for x in part.column(2)[i].values.flatten())
                contents.append(WriteBatch([(k, v if t == VALUE else None) for t, k, v in zip(kinds, keys, values, strict=True)], start).contents())
                held += len(contents[-1])
                if held >= CHUNK_BYTES:
                    yield made(part, begin, contents)
                    contents, held, begin = [], 0, i + 1
            if contents:
                yield made(part, begin, contents)

    return _in_small_batches(lists).mapInArrow(run, schema)


def _in_small_batches(df: DataFrame) -> DataFrame:
    """``df``; rows come to Python in Arrow batches of about 4 MB, unless the session has set a size of its own."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if spark.conf.get(name) in ("67108864b", "64MB", "64m"):
        spark.conf.set(name, str(CHUNK_BYTES))
    return df


def decode(batches: DataFrame, keep: list[str], lenient: bool = False) -> DataFrame:
    """``keep``, ``base``, and one row for each operation of the encoded ``contents``."""
    kept = [batches.schema[c] for c in keep]
    names = [*keep, "base", "op_index", "type", "user_key", "value"]

    def found(data: bytes):
        try:
            yield from operations(data)
        except Corruption:
            if not lenient:
                raise

    def run(parts):
        for pdf in parts:
            rows = []
            for values in pdf.itertuples(index=False):
                *carried, data = values
                data = bytes(data)
                base = read_fixed(data, 8) if len(data) >= HEADER else 0
                for i, (k, v) in enumerate(found(data)):
                    rows.append((*carried, base, i, VALUE if v is not None else DELETION, k, v))
                    if len(rows) >= CHUNK_OPS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["base bigint", OPS])
    return _in_small_batches(batches.select(*keep, "contents")).mapInPandas(run, schema)
