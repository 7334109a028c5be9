"""The version table: every write is a row (user_key, seq, type, value); reads are queries over it.

Order of rows: user key up, then sequence down, then type down, so a value comes before a
deletion of the same sequence. Order is a property of a query, never of the table. ``(user_key,
seq, type)`` should be unique; if a table holds repeats, ``ingest_id`` (if present) decides, the
last one ingested first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.codec import DELETION, MAX_SEQUENCE, VALUE
from palimpsest.functions.ordering import InternalOrder
from palimpsest.operators import ranges

ABSENT, FOUND, DELETED = "ABSENT", "FOUND", "DELETED"
SCHEMA = "user_key binary, seq bigint, type int, value binary"
#: Rows of both sides of a join that one task takes.
JOINED = 500_000


def checked(df: DataFrame) -> DataFrame:
    """Raises Corruption on a row with a sequence or type out of range, or a value where none may be."""
    bad = ~F.col("seq").between(0, MAX_SEQUENCE) | ~F.col("type").isin(DELETION, VALUE) | F.col("user_key").isNull()
    bad = F.coalesce(bad, F.lit(True)) | (F.col("value").isNull() != (F.col("type") == DELETION))
    return df.withColumn("type", F.when(bad, F.raise_error(F.lit("Corruption: bad version row")).cast("int")).otherwise(F.col("type")))


def _status(kind: Column) -> Column:
    return F.when(kind.isNull(), ABSENT).when(kind == DELETION, DELETED).otherwise(FOUND)


@dataclass
class VersionTable:
    """A view over a version DataFrame. Nothing is computed before a result is used."""

    df: DataFrame
    order: InternalOrder

    def __init__(self, df: DataFrame, order: InternalOrder | None = None):
        self.df, self.order = df, order or InternalOrder()

    @classmethod
    def empty(cls, spark: SparkSession, schema: str = SCHEMA) -> VersionTable:
        return cls(spark.createDataFrame([], schema))

    @property
    def _tie(self) -> list[Column]:
        return [F.col("ingest_id").desc()] if "ingest_id" in self.df.columns else []

    @property
    def _later(self) -> list[Column]:
        return [-F.col("ingest_id")] if "ingest_id" in self.df.columns else []

    def _sorted(self, df: DataFrame, up: bool = True) -> DataFrame:
        forward = [*self.order.columns(), *self._tie]
        if up:
            return df.orderBy(*forward)
        # the exact reverse
        key, *_ = self.order.columns()
        tie = [F.col("ingest_id").asc()] if self._tie else []
        return df.orderBy(self.order.user.sort_key(F.col("user_key")).desc(), F.col("seq").asc(), F.col("type").asc(), *tie)

    def add(self, more: DataFrame) -> VersionTable:
        return VersionTable(self.df.unionByName(more, allowMissingColumns=True), self.order)

    def memory_usage(self) -> DataFrame:
        """Bytes of keys, tags and values."""
        return self.df.agg(F.coalesce(F.sum(F.octet_length("user_key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).alias("bytes"))

    # ---- lookups ----

    def get(self, key, snap: int = MAX_SEQUENCE) -> DataFrame:
        """One row (user_key, snap, seq, status, value): the newest version of ``key`` visible at ``snap``.

        Key and sequence reach the scan as pushed filters; a top-1 finds the row.
        """
        spark = self.df.sparkSession
        kind = self.df.schema["user_key"].dataType
        asked = spark.range(1).select(F.lit(key).cast(kind).alias("user_key"), F.lit(snap).cast("long").alias("snap"))
        newest = self.df.filter((F.col("user_key") == F.lit(key)) & (F.col("seq") <= snap)).orderBy(F.desc("seq"), F.desc("type"), *self._tie).limit(1).select("seq", "type", "value")
        # one row on each side
        return asked.join(newest, F.lit(True), "left").select("user_key", "snap", "seq", _status(F.col("type")).alias("status"), "value")

    def multi_get(self, lookups: DataFrame, span: int = 1 << 12) -> DataFrame:
        """``user_key, snap, seq, status, value`` for each row of ``lookups`` (user_key, snap).

        As-of search without a fan-out and without a hot key: a key's sequences are cut into
        spans. Within a span a window over versions and lookups together finds the newest
        version before each lookup. A lookup without one takes the newest version of the
        nearest earlier span, found in a table with one row for each key and span.
        """
        bucket = lambda c: F.floor(F.col(c) / span).cast("long")
        entry = F.struct("seq", "type", *(["ingest_id"] if self._tie else []), "value")
        versions = self.df.select("user_key", bucket("seq").alias("_b"), F.col("seq").alias("_at"), entry.alias("_v"))
        asked = lookups.select("user_key", bucket("snap").alias("_b"), F.col("snap").alias("_at"), F.lit(None).cast(versions.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_look"))
        both = versions.withColumn("_look", F.lit(0)).unionByName(asked)
        # of equal sequences the lookup comes last, and the version that counts just before it
        near = Window.partitionBy("user_key", "_b").orderBy("_at", "_look", F.col("_v.type"), *([F.col("_v.ingest_id")] if self._tie else [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = both.withColumn("_hit", F.last("_v", ignorenulls=True).over(near)).filter("_look = 1")
        ends = versions.groupBy("user_key", "_b").agg(F.max_by("_v", F.struct("_at", "_v.type", *(["_v.ingest_id"] if self._tie else []))).alias("_end"))
        spans = ends.select("user_key", "_b", "_end", F.lit(0).alias("_look")).unionByName(found.filter("_hit is null").select("user_key", "_b").distinct().select("user_key", "_b", F.lit(None).cast(versions.schema["_v"].dataType).alias("_end"), F.lit(1).alias("_look")))
        before = Window.partitionBy("user_key").orderBy("_b", F.desc("_look")).rowsBetween(Window.unboundedPreceding, -1)
        earlier = spans.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).filter("_look = 1").select("user_key", "_b", "_before")
        out = found.join(earlier, ["user_key", "_b"], "left").withColumn("_v", F.coalesce("_hit", "_before"))
        return out.select("user_key", F.col("_at").alias("snap"), F.col("_v.seq").alias("seq"), _status(F.col("_v.type")).alias("status"), F.col("_v.value").alias("value"))

    def snapshot(self, snap: int = MAX_SEQUENCE) -> DataFrame:
        """Live rows at ``snap``: newest visible version of each key, tombstones hidden.

        The rank's limit is applied before rows are dealt by key, so a key with many versions
        sends one row from each task.
        """
        newest = Window.partitionBy("user_key").orderBy(F.desc("seq"), F.desc("type"), *self._tie)
        ranked = self.df.filter(F.col("seq") <= snap).withColumn("_rank", F.row_number().over(newest))
        return ranked.filter((F.col("_rank") == 1) & (F.col("type") == VALUE)).select("user_key", "seq", "value")

    def contains(self, entries: DataFrame) -> DataFrame:
        """Those of ``entries`` (user_key, seq, type) that are in the table.

        Beyond :data:`JOINED` rows both sides are dealt to as many tasks as their rows need, so that what a
        task sorts doesn't grow with the table.
        """
        key = ["user_key", "seq", "type"]
        known = self.df.select(*key)
        parts = (entries.count() + known.count()) // JOINED + 1
        if parts > 1:
            entries, known = entries.repartition(parts, *key), known.repartition(parts, *key)
        return entries.join(known, key, "left_semi")

    # ---- the ordered cursor: all versions and tombstones ----

    def history(self) -> DataFrame:
        """Everything in order; a tombstone's value is read as empty bytes."""
        return self._sorted(self.df)

    def first(self) -> DataFrame:
        return self._sorted(self.df).limit(1)

    def last(self) -> DataFrame:
        return self._sorted(self.df, up=False).limit(1)

    def _at_least(self, key, seq: int, kind: int, strict: bool = False) -> Column:
        sort = self.order.user.sort_key
        here, there = sort(F.col("user_key")), sort(F.lit(key).cast(self.df.schema["user_key"].dataType))
        lower = (F.col("seq") < seq) | ((F.col("seq") == seq) & ((F.col("type") < kind) if strict else (F.col("type") <= kind)))
        return (here > there) | ((here == there) & lower)

    def seek(self, key, seq: int = MAX_SEQUENCE, kind: int = VALUE) -> DataFrame:
        """The first entry at or after an internal key."""
        return self._sorted(self.df.filter(self._at_least(key, seq, kind))).limit(1)

    def next(self, key, seq: int, kind: int) -> DataFrame:
        """The first entry after an internal key."""
        return self._sorted(self.df.filter(self._at_least(key, seq, kind, strict=True))).limit(1)

    def prev(self, key, seq: int, kind: int) -> DataFrame:
        """The greatest entry strictly before an internal key; empty before the first."""
        return self._sorted(self.df.filter(~self._at_least(key, seq, kind)), up=False).limit(1)

    def scan(self, low=None, high=None, snap: int | None = None, forward: bool = True) -> DataFrame:
        """Keys in ``[low, high)`` in order: raw entries, or live rows if a snapshot is given."""
        df = self.df if snap is None else VersionTable(self.df.filter(self._between(low, high)), self.order).snapshot(snap)
        key = self.order.user.sort_key(F.col("user_key"))
        df = df.filter(self._between(low, high))
        if snap is not None:
            return df.orderBy(key.asc() if forward else key.desc())
        return self._sorted(df, up=forward)

    def _between(self, low, high) -> Column:
        sort, kind = self.order.user.sort_key, self.df.schema["user_key"].dataType
        out = F.lit(True)
        if low is not None:
            out = out & (sort(F.col("user_key")) >= sort(F.lit(low).cast(kind)))
        if high is not None:
            out = out & (sort(F.col("user_key")) < sort(F.lit(high).cast(kind)))
        return out

    def numbered(self, name: str = "place") -> DataFrame:
        """All entries with their place (from 1) in the order."""
        return ranges.numbered(self.df, [*self.order.ascending(), *self._later], name)

    def neighbours(self) -> DataFrame:
        """Each entry with the internal keys before and after it (null at the ends)."""
        rows = ranges.with_neighbours(self.df, [*self.order.ascending(), *self._later], F.struct("user_key", "seq", "type"))
        p, n = F.col("_previous"), F.col("_next")
        return rows.select("user_key", "seq", "type", p["user_key"].alias("prev_key"), p["seq"].alias("prev_seq"), n["user_key"].alias("next_key"), n["seq"].alias("next_seq"))
