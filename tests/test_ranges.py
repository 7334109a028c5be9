"""Numbering and neighbours over many ranges equal the plain order; descending sort keys equal ``compare``."""

from functools import cmp_to_key

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions.ordering import InternalOrder, Reversed
from palimpsest.operators import ranges
from palimpsest.operators.versions import VersionTable


def _rows():
    # one key holds a third of the rows, some share an order, some are null
    return [(None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{i % 97:02d}", i) for i in range(1, 3001)]


def test_numbered_over_many_ranges(spark):
    df = spark.createDataFrame(_rows(), "k string, n long")
    got = ranges.numbered(df, [F.col("k"), -F.col("n")], rows=50)
    want = sorted(_rows(), key=lambda r: (r[0] is not None, r[0] or "", -r[1]))
    assert [(r.k, r.n) for r in got.orderBy("place").collect()] == want
    assert [r.place for r in got.orderBy("place").collect()] == list(range(1, 3001))
    sizes = [r["count"] for r in ranges.ranged(df, [F.col("k"), -F.col("n")], 50).groupBy("_part").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 500


def test_neighbours_over_many_ranges(spark):
    df = spark.createDataFrame(_rows(), "k string, n long")
    got = {r.n: (r._previous, r._next) for r in ranges.with_neighbours(df, [F.col("k"), -F.col("n")], F.col("n"), rows=50).collect()}
    want = [r[1] for r in sorted(_rows(), key=lambda r: (r[0] is not None, r[0] or "", -r[1]))]
    assert got == {n: (want[i - 1] if i else None, want[i + 1] if i + 1 < len(want) else None) for i, n in enumerate(want)}


def test_ranges_of_nothing(spark):
    none = spark.createDataFrame([], "k string, n long")
    assert ranges.numbered(none, [F.col("k")]).count() == 0
    assert ranges.with_neighbours(none, [F.col("k")], F.col("n")).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.binary(max_size=4) | st.lists(st.sampled_from([0, 1, 97, 254, 255]), max_size=5).map(bytes), min_size=2, max_size=40, unique=True))
def test_descending_sort_key_equals_compare(spark, keys):
    order = Reversed()
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary")
    got = [bytes(r.k) for r in df.orderBy(order.sort_key(F.col("k"))).collect()]
    assert got == sorted(keys, key=cmp_to_key(order.compare))


def test_descending_table_is_numbered(spark):
    keys = [b"a", b"a\x00", b"a\xff", b"b", b"", b"\x00", b"\xff"]
    df = spark.createDataFrame([(bytearray(k), s, 1, bytearray(b"v")) for k in keys for s in (1, 2)], "user_key binary, seq long, type int, value binary")
    table = VersionTable(df, InternalOrder(Reversed()))
    got = [(bytes(r.user_key), r.seq) for r in table.numbered().orderBy("place").collect()]
    assert got == [(k, s) for k in sorted(keys, reverse=True) for s in (2, 1)]
