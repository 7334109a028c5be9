"""Rows dealt into ranges of an order that the plan itself states, so that each run deals them alike.

Cut points are drawn from a bounded sample of the order's own values and become literals. A range
holds about ``rows`` rows whatever the distribution: an order that ends in a unique column cuts
through a key that holds a third of all rows as well. Only one row for each range (at most
:data:`MOST` of them) is brought together to number or to join neighbouring ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges at most, and sampled values for each.
MOST, PER_RANGE = 65_536, 8


def _constant(entries: str, kind) -> Column:
    """An array of values given as JSON; folded to one literal when the plan is made."""
    return F.from_json(F.lit(entries), kind)


def ranged(df: DataFrame, order: list[Column], rows: int = 200_000, name: str = "_part") -> DataFrame:
    """``df`` with ``name``: number of the row's range in the ascending order of ``order`` (nulls first)."""
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    total = df.count()
    parts = min(MOST, total // rows + 1)
    if parts == 1:
        return df.withColumn(name, F.lit(0).cast("long"))
    wanted = parts * PER_RANGE
    # about twice as many as wanted; the limit only bounds what chance could add
    sampled = df.select(key.alias("k")).sample(fraction=min(1.0, 2.0 * wanted / total), seed=7).limit(4 * wanted)
    kind = sampled.schema["k"].dataType
    ordered = [r["j"] for r in sampled.orderBy("k").select(F.to_json("k").alias("j")).collect()]
    cuts = [ordered[i] for i in sorted({i * len(ordered) // parts for i in range(1, parts)} - {0})]
    if not cuts:
        return df.withColumn(name, F.lit(0).cast("long"))
    # two levels: which group of cuts, then which cut in it
    fan = math.ceil(math.sqrt(len(cuts)))
    groups = [cuts[i : i + fan] for i in range(0, len(cuts), fan)]
    listed = lambda values: f"[{','.join(values)}]"
    tops = _constant(listed([g[0] for g in groups]), T.ArrayType(kind))
    inner = _constant(listed([listed(g) for g in groups]), T.ArrayType(T.ArrayType(kind)))
    below = lambda k, these: F.size(F.filter(these, lambda c: c <= k))

    def place(k: Column) -> Column:
        group = F.greatest(F.lit(1), below(k, tops))
        return F.transform(F.array(group), lambda g: (g - 1) * fan + below(k, F.get(inner, g - 1)))[0]

    return df.withColumn(name, F.transform(F.array(key), place)[0].cast("long"))


def numbered(df: DataFrame, order: list[Column], name: str = "place", rows: int = 200_000) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the ascending order of ``order``; no task holds more than one range."""
    dealt = ranged(df, order, rows)
    counts = dict(dealt.groupBy("_part").count().collect())  # one row for each range
    before, total = {}, 0
    for part in sorted(counts):
        before[part] = total
        total += counts[part]
    start = F.get(F.array(*[F.lit(before.get(i, 0)).cast("long") for i in range(max(counts, default=0) + 1)]), F.col("_part"))
    window = Window.partitionBy("_part").orderBy(*order)
    return dealt.withColumn(name, start + F.row_number().over(window)).drop("_part")


def with_neighbours(df: DataFrame, order: list[Column], entry: Column, rows: int = 200_000) -> DataFrame:
    """``df`` with ``_previous`` and ``_next``: ``entry`` of the rows before and after in the ascending order (null at the ends)."""
    dealt = ranged(df, order, rows).withColumn("_entry", entry).withColumn("_order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    ends = dealt.groupBy("_part").agg(F.min_by("_entry", "_order").alias("_first"), F.max_by("_entry", "_order").alias("_last"))
    found = sorted(ends.collect(), key=lambda r: r["_part"])  # one row for each range
    schema = f"_part long, _before {ends.schema['_last'].dataType.simpleString()}, _after {ends.schema['_first'].dataType.simpleString()}"
    sides = [(r["_part"], found[i - 1]["_last"] if i else None, found[i + 1]["_first"] if i + 1 < len(found) else None) for i, r in enumerate(found)]
    edges = F.broadcast(df.sparkSession.createDataFrame(sides, schema))
    window = Window.partitionBy("_part").orderBy("_order")
    rows_ = dealt.withColumn("_p", F.lag("_entry").over(window)).withColumn("_n", F.lead("_entry").over(window))
    joined = rows_.join(edges, "_part", "left")
    return joined.withColumn("_previous", F.coalesce("_p", "_before")).withColumn("_next", F.coalesce("_n", "_after")).drop("_part", "_entry", "_order", "_p", "_n", "_before", "_after")
