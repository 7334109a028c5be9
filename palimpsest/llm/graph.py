"""Connected components of a link table, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import stage, unstage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (least node reachable) for every node of ``links``.

    Each round takes the least label among the neighbours (added up before the shuffle, so a
    node with many links is no hot key) and then jumps to the label's label. Rounds grow with
    the logarithm of the longest chain of labels; every round is a table in the shared folder.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    edges = stage(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = stage(edges.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        hooked = stage(labels.join(near.withColumnRenamed("x", "node"), "node").select("node", "label", F.least("label", "near").alias("new")), "hooked")
        # the label of the label: one row for each distinct label on the right side
        upper = hooked.select(F.col("node").alias("new"), F.col("new").alias("top"))
        jumped = stage(hooked.join(upper, "new").select("node", F.least("new", "top").alias("next"), "label"), "labels")
        changed = jumped.filter("next < label").limit(1).count()
        for old in (labels, hooked):
            unstage(old)
        labels = jumped.select("node", F.col("next").alias("label"))
        labels._staged_path = jumped._staged_path
        if not changed:
            unstage(edges)
            return labels.select("node", F.col("label").alias("component"))


def extend(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """``node, component`` once ``links`` (``a, b``) join what ``found`` (the same columns) holds already.

    The links are lifted to the components of their ends, so only what is new is walked again:
    a component that has grown large is one node here.
    """
    if found is None:
        return components(links)
    side = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    lifted = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    lifted = stage(lifted.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "lifted")
    upper = components(lifted.select("ca", "cb").filter("ca <> cb").distinct(), "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("top"))
    ends = lifted.select(F.col("a").alias("node"), F.col("ca").alias("component")).unionAll(lifted.select("b", "cb"))
    every = found.unionByName(ends).distinct()
    return every.join(upper, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
