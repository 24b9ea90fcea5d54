"""Connected components of an edge table by hooking and pointer jumping, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label for each end of ``edges`` (u, v of one type): label is the smallest node reachable.

    A round hooks every node to its smallest neighbour, jumps pointers until the trees are flat, and
    contracts the edges to the roots; the trees of a round merge in the next. Loops and repeated edges
    do no harm; no edges give an empty table. Nothing but row counts reaches the driver.
    """
    rest = scratch.write(_both_ways(edges))
    labels = None
    while True:
        parent = scratch.write(rest.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")))
        while True:
            above = parent.select(F.col("node").alias("label"), F.col("label").alias("up"))
            jumped = scratch.write(parent.join(above, "label", "left").select("node", F.coalesce("up", "label").alias("label"), (F.col("up") < F.col("label")).alias("moved")))
            moved = jumped.filter("moved").limit(1).count()
            scratch.drop(parent)
            parent = jumped.drop("moved")
            if not moved:
                break
        root = parent.select(F.col("node").alias("label"), F.col("label").alias("root"))
        old = labels
        labels = parent if old is None else scratch.write(old.join(root, "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        ends = rest.join(root.select(F.col("label").alias("u"), F.col("root").alias("ru")), "u").join(root.select(F.col("label").alias("v"), F.col("root").alias("rv")), "v")
        contracted = scratch.write(ends.filter("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
        done = contracted.limit(1).count() == 0
        scratch.drop(rest)
        if done:
            return labels
        rest = contracted


def _both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("u", "v").filter("u <> v")
    return e.union(e.select("v", "u")).distinct()
