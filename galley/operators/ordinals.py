"""Places in an order over a whole table, without sending the table through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.session import settled


def numbered(df: DataFrame, name: str = "n") -> DataFrame:
    """The rows of a sorted table (one that ends in ``orderBy``) with their places from 1, as a long.

    Sorting deals the rows to ranges, one a task. The rows are written once with their place in their range; then the
    ranges are counted, and the rows before a range, of which there are as few as tasks, are added to its places.
    Rows that the order doesn't tell apart are numbered as they lie. An empty table gives an empty result.
    """
    held = settled(df.withColumn("_at", F.monotonically_increasing_id()))
    # the identifier holds the number of the task above the place in it
    task = F.shiftright("_at", 33)
    counts = held.groupBy(task.alias("_task")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_task", before.alias("_before"))
    out = held.withColumn("_task", task).join(F.broadcast(starts), "_task")
    return out.withColumn(name, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_task", "_before", "_at")


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with each row's place in an order that ends in a key of its own, over the whole table."""
    return numbered(df.orderBy(*order), name)
