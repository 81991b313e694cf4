"""Interval sweeps as windows, keyed so that no window holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contained(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Adds ``contained``: another interval of the key strictly holds this one (both ends in it, one
    of them inside)."""
    earlier = Window.partitionBy(key).orderBy(start).rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(key, start)
    wide = F.coalesce(F.max(end).over(earlier) >= F.col(end), F.lit(False)) | (F.max(end).over(same) > F.col(end))
    return intervals.withColumn("contained", wide)


def overlap_depth_spans(intervals: DataFrame, key: str, start: str, end: str, depth: int = 2) -> DataFrame:
    """Maximal spans [from, to] of whole positions that at least ``depth`` intervals cover."""
    events = intervals.select(key, F.col(start).alias("at"), F.lit(1).alias("delta")).union(intervals.select(key, (F.col(end) + 1).alias("at"), F.lit(-1).alias("delta")))
    steps = events.groupBy(key, "at").agg(F.sum("delta").alias("delta"))
    w = Window.partitionBy(key).orderBy("at")
    covered = steps.withColumn("depth", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("deep", F.col("depth") >= depth)
    edges = covered.withColumn("before", F.coalesce(F.lag("deep").over(w), F.lit(False))).where(F.col("deep") != F.col("before"))
    paired = edges.withColumn("next", F.lead("at").over(w))
    return paired.where("deep").select(key, F.col("at").alias("from_at"), (F.col("next") - 1).alias("to_at"))


def covered_positions(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Positions covered by any interval, each once: islands by running maximum, then their lengths."""
    w = Window.partitionBy(key).orderBy(start, end)
    marked = intervals.withColumn("_reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + 1), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy(key, "_island").agg((F.max(end) - F.min(start) + 1).alias("n"))
    return spans.groupBy(key).agg(F.sum("n").alias("covered"), F.count("*").alias("islands"))
