"""Joins and numberings that survive keys of very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.session import written

HEAVY_PARTS, HEAVY_ROWS = 1000, 10_000  # a key of more than this part and number of the rows is heavy


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row for each key and the number of rows that have it.

    Keys of over a thousandth of the rows that ``table`` counts, fewer than a thousand, meet their row by broadcast
    where they are, so no task gets all of them; the others by a shuffle."""
    total = table.agg(F.sum(count)).first()[0] or 0
    heavy = [r[0] for r in table.where(F.col(count) > max(HEAVY_ROWS, total / HEAVY_PARTS)).select(F.xxhash64(*keys)).collect()]
    if not heavy:
        return rows.join(table, keys)
    these = F.xxhash64(*keys).isin(heavy)
    return rows.where(~these).join(table.where(~these), keys).unionByName(rows.where(these).join(F.broadcast(table.where(these)), keys))


def numbered(rows: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the number of each row within its group, from 0, by ``order``.

    One range partitioning of all rows by group and order splits a group of any size over many tasks; rows count
    from their range's first row of the group, whose number is the size of the group's part in earlier ranges."""
    keys = [*groups, *order]
    ordered = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).alias("_part")
    runs = ordered.groupBy(*groups, part).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(*groups, "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups] + [F.col("a._part") == F.col("b._part")]
    met = ordered.withColumn("_part", F.shiftright("_place", 33)).alias("a").join(shifts.alias("b"), on)
    return met.select(*(F.col(f"a.{c}") for c in rows.columns), (F.col("a._place") + F.col("b._shift")).alias(name))
