"""The value at a rank, exactly, without sorting the rows of a key: narrowing histograms.

Rows are counted by bucket of their value, first by sign and power of two, then by 4,096 parts of what is left; each round keeps the
bucket that holds the wanted rank, until its values are equal.  A double has 52 bits within a power of two, so there are six
rounds at most.  Counts combine before the shuffle; a key of all rows is a few thousand rows after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.keyed import looked_up
from skarn.session import written

PARTS = 4096
_LOW, _HIGH = -(1 << 20), 1 << 20


def _power(v: Column) -> Column:
    """A whole number that orders values as they are ordered: null first, NaN last."""
    size = F.floor(F.log2(F.abs(v))) + 2000
    infinite = F.abs(v) == F.lit(float("inf"))
    return F.when(v.isNull(), 2 * _LOW).when(F.isnan(v), 2 * _HIGH).when(infinite, F.when(v > 0, _HIGH).otherwise(_LOW)).when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("bigint")


def selected(rows: DataFrame, key: list[str], value: str, wanted: dict[str, Column]) -> DataFrame:
    """Key, ``n`` (its rows) and for each name of ``wanted`` the value at that place, from 0, of the key's rows in order; the place
    is a column of ``n``.  Nulls come first and count; keys may be null."""
    c = F.col
    slim = rows.select(*key, c(value).cast("double").alias("_v"))
    names = F.array(*(F.struct(F.lit(name).alias("_name"), place.cast("bigint").alias("_rank")) for name, place in wanted.items()))
    here = ["_key", "_name"]
    keyed = slim.select(F.xxhash64(*(F.coalesce(c(k).cast("string"), F.lit("\x00")) for k in key)).alias("_key"), *key, "_v")
    cells = written(keyed.groupBy("_key", *key, _power(c("_v")).alias("_b")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    sizes = cells.groupBy("_key", *key).agg(F.sum("_n").alias("n"))
    ranks = written(sizes.withColumn("_w", F.explode(names)).select("_key", *key, "n", "_w.*"))

    def narrowed(cells: DataFrame, ranks: DataFrame, on: list[str]) -> DataFrame:
        """For each rank the bucket that holds it, and the rank within it."""
        earlier = Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        placed = cells.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        met = placed.select(*on, "_n", "_lo", "_hi", "_before").join(ranks.select("_key", "_name", "_rank"), on)
        return met.where("_rank >= _before AND _rank < _before + _n").select("_key", "_name", (c("_rank") - c("_before")).alias("_rank"), "_n", "_lo", "_hi")

    state = written(narrowed(cells, ranks, ["_key"]))
    done = []
    while True:
        settled = c("_lo").eqNullSafe(c("_hi"))
        done.append(state.where(settled).select(*here, c("_lo").alias("_value")))
        left = state.where(~settled)
        if left.isEmpty():
            break
        asked = left.groupBy("_key").agg(F.collect_list(F.struct("_name", "_lo", "_hi")).alias("_asked")).join(sizes.select("_key", c("n").alias("_all")), "_key")
        inside = looked_up(keyed.select("_key", "_v"), written(asked), ["_key"], "_all").select("_key", "_v", F.explode("_asked").alias("_a")).where("_v BETWEEN _a._lo AND _a._hi")
        part = F.least(F.floor((c("_v") / 2 - c("_a._lo") / 2) / (c("_a._hi") / 2 - c("_a._lo") / 2) * PARTS), F.lit(PARTS - 1)).alias("_b")
        cells = inside.select("_key", c("_a._name").alias("_name"), "_v", part).groupBy(*here, "_b").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        state = written(narrowed(cells, left, here))
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    values = found.groupBy("_key").agg(*(F.max(F.when(c("_name") == name, c("_value"))).alias(name) for name in wanted))
    return sizes.join(values, "_key", "left").drop("_key")
