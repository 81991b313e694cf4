"""Complexity mass and erosion over function measures (source_set, package_path, path, cc, sloc)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions import half_up, micro, ratio

ERODED_ABOVE = 10


def with_mass(measures: DataFrame) -> DataFrame:
    return measures.withColumns({"mass": F.col("cc") * F.sqrt("sloc"), "eroded": F.col("cc") > ERODED_ABOVE})


def hotspots(measures: DataFrame) -> DataFrame:
    """Eroded functions ranked by unrounded mass within each source set, ties by path.

    Masses are dealt to sixteenths of an octave, so no task sorts a whole source set; a function's rank is its
    place in its bucket after all functions of higher ones.  A source set has under 34,000 buckets, whatever its
    size: their counts are broadcast."""
    bucket = F.coalesce(F.floor(F.log2("mass") * 16), F.lit(-(2**20)))
    eroded = with_mass(measures).where("eroded").withColumn("_b", bucket)
    higher = Window.partitionBy("_s").orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)
    before = eroded.groupBy(F.col("source_set").alias("_s"), F.col("_b").alias("_k")).agg(F.count("*").alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(higher), F.lit(0)))
    placed = eroded.join(F.broadcast(before), F.col("source_set").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_k")))
    place = F.row_number().over(Window.partitionBy("source_set", "_b").orderBy(F.desc("mass"), "path"))
    return placed.withColumn("rank", F.col("_above") + place).withColumn("mass", half_up(F.col("mass"), 3)).drop("eroded", "_b", "_s", "_k", "_n", "_above")


def _totals() -> list[Column]:
    m = micro(F.col("mass"))
    return [
        F.count("*").alias("functions"),
        F.sum("sloc").alias("sloc"),
        F.count_if("eroded").alias("eroded_count"),
        F.sum(m).alias("_mass"),
        F.sum(F.when(F.col("eroded"), m).otherwise(0)).alias("_eroded"),
    ]


def _finish(df: DataFrame) -> DataFrame:
    """Shares are of sums, never averages of shares; 0/0 is null."""
    return df.withColumns({
        "mass": half_up(F.col("_mass") / 1e6, 3),
        "eroded_mass": half_up(F.col("_eroded") / 1e6, 3),
        "eroded_share": half_up(ratio(F.col("_eroded"), F.col("_mass")), 6),
    }).drop("_mass", "_eroded")


def by_package(measures: DataFrame, packages: DataFrame) -> DataFrame:
    """Aggregates for every (source_set, package_path) of ``packages``, also those without functions."""
    sums = with_mass(measures).groupBy("source_set", "package_path").agg(*_totals())
    full = packages.join(sums, ["source_set", "package_path"], "left").fillna(0, ["functions", "sloc", "eroded_count", "_mass", "_eroded"])
    return _finish(full)


def rolled_up(measures: DataFrame) -> DataFrame:
    """Package, source-set and overall levels in one pass."""
    sums = with_mass(measures).rollup("source_set", "package_path").agg(*_totals(), F.grouping_id().cast("bigint").alias("level"))
    return _finish(sums)


def distribution(measures: DataFrame, value: str = "cc") -> DataFrame:
    """Nearest-rank p50 and p90, and the maximum."""
    v = F.col(value).cast("double")
    return measures.groupBy("source_set").agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").cast("bigint").alias("p50"), F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY {value})").cast("bigint").alias("p90"), F.max(v).cast("bigint").alias("max"))


def histogram(measures: DataFrame) -> DataFrame:
    return measures.groupBy("cc").agg(F.count("*").alias("functions"))
