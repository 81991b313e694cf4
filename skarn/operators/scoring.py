"""One 0-100 index from metrics in explicit states; lower is better."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.functions import bounded_log, half_up, saturating

# Dimension, its weight, metric, its share within the dimension, normaliser, constant.
FORMULA = [
    ("complexity-erosion", 0.5, "erosion.eroded-count.production", 0.5, "log", 20.0),
    ("complexity-erosion", 0.5, "erosion.eroded-share.production", 0.5, "linear", 0.25),
    ("duplication", 0.3, "duplication.density.production", 0.5, "linear", 0.15),
    ("duplication", 0.3, "duplication.groups.production", 0.5, "log", 15.0),
    ("import-cycle", 0.2, "import-cycle.density", 0.5, "linear", 0.10),
    ("import-cycle", 0.2, "import-cycle.groups", 0.5, "log", 5.0),
]
SCHEMA = "dimension string, weight double, id string, share double, kind string, k double"


def formula(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMULA, SCHEMA)


def dimension_scores(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """dimension, weight, score, degraded (within each ``by``).  A term that is missing or neither complete
    nor not-applicable degrades its dimension to 100; not-applicable scores 0."""
    keys = by or []
    if keys:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        terms = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in FORMULA]))
        wanted = metrics.select(*keys).distinct().withColumn("_t", terms).select(*keys, "_t.*")
    else:
        wanted = formula(metrics.sparkSession)
    terms = wanted.join(metrics.select(*keys, "id", "state", "value"), [*keys, "id"], "left")
    value = F.when(F.col("kind") == "log", bounded_log(F.col("value"), F.col("k"))).otherwise(saturating(F.col("value"), F.col("k")))
    terms = terms.withColumns({
        "bad": ~F.coalesce(F.col("state").isin("complete", "not-applicable"), F.lit(False)),
        "term": F.when(F.col("state") == "complete", value).otherwise(0.0),
    })
    scored = terms.groupBy(*keys, "dimension", "weight").agg(F.bool_or("bad").alias("degraded"), F.bool_or(F.col("state").isNull()).alias("missing"), F.sum(F.col("term") * F.col("share")).alias("raw"))
    return scored.select(*keys, "dimension", "weight", "degraded", "missing", half_up(F.when(F.col("degraded"), F.lit(100.0)).otherwise(F.col("raw")), 6).alias("score"))


def apportion(parts: DataFrame, total: str, key: str, part: str, by: list[str] | None = None) -> DataFrame:
    """Whole points that add up to ``total`` (within each ``by``): largest remainders, ties by key."""
    scope = by or [F.lit(0)]
    everything = Window.partitionBy(*scope)
    exact = F.coalesce(F.try_divide(F.col(part) * F.col(total), F.sum(part).over(everything)), F.lit(0.0))
    base = parts.withColumns({"_exact": half_up(exact, 9)}).withColumn("_floor", F.floor("_exact"))
    order = everything.orderBy(F.desc(half_up(F.col("_exact") - F.col("_floor"), 9)), key)
    extra = F.col(total) - F.sum("_floor").over(everything)
    points = F.col("_floor") + F.when((F.row_number().over(order) <= extra) & (F.col(part) > 0), 1).otherwise(0)
    return base.withColumn("points", points.cast("bigint")).drop("_exact", "_floor")


def index(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Contributions with the index they add up to, and whether any metric is partial or missing; one index,
    or one for each ``by``."""
    keys = by or []
    scope = Window.partitionBy(*(keys or [F.lit(0)]))
    scored = dimension_scores(metrics, by).withColumn("part", half_up(F.col("weight") * F.col("score"), 6))
    total = scored.withColumn("index", F.least(F.greatest(F.floor(F.sum("part").over(scope) + 0.5), F.lit(0)), F.lit(100)).cast("bigint"))
    partial = metrics.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("state") == "incomplete"), F.lit(False)).alias("any_incomplete"))
    points = apportion(total, "index", "dimension", "part", by)
    out = points.join(partial, keys) if keys else points.crossJoin(F.broadcast(partial))
    return out.select(*keys, "dimension", "score", "points", "index", "degraded", (F.col("any_incomplete") | F.bool_or("missing").over(scope)).alias("partial"))
