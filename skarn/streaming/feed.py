"""A feed of runs as a stream: new files of the run store, late rows within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.plans.history import RUN, split


def run_stream(spark: SparkSession, store: str, files_per_batch: int = 1000) -> DataFrame:
    """The runs as writers put them into the store, without their findings; those of a writer that hasn't committed too."""
    schema = split({"runs": spark.createDataFrame([], RUN)})["runs"].schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{store}/data/runs").drop("txn")


def index_by_day(runs: DataFrame, lateness: str = "1 day") -> DataFrame:
    """repo, day, runs, highest and mean index; a day is emitted once it can't change any more.  A run that
    arrives twice counts once; rows later than the watermark are dropped, as the watermark states."""
    once = runs.select("repo", "audited_at", "index").withWatermark("audited_at", lateness).dropDuplicates(["repo", "audited_at"])
    days = once.groupBy(F.window("audited_at", "1 day").alias("w"), "repo")
    return days.agg(F.count("*").alias("runs"), F.max("index").alias("highest"), F.avg("index").alias("mean")).select("repo", F.col("w.start").alias("day"), "runs", "highest", "mean")
