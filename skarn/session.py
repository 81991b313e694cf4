"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "skarn", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; ``conf`` adds or overrides."""
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"} | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    The session's own setting is used.  Where there is none, a temporary folder serves a local master;
    on a cluster it is an error, as no folder of one machine would outlive an executor."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", "")
        if not where:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="skarn-checkpoint-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, **options: str) -> DataFrame:
    """Cuts the lineage by a table in the shared folder, for loops: a checkpoint hands the estimated size on, and joins
    multiply it, so that after some rounds the numbers alone take longer to plan than the data to join.  ``options`` are those of the writer."""
    folder = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
