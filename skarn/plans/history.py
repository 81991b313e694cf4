"""Stored runs and their findings: two tables under a commit log, reports as JSON, and the history over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skarn.operators import compare
from skarn.sources.commit_log import CommitLog, Tables
from skarn.plans.audit import FINDING, Audit, run_rows

SCHEMA_VERSION, ANALYZER_VERSION, SCORING_VERSION = 1, "1", "0.2.0-provisional"
RUN = (
    "repo string, audited_at timestamp, schema_version int, analyzer_version string, scoring_version string, index bigint, partial boolean, completeness string, "
    "metrics array<struct<id:string,state:string,value:double,reason:string>>, contributions array<struct<dimension:string,score:double,points:bigint>>, "
    "findings array<struct<kind:string,path:string,start_line:int,end_line:int,summary:string,identity:string>>"
)


def runs(done: Audit, audited_at: str | None = None) -> DataFrame:
    """One row per workspace with everything that a later comparison needs (RUN)."""
    rows = run_rows(done, F.lit(audited_at).cast("timestamp") if audited_at else None)
    parts = done.score.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("dimension", "score", "points"))).alias("contributions"))
    found = done.findings.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct(*FINDING[1:]))).alias("findings"))
    full = rows.join(parts, "repo").join(found, "repo", "left")
    empty = F.array().cast("array<struct<kind:string,path:string,start_line:int,end_line:int,summary:string,identity:string>>")
    versions = {"schema_version": F.lit(SCHEMA_VERSION), "analyzer_version": F.lit(ANALYZER_VERSION), "scoring_version": F.lit(SCORING_VERSION), "findings": F.coalesce("findings", empty)}
    return full.withColumns(versions).select(*[c.split()[0] for c in RUN.split(", ") if " " in c])


def with_id(rows: DataFrame) -> DataFrame:
    """Adds run_id: a run is its workspace and time."""
    return rows.withColumn("run_id", F.sha2(F.concat_ws("|", "repo", F.date_format("audited_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")), 256))


def split(tables: Tables) -> Tables:
    """Runs with nested findings as runs and a table of findings."""
    rows = with_id(tables["runs"])
    found = rows.select("run_id", "repo", F.explode("findings").alias("f")).select("run_id", "repo", "f.*")
    return {"runs": rows.drop("findings"), "findings": found}


MIGRATIONS = [(2, split)]


def store_log(spark: SparkSession, store: str) -> CommitLog:
    """Format 1 was a folder of runs by workspace, without a log."""
    return CommitLog(spark, store, MIGRATIONS, plain=("runs", "repo=*", StructType.fromDDL(RUN)))


def append(rows: DataFrame, store: str) -> int | None:
    """Adds the runs that the store doesn't have; a workspace is a partition, so that reading one prunes the others."""
    return store_log(rows.sparkSession, store).append(split({"runs": rows}), "run_id", "runs", partition="repo")


def _chosen(rows: DataFrame, repo: str | None) -> DataFrame:
    return rows if repo is None else rows.where(F.col("repo") == repo)


def load_runs(spark: SparkSession, store: str, repo: str | None = None, since: str | None = None) -> DataFrame:
    """The stored runs without their findings, with run_id."""
    tables = store_log(spark, store).read()
    empty = split({"runs": spark.createDataFrame([], RUN)})
    rows = _chosen(tables.get("runs", empty["runs"]), repo)
    return rows.where(F.col("audited_at") >= F.lit(since).cast("timestamp")) if since else rows


def load_findings(spark: SparkSession, store: str, repo: str | None = None) -> DataFrame:
    """run_id, repo and the finding, a row each."""
    empty = split({"runs": spark.createDataFrame([], RUN)})
    return _chosen(store_log(spark, store).read().get("findings", empty["findings"]), repo)


def load(spark: SparkSession, store: str, repo: str | None = None, since: str | None = None) -> DataFrame:
    """Whole runs (RUN), each with its findings in its row."""
    rows = load_runs(spark, store, repo, since)
    fields = [c for c in load_findings(spark, store).columns if c not in ("run_id", "repo")]
    found = load_findings(spark, store, repo).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("findings"))
    names = [c.split()[0] for c in RUN.split(", ") if " " in c]
    return rows.join(found, "run_id", "left").withColumn("findings", F.coalesce("findings", F.array().cast(found.schema["findings"].dataType))).select(*names)


def write_reports(rows: DataFrame, folder: str) -> None:
    """One line of JSON per run."""
    rows.write.mode("overwrite").json(folder)


def load_reports(spark: SparkSession, path: str) -> DataFrame:
    """Runs read from JSON; one of another version, with a repeated metric id or an unknown state is an error."""
    rows = spark.read.schema(RUN).json(path)
    ids = F.transform("metrics", lambda m: m["id"])
    sound = F.coalesce((F.col("schema_version") == SCHEMA_VERSION) & (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall("metrics", lambda m: m["state"].isin("complete", "incomplete", "not-applicable", "unsupported")), F.lit(False))
    checked = F.when(sound, F.col("repo")).otherwise(F.raise_error(F.concat(F.lit("not a valid report: "), F.coalesce("repo", F.lit("?")))).cast("string"))
    return rows.withColumn("repo", checked)


def basis(rows: DataFrame) -> DataFrame:
    """Adds ``basis``: what two runs must share for their scores to be compared, versions and metric ids."""
    catalogue = F.sha2(F.array_join(F.array_sort(F.transform("metrics", lambda m: m["id"])), ","), 256)
    return rows.withColumn("basis", F.concat_ws("|", F.col("schema_version").cast("string"), "analyzer_version", "scoring_version", catalogue))


def same_basis(a: dict, b: dict) -> bool:
    """Whether two runs as plain objects share versions and metric ids."""
    ids = lambda r: sorted(m["id"] for m in r["metrics"])
    return all(a[k] == b[k] for k in ("schema_version", "analyzer_version", "scoring_version")) and ids(a) == ids(b)


def latest_full(rows: DataFrame) -> DataFrame:
    """The whole latest run of each workspace."""
    newest = rows.groupBy("repo").agg(F.max("audited_at").alias("audited_at"))
    return rows.join(newest, ["repo", "audited_at"]).dropDuplicates(["repo"]).select(rows.columns)


def snapshot(rows: DataFrame) -> DataFrame:
    """The latest run of each workspace with its change against the run before on the same basis."""
    keyed = basis(rows).select("repo", "audited_at", F.col("audited_at").alias("id"), "basis", "index", "partial", "completeness")
    return compare.latest_runs(compare.index_deltas(keyed)).drop("id", "basis")


def trend(rows: DataFrame) -> DataFrame:
    """repo and the indexes in order of time, runs of equal ones once."""
    return compare.trend_path(rows.select("repo", "audited_at", F.col("audited_at").alias("id"), F.col("index").cast("string").alias("index")), "index")
