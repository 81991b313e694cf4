"""Comparison of two reports, policy, history, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metric_deltas(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """id, baseline, current, delta and whether the metric changed; null on a side it isn't on."""
    a = baseline.select("id", F.col("value").alias("baseline"))
    b = current.select("id", F.col("value").alias("current"))
    return a.join(b, "id", "full_outer").withColumn("delta", F.col("current") - F.col("baseline")).withColumn("changed", ~F.col("baseline").eqNullSafe(F.col("current")))


def match_findings(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """kind, path, status, line_shift.  A key with exactly one finding on either side persists;
    any other is resolved and new; a null key never matches."""
    keyed = lambda df: df.withColumn("n", F.count("*").over(Window.partitionBy("kind", "path")))
    a, b = keyed(baseline), keyed(current)
    usable = lambda df: df.where("n = 1 AND kind IS NOT NULL AND path IS NOT NULL")
    both = usable(a).select("kind", "path", F.col("line").alias("line_a")).join(usable(b).select("kind", "path", F.col("line").alias("line_b")), ["kind", "path"])
    out = both.select("kind", "path", F.lit("persistent").alias("status"), (F.col("line_b") - F.col("line_a")).alias("line_shift"))
    for side, status in ((a, "resolved"), (b, "new")):
        rest = side.join(both.select("kind", "path"), ["kind", "path"], "left_anti")
        out = out.unionByName(rest.select("kind", "path", F.lit(status).alias("status"), F.lit(None).cast("bigint").alias("line_shift")))
    return out


def assess_budgets(budgets: DataFrame, metrics: DataFrame) -> DataFrame:
    """policy, subject, status: a missing metric fails, one without a value is skipped."""
    joined = budgets.join(metrics.select("id", "state", "value"), "id", "left")
    status = F.when(F.col("state").isNull(), "fail").when(F.col("value").isNull(), "skipped").when(F.col("value") > F.col("maximum"), "fail").otherwise("pass")
    return joined.select(F.lit("metric-budget").alias("policy"), F.col("id").alias("subject"), status.alias("status"))


def assess_regression(scores: DataFrame, absolute: float | None, relative: float | None) -> DataFrame:
    """Adds ``status``: fails where the index rises by more than every stated tolerance allows; with
    none stated there is no tolerance; without a baseline it is skipped."""
    rise = F.col("current") - F.col("baseline")
    bad = F.lit(False)
    if absolute is None and relative is None:
        bad = rise > 0
    if absolute is not None:
        bad = bad | (rise > absolute)
    if relative is not None:
        bad = bad | (rise > F.col("baseline") * relative)
    return scores.withColumn("status", F.when(F.col("baseline").isNull(), "skipped").when(bad, "fail").otherwise("pass"))


def latest_runs(runs: DataFrame) -> DataFrame:
    w = Window.partitionBy("repo").orderBy(F.desc("audited_at"), F.desc("id"))
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def index_deltas(runs: DataFrame) -> DataFrame:
    """Adds previous and delta: of the run before among the compatible ones of the repository."""
    w = Window.partitionBy("repo", "basis").orderBy("audited_at", "id")
    return runs.withColumn("previous", F.lag("index").over(w)).withColumn("delta", F.col("index") - F.col("previous"))


def trend_path(runs: DataFrame, label: str) -> DataFrame:
    """repo, trend: the labels in order of time, runs of equal ones once."""
    w = Window.partitionBy("repo").orderBy("audited_at", "id")
    turns = runs.withColumn("_before", F.lag(label).over(w)).where(~F.col(label).eqNullSafe(F.col("_before")))
    ordered = turns.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("audited_at", "id", F.col(label).alias("label")))).alias("path"))
    return ordered.select("repo", F.array_join(F.transform("path", lambda p: p["label"]), " → ").alias("trend"))


DRIFT_STATES = ["missing", "drift", "allowed-delta", "extra", "match"]


def drift_states(expected: DataFrame, actual: DataFrame, allowed: list[str]) -> DataFrame:
    """Attribute by attribute (target, path, value): missing, drift, allowed-delta (under an allowed
    prefix), extra or match."""
    joined = expected.select("target", "path", F.col("value").alias("e"), F.lit(True).alias("in_e")).join(actual.select("target", "path", F.col("value").alias("a"), F.lit(True).alias("in_a")), ["target", "path"], "full_outer")
    excused = F.lit(False)
    for prefix in allowed:
        excused = excused | F.col("path").startswith(prefix)
    state = F.when(F.col("in_a").isNull(), "missing").when(F.col("in_e").isNull(), "extra").when(F.col("e").eqNullSafe(F.col("a")), "match").when(excused, "allowed-delta").otherwise("drift")
    return joined.select("target", "path", state.alias("state"))
