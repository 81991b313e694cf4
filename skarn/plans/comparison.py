"""Comparison of runs with their baselines, and the policies over it; both sides are rows of ``history.RUN``,
at most one per workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators import compare
from skarn.plans import history


def _metrics(rows: DataFrame) -> DataFrame:
    return rows.select("repo", F.explode("metrics").alias("m")).select("repo", "m.*")


def _findings(rows: DataFrame) -> DataFrame:
    """Findings with the key that they are matched by: the identity of a hotspot, else the path."""
    f = rows.select("repo", F.explode("findings").alias("f")).select("repo", "f.*")
    key = F.when(F.col("kind") == "complexity.hotspot", F.col("identity")).otherwise(F.col("path"))
    return f.select("repo", "kind", "path", key.alias("key"), F.col("start_line").cast("bigint").alias("line"))


def compatibility(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """repo, compatible, issues: what keeps a score from being compared with its baseline's."""
    columns = ("schema_version", "analyzer_version", "scoring_version")
    side = lambda rows, n: history.basis(rows).select("repo", *[F.col(c).alias(f"{c}_{n}") for c in columns], F.element_at(F.split("basis", r"\|"), -1).alias(f"catalogue_{n}"))
    both = side(baseline, "a").join(side(current, "b"), "repo")
    issues = F.array_compact(F.array(*[F.when(~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")), F.lit(c.replace("_", "-"))) for c in (*columns, "catalogue")]))
    return both.select("repo", (F.size(issues) == 0).alias("compatible"), issues.alias("issues"))


def metric_deltas(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """repo, id, baseline, current, delta, changed for the workspaces on both sides."""
    shared = baseline.select("repo").join(current.select("repo"), "repo")
    keyed = lambda rows: _metrics(rows.join(shared, "repo", "left_semi")).select(F.struct("repo", "id").alias("id"), "value")
    out = compare.metric_deltas(keyed(baseline), keyed(current))
    return out.select("id.repo", F.col("id.id").alias("id"), "baseline", "current", "delta", "changed")


def finding_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """repo, kind, path, line, status, line_shift.  A key found once on either side persists; any other finding
    is resolved or new, as is one without a key."""
    keys = ["repo", "kind", "key"]

    def counted(rows):
        found = _findings(rows)
        once = found.where("key IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.min("line").alias("at")).where("n = 1").select(*keys, "at")
        return found, once

    a, once_a = counted(baseline)
    b, once_b = counted(current)
    kept = once_a.join(once_b.withColumnRenamed("at", "at_b"), keys).select(*keys, (F.col("at_b") - F.col("at")).alias("line_shift"))
    none = F.lit(None).cast("bigint").alias("line_shift")
    out = b.join(kept, keys).select("repo", "kind", "path", "line", F.lit("persistent").alias("status"), "line_shift")
    for side, status in ((a, "resolved"), (b, "new")):
        out = out.unionByName(side.join(kept, keys, "left_anti").select("repo", "kind", "path", "line", F.lit(status).alias("status"), none))
    return out


def assess(current: DataFrame, baseline: DataFrame | None = None, max_index: int | None = None, budgets: dict[str, float] | None = None, regression: dict | None = None, fail_on_new: list[str] | None = None) -> DataFrame:
    """repo, policy, subject, status (pass, fail, skipped), code of every policy configured, each judged alone.

    Without a baseline the policies that need one are skipped; with one of another basis they fail."""
    spark = current.sparkSession
    out = spark.createDataFrame([], "repo string, policy string, subject string, status string, code string")
    none = F.lit(None).cast("string")

    def add(rows, policy, subject, code):
        nonlocal out
        status = F.when(code.isNull(), "pass").when(code == "baseline-absent", "skipped").when(code == "budget-metric-unevaluable", "skipped").otherwise("fail")
        out = out.unionByName(rows.select("repo", F.lit(policy).alias("policy"), subject.alias("subject"), status.alias("status"), code.alias("code")))

    if max_index is not None:
        add(current, "max-index", none, F.when(F.col("index") > max_index, "index-exceeds-max"))
    if budgets:
        limits = F.explode(F.array(*[F.struct(F.lit(k).alias("id"), F.lit(float(v)).alias("maximum")) for k, v in sorted(budgets.items())]))
        wanted = current.select("repo", limits.alias("b")).select("repo", "b.*").join(_metrics(current), ["repo", "id"], "left")
        add(wanted, "metric-budget", F.col("id"), F.when(F.col("state").isNull(), "budget-metric-unknown").when(F.col("value").isNull(), "budget-metric-unevaluable").when(F.col("value") > F.col("maximum"), "budget-exceeded"))
    if regression is None and not fail_on_new:
        return out
    if baseline is None:
        judged = current.select("repo", "index", F.lit(None).cast("bigint").alias("before"), F.lit(None).cast("boolean").alias("compatible"))
    else:
        judged = current.select("repo", "index").join(baseline.select("repo", F.col("index").alias("before")), "repo", "left").join(compatibility(baseline, current).drop("issues"), "repo", "left")
    unusable = F.when(F.col("compatible").isNull(), "baseline-absent").when(~F.col("compatible"), "baseline-incompatible")
    if regression is not None:
        absolute, percent = regression.get("max_increase"), regression.get("max_increase_percent")
        rise = F.col("index") - F.col("before")
        over = F.when(rise > (0 if absolute is None and percent is None else float("inf") if absolute is None else absolute), "regression-exceeds-absolute")
        if percent is not None:
            over = F.coalesce(over, F.when(rise > F.col("before") * percent / 100, "regression-exceeds-relative"))
        add(judged, "score-regression", none, F.coalesce(unusable, over))
    if fail_on_new:
        kinds = judged.withColumn("kind", F.explode(F.array(*map(F.lit, fail_on_new))))
        empty = spark.createDataFrame([], "repo string, kind string, n bigint")
        fresh = empty if baseline is None else finding_changes(baseline, current).where("status = 'new'").groupBy("repo", "kind").agg(F.count("*").alias("n"))
        add(kinds.join(fresh, ["repo", "kind"], "left"), "new-findings", F.col("kind"), F.coalesce(unusable, F.when(F.col("n") > 0, "new-finding")))
    return out
