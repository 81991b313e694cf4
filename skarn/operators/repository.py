"""Checks of a repository's own files and runs: markers, sizes, test times, coverage, medians, expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.selection import selected

MARKERS = ("TODO", "FIXME", "HACK", "XXX")


def repository_identity(label: Column, root: Column) -> Column:
    return F.concat(label, F.lit("#"), F.substring(F.sha2(root, 256), 1, 12))


def scrubbed(text: Column, values: list[str]) -> Column:
    """The text without sensitive values, the longest first."""
    for v in sorted({v for v in values if v}, key=lambda v: (-len(v), v)):
        text = F.replace(text, F.lit(v), F.lit("[redacted]"))
    return text


def file_lines(files: DataFrame) -> DataFrame:
    """path, line, text: every line of the files (path, text)."""
    return files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def debt_markers(files: DataFrame, tracker: str, allowed: DataFrame, markers: tuple[str, ...] = MARKERS) -> tuple[DataFrame, DataFrame]:
    """(path, line, marker) of the lines with a marker but no reference to a tracker that aren't allowed
    (path, line); and the allowed places that hold none."""
    pattern = f"(?:^|[^A-Za-z0-9_])({'|'.join(markers)})(?:[^A-Za-z0-9_]|$)"
    found = file_lines(files).where(F.col("text").rlike(pattern) & ~F.col("text").rlike(tracker))
    found = found.select("path", "line", F.regexp_extract("text", pattern, 1).alias("marker"))
    places = allowed.select("path", "line").distinct()
    return found.join(places, ["path", "line"], "left_anti"), places.join(found, ["path", "line"], "left_anti")


def size_breaches(files: DataFrame, budgets: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(path, lines, budget) of the files over their own budget (path, budget) or else the limit; and the budgets
    without a file.  A last line end begins no line."""
    text = F.coalesce("text", F.lit(""))
    n = F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")))
    sized = files.select("path", n.cast("bigint").alias("lines"))
    over = sized.join(budgets.select("path", F.col("budget").alias("_own")), "path", "left").withColumn("budget", F.coalesce("_own", F.lit(limit).cast("bigint"))).where("lines > budget").select("path", "lines", "budget")
    return over, budgets.join(sized, "path", "left_anti").select("path", "budget")


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf'\b{name}="([^"]*)"', 1)


def test_cases(reports: DataFrame) -> DataFrame:
    """file, name, seconds of every test case of JUnit reports (text)."""
    cases = reports.select(F.explode(F.regexp_extract_all("text", F.lit(r"<testcase\b[^>]*>"), F.lit(0))).alias("tag"))
    return cases.select(_attribute(F.col("tag"), "file").alias("file"), _attribute(F.col("tag"), "name").alias("name"), _attribute(F.col("tag"), "time").cast("double").alias("seconds"))


def slowest(cases: DataFrame, n: int) -> DataFrame:
    """The ``n`` files with the longest tests, then by name: file, cases, seconds."""
    return cases.groupBy("file").agg(F.count("*").alias("cases"), F.sum(F.col("seconds").cast("decimal(18,6)")).cast("double").alias("seconds")).orderBy(F.desc("seconds"), "file").limit(n)


def line_coverage(reports: DataFrame) -> DataFrame:
    """One row of sums over LCOV reports (text): functions, functions_hit, lines, lines_hit."""
    counts = reports.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^(?:FNF|FNH|LF|LH):[0-9]+"), F.lit(0))).alias("x"))
    kind, n = F.substring_index("x", ":", 1), F.substring_index("x", ":", -1).cast("bigint")
    names = {"FNF": "functions", "FNH": "functions_hit", "LF": "lines", "LH": "lines_hit"}
    return counts.agg(*(F.coalesce(F.sum(F.when(kind == k, n)), F.lit(0)).alias(v) for k, v in names.items()))


def medians(runs: DataFrame, key: list[str], value: str) -> DataFrame:
    """Per key the value at place floor(n / 2) of all in order, and the number of runs; no task sorts a key's runs."""
    found = selected(runs, key, value, {"median": F.floor(F.col("n") / 2)})
    return found.select(*key, F.col("median").cast(runs.schema[value].dataType).alias("median"), F.col("n").alias("runs"))


def checked_expectations(checks: DataFrame, values: DataFrame) -> DataFrame:
    """Adds ``passes`` to ``checks`` (id, op, expected) by the values (id, value); false without a value."""
    v, e = F.col("value"), F.col("expected")
    ops = {"eq": v == e, "gt": v > e, "ge": v >= e, "lt": v < e, "le": v <= e}
    out = F.lit(False)
    for name, holds in ops.items():
        out = F.when(F.col("op") == name, holds).otherwise(out)
    return checks.join(values, "id", "left").withColumn("passes", F.coalesce(out, F.lit(False)))


def paired_change(before: Column, after: Column) -> Column:
    return F.when(before.isNull() | after.isNull(), "unknown").when(after < before, "decrease").when(after > before, "increase").otherwise("unchanged")
