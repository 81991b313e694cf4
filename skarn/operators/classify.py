"""Path classification, glob overrides, prefix owners, and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import glob_regex

# Fixed values, in order of precedence: rule, source set, path pattern.
RULES = [
    ("default:vendored-dir", "vendored", r"(^|/)(vendor|third_party)/"),
    ("default:generated", "generated", r"(^|/)(__generated__|generated)/|\.(gen|generated)\.[^./]+$"),
    ("default:declaration", "declaration-only", r"\.d\.[cm]?ts$"),
    ("default:test", "test", r"\.(test|spec)\.[^./]+$|(^|/)(__tests__|test|tests)/"),
]


def source_set(path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(source set, rule): the first rule that matches, else production."""
    kind = rule = None
    for name, group, pattern in rules:
        hit = path.rlike(pattern)
        kind = (F if kind is None else kind).when(hit, group)
        rule = (F if rule is None else rule).when(hit, name)
    return kind.otherwise("production"), rule.otherwise("default:production")


def with_overrides(files: DataFrame, overrides: list[tuple[str, str]]) -> DataFrame:
    """Config globs win over the rules; of several, the first pattern in order.  The globs are a
    configuration: a condition each, no join."""
    kind, rule = source_set(F.col("path"))
    for pattern, group in sorted(overrides, reverse=True):
        hit = F.col("path").rlike(glob_regex(pattern))
        kind, rule = F.when(hit, group).otherwise(kind), F.when(hit, F.lit(f"config:classify:{pattern}")).otherwise(rule)
    return files.withColumns({"source_set": kind, "rule": rule})


def nearest_owner(paths: DataFrame, owners: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The deepest directory of ``owners`` that holds each path, within the same ``by``; "." if none.

    A path is exploded into its ancestors and joined by equality, not by prefix."""
    keys = by or []
    parts = F.split("path", "/")
    ancestors = paths.withColumn("directory", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    held = ancestors.join(owners.select(*keys, "directory").distinct(), [*keys, "directory"], "left_semi")
    best = held.groupBy(*keys, "path").agg(F.max_by("directory", F.length("directory")).alias("owner"))
    return paths.join(best, [*keys, "path"], "left").withColumn("owner", F.coalesce("owner", F.lit(".")))


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1) and line text."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "line_text")).withColumn("line", F.col("line") + 1)


def line_kind(text: Column, comment: str = r"^\s*(//|#|\*|/\*)") -> Column:
    return F.when(F.trim(text) == "", "blank").when(text.rlike(comment), "commentOnly").otherwise("code")


def normalised_tokens(text: Column) -> Column:
    """Words in lower case with every run of digits as one placeholder."""
    words = F.filter(F.split(F.lower(text), r"[ \t\n\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.regexp_replace(w, r"[0-9]+", "0"))
