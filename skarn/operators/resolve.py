"""Module resolution as joins: every import gets ordered candidate paths, and the first that exists wins.

Bare names are tried as ``node:`` modules, path mappings, assets and workspace packages, in this order; what
remains is external."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import package_name
from skarn.operators import classify
from skarn.sources.workspace import loose_json

# The conditions of an exports entry, in order.
CONDITIONS = ("import", "require", "default", "types")
EDGE = ["repo", "path", "seq", "kind", "type_only", "specifier", "line"]


def joined_path(directory: Column, specifier: Column) -> Column:
    """The normalised path of a relative specifier; null where it leaves the workspace."""
    parts = F.split(F.concat_ws("/", F.when(directory != ".", directory), specifier), "/")
    empty = F.array().cast("array<string>")
    step = lambda acc, s: F.when(acc.isNull() | (s == ".") | (s == ""), acc).when(s != "..", F.concat(acc, F.array(s))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
    folded = F.aggregate(parts, empty, step)
    return F.when(folded.isNotNull(), F.array_join(folded, "/"))


def file_candidates(base: Column) -> Column:
    """The files that a path may stand for, in the compiler's order."""
    with_ext = lambda b, *exts: [F.concat(b, F.lit(e)) for e in exts]
    swapped = lambda ending, *exts: [F.when(base.endswith(ending), F.concat(F.substring(base, F.lit(1), F.length(base) - len(ending)), F.lit(e))) for e in exts]
    directory = F.when(base == "", F.lit("")).otherwise(F.concat(base, F.lit("/")))
    return F.array_compact(F.array(
        F.when(base.rlike(r"\.[cm]?tsx?$"), base),
        *swapped(".js", ".ts", ".tsx", ".d.ts"), *swapped(".jsx", ".tsx", ".ts", ".d.ts"), *swapped(".mjs", ".mts", ".d.mts"), *swapped(".cjs", ".cts", ".d.cts"),
        *with_ext(base, ".ts", ".tsx", ".d.ts"), F.when(base.rlike(r"\.([cm]?jsx?|json)$"), base), *with_ext(base, ".js", ".jsx"),
        *with_ext(directory, "index.ts", "index.tsx", "index.d.ts", "index.js", "index.jsx"), base,
    ))


def package_entries(manifest: str | None, subpath: str) -> tuple[list[str], str | None]:
    """Candidate files of a workspace package's subpath, or why there are none."""
    fields = loose_json(manifest or "")
    exports = fields.get("exports")
    if exports is None:
        stated = [fields[k] for k in ("main", "types") if isinstance(fields.get(k), str)]
        return ([subpath] if subpath else stated or ["index"]), None
    wanted = f"./{subpath}" if subpath else "."
    if isinstance(exports, str):
        exports = {".": exports}
    if not isinstance(exports, dict):
        return [], "unsupported-exports"

    def chosen(value) -> str | None:
        if isinstance(value, dict):
            value = next((value[c] for c in CONDITIONS if value.get(c) is not None), None)
        return value if isinstance(value, str) else None

    if wanted in exports:
        target = chosen(exports[wanted])
        return ([target], None) if target else ([], "unsupported-exports")
    fits = []
    for pattern, value in exports.items():
        before, star, after = pattern.partition("*")
        target = chosen(value)
        if star and "*" not in after and target and wanted.startswith(before) and wanted.endswith(after) and len(wanted) >= len(before) + len(after):
            fits.append((-len(before), target.replace("*", wanted[len(before) : len(wanted) - len(after)], 1)))
    return ([min(fits, key=lambda f: f[0])[1]], None) if fits else ([], "exports-encapsulation")


def _package_bases(sites: DataFrame) -> DataFrame:
    """Adds bases and failure for sites with a manifest."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sites.drop("manifest").schema) + ", bases array<string>, failure string"

    def look_up(batches):
        for batch in batches:
            found = [package_entries(m, s[len(n) + 1 :]) for m, s, n in zip(batch["manifest"], batch["specifier"], batch["package_name"], strict=True)]
            bases = [[os.path.normpath(os.path.join(d, re.sub(r"^\./", "", c))) for c in cs] for d, (cs, _) in zip(batch["package_directory"], found, strict=True)]
            yield batch.drop(columns="manifest").assign(bases=bases, failure=[f for _, f in found])

    return sites.mapInPandas(look_up, schema)


def resolve(sites: DataFrame, entries: DataFrame, packages: DataFrame, mappings: DataFrame) -> DataFrame:
    """The import sites (repo, path, seq, kind, type_only, specifier, line) with status (local, out-of-scope,
    external, unresolved), target, package_name and reason."""
    directory = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(".")
    spec = F.col("specifier")
    relative = spec.startswith("./") | spec.startswith("../")
    sites = sites.select(*EDGE).withColumn("route", F.when(spec.isNull(), "non-literal").when(relative, "relative").when(spec.startswith("node:"), "node").otherwise("bare"))
    near = sites.where("route = 'relative'").withColumn("_p", joined_path(directory, spec))
    near = near.select(*EDGE, "route", F.when(F.col("_p").isNotNull(), F.array("_p")).alias("bases"), F.when(F.col("_p").isNull(), "outside-root").alias("failure"), F.lit(None).cast("string").alias("package_name"))

    # path mappings of the governing configuration: exact pattern, else the longest prefix
    bare = sites.where("route = 'bare'")
    importers = bare.select("repo", "path").distinct()
    governing = classify.nearest_owner(importers, mappings.select("repo", "directory"), by=["repo"]).withColumnRenamed("owner", "directory")
    rules = governing.join(mappings.where("pattern IS NOT NULL"), ["repo", "directory"]).select("repo", "path", "pattern", "targets", "stated")
    star = F.instr("pattern", "*")
    prefix, suffix = F.expr("substring(pattern, 1, instr(pattern, '*') - 1)"), F.expr("substring(pattern, instr(pattern, '*') + 1)")
    fits = F.when(star > 0, spec.startswith(prefix) & spec.endswith(suffix) & (F.length(spec) >= F.length(prefix) + F.length(suffix))).otherwise(F.col("pattern") == spec)
    middle = F.when(star > 0, F.expr("substring(specifier, length(substring(pattern, 1, instr(pattern, '*') - 1)) + 1, length(specifier) - length(pattern) + 1)")).otherwise("")
    mapped = bare.join(rules, ["repo", "path"]).where(fits).withColumn("bases", F.transform("targets", lambda t: F.replace(t, F.lit("*"), middle)))
    rank = F.struct(F.when(star > 0, 0).otherwise(1).alias("exact"), star.alias("length"), F.col("pattern"))
    mapped = mapped.groupBy(*EDGE).agg(F.max_by("bases", rank).alias("bases"), F.bool_or("stated").alias("stated"))
    mapped = _first_existing(mapped, entries)

    # workspace packages
    same_site = ["repo", "path", "seq"]
    done = mapped.where("target IS NOT NULL OR stated").select(*same_site)
    rest = bare.join(done, same_site, "left_anti").withColumn("package_name", package_name(spec))
    named = packages.where("name IS NOT NULL").groupBy("repo", F.col("name").alias("package_name")).agg(F.max_by("manifest", "directory").alias("manifest"), F.max("directory").alias("package_directory"))
    inner = _package_bases(rest.join(named, ["repo", "package_name"]).select(*EDGE, "package_name", "package_directory", "manifest"))
    inner = inner.select(*EDGE, F.lit("package").alias("route"), "bases", "failure", "package_name")
    outer = rest.join(named, ["repo", "package_name"], "left_anti")

    tried = _first_existing(near.unionByName(inner), entries)
    nothing = F.lit(None).cast("string")
    out = tried.select(*EDGE, _status().alias("status"), "target", nothing.alias("package_name"), F.when(F.col("target").isNull(), F.coalesce("failure", F.lit("no-target"))).alias("reason"))
    hit = mapped.where("target IS NOT NULL OR stated")
    out = out.unionByName(hit.select(*EDGE, _status().alias("status"), "target", nothing.alias("package_name"), F.when(F.col("target").isNull(), "no-target").alias("reason")))
    plain = sites.where("route IN ('node', 'non-literal')").withColumn("package_name", spec).select(*EDGE, "route", "package_name").unionByName(outer.select(*EDGE, "route", "package_name"))
    literal = F.col("route") != "non-literal"
    return out.unionByName(plain.select(*EDGE, F.when(literal, "external").otherwise("unresolved").alias("status"), nothing.alias("target"), F.when(literal, F.col("package_name")).alias("package_name"), F.when(~literal, "non-literal-dynamic").alias("reason")))


def _status() -> Column:
    return F.when(F.col("target").isNull(), "unresolved").when(F.col("found") == "source", "local").otherwise("out-of-scope")


def _first_existing(sites: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds target and found (its status): the first candidate of the first base that is a file."""
    candidates = F.flatten(F.transform(F.coalesce("bases", F.array().cast("array<string>")), file_candidates))
    listed = entries.where("ignored IS NULL").select("repo", F.col("path").alias("candidate"), F.col("status").alias("found"))
    exploded = sites.select("repo", "path", "seq", F.posexplode(candidates).alias("n", "candidate"))
    best = exploded.join(listed, ["repo", "candidate"]).groupBy("repo", "path", "seq").agg(F.min_by(F.struct("candidate", "found"), "n").alias("b"))
    return sites.join(best, ["repo", "path", "seq"], "left").withColumns({"target": F.col("b.candidate"), "found": F.col("b.found")}).drop("b")
