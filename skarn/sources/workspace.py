"""Workspaces as tables: directory listings, manifests, compiler configurations, and file texts.

``targets`` (repo, root) may name any number of workspaces; executors list and read them, so roots must lie in
a folder that all of them see.  Nothing below a workspace is gathered on the driver."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import glob_regex
from skarn.operators import classify

# Directories that aren't entered, or whose content is counted as excluded.
DEPENDENCY_DIRECTORIES = ["node_modules"]
BUILD_DIRECTORIES = ["dist", "build", "out", "coverage"]
# Extensions of source in other languages.
UNSUPPORTED_EXTENSIONS = ".js .mjs .cjs .jsx .py .swift .go .rs .java .kt .kts .rb .php .c .h .cc .cpp .hpp .cs .scala".split()
TYPESCRIPT = r"\.(ts|tsx|mts|cts)$"

LISTING = "repo string, root string, path string, ignored string"


def targets(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """repo and root of the workspaces named."""
    return spark.createDataFrame([(k, os.path.abspath(v)) for k, v in roots.items()], "repo string, root string")


def _list(repo: str, root: str) -> Iterator[tuple]:
    pending = [""]
    while pending:
        here = pending.pop()
        try:
            inside = sorted(os.scandir(os.path.join(root, here)), key=lambda e: e.name)
        except OSError:
            yield repo, root, here or ".", "unreadable"
            continue
        for entry in inside:
            rel = f"{here}/{entry.name}" if here else entry.name
            if entry.is_symlink() and entry.is_dir():
                yield repo, root, rel, "symlink"
            elif entry.is_dir():
                reason = "dependency-dir" if entry.name in DEPENDENCY_DIRECTORIES else "dot-dir" if entry.name.startswith(".") else None
                if reason:
                    yield repo, root, rel, reason
                else:
                    pending.append(rel)
            elif entry.is_file():
                yield repo, root, rel, None


def listing(targets: DataFrame) -> DataFrame:
    """Every file of the workspaces, and the directories left out with the reason (``ignored``).  A directory
    that can't be read is a row (``unreadable``; the root's path is ``.``) and stops no other."""

    def walk(batches):
        for batch in batches:
            for repo, root in zip(batch["repo"], batch["root"], strict=True):
                rows = list(_list(repo, root))
                if rows:
                    yield pd.DataFrame(rows, columns=["repo", "root", "path", "ignored"])

    return targets.select("repo", "root").mapInPandas(walk, LISTING)


def triage(entries: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Adds ``status``: ignored, manifest, config, source, excluded, unsupported or other, with ``reason`` of
    an exclusion.  Exclusions are globs of the configuration, a condition each."""
    built = F.exists(F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), lambda s: s.isin(BUILD_DIRECTORIES))
    listed = F.lit(False)
    for glob in exclude or []:
        listed = listed | F.col("path").rlike(glob_regex(glob))
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    source = F.col("path").rlike(TYPESCRIPT)
    status = (
        F.when(F.col("ignored").isNotNull(), "ignored")
        .when((name == "package.json") & ~built, "manifest")
        .when((name == "tsconfig.json") & ~built, "config")
        .when(source & (built | listed), "excluded")
        .when(source, "source")
        .when(extension.isin(UNSUPPORTED_EXTENSIONS) & ~built & ~listed, "unsupported")
        .otherwise("other")
    )
    reason = F.when(status == "excluded", F.when(built, "build-output").otherwise("config-exclude"))
    return entries.withColumns({"status": status, "reason": reason, "extension": extension})


def with_text(files: DataFrame) -> DataFrame:
    """Adds text and ``read_error``; what can't be read is empty and says why."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", text string, read_error string"

    def read(batches):
        for batch in batches:
            texts, errors = [], []
            for root, path in zip(batch["root"], batch["path"], strict=True):
                try:
                    texts.append(Path(root, path).read_text(encoding="utf-8", errors="replace"))
                    errors.append(None)
                except OSError as e:
                    texts.append("")
                    errors.append(type(e).__name__)
            yield batch.assign(text=texts, read_error=errors)

    return files.mapInPandas(read, schema)


def loose_json(text: str) -> dict:
    """An object of JSON with comments and trailing commas; anything else is an empty one."""
    keep = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m.group(1) or "", text or "")
    keep = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m.group(1) or "", keep)
    try:
        value = json.loads(keep)
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def _directory() -> F.Column:
    return F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(".")


def packages(entries: DataFrame) -> DataFrame:
    """repo, directory, name, has_manifest, manifest (text): one row per manifest; every workspace has a root
    package, with or without one.  A malformed manifest counts as an empty object."""
    manifests = with_text(entries.where("status = 'manifest'").select("repo", "root", "path"))
    name = F.get_json_object("text", "$.name")
    own = manifests.select("repo", _directory().alias("directory"), name.alias("name"), F.lit(True).alias("has_manifest"), F.col("text").alias("manifest"))
    roots = entries.select("repo").distinct().join(own.where("directory = '.'").select("repo"), "repo", "left_anti")
    return own.unionByName(roots.select("repo", F.lit(".").alias("directory"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("has_manifest"), F.lit(None).cast("string").alias("manifest")))


def workspace_globs(entries: DataFrame, owned_by: DataFrame) -> DataFrame:
    """repo, glob, regex, negative: the package globs that the root manifest (a list, or an object's ``packages``)
    and ``pnpm-workspace.yaml`` declare; what isn't a list of strings declares nothing."""
    stated = owned_by.where("directory = '.' AND has_manifest").select("repo", F.lit("json").alias("form"), F.col("manifest").alias("text"))
    pnpm = with_text(entries.where("ignored IS NULL AND path = 'pnpm-workspace.yaml'").select("repo", "root", "path")).select("repo", F.lit("yaml").alias("form"), "text")

    def read(batches):
        for batch in batches:
            rows = []
            for repo, form, text in zip(batch["repo"], batch["form"], batch["text"], strict=True):
                value = loose_json(text).get("workspaces") if form == "json" else _yaml(text)
                value = value.get("packages") if isinstance(value, dict) else value if form == "json" else None
                for glob in value if isinstance(value, list) else []:
                    if isinstance(glob, str):
                        rows.append((repo, glob, glob_regex(glob.removeprefix("!")), glob.startswith("!")))
            yield pd.DataFrame(rows, columns=["repo", "glob", "regex", "negative"])

    return stated.unionByName(pnpm).mapInPandas(read, "repo string, glob string, regex string, negative boolean")


def _yaml(text: str):
    import yaml

    try:
        return yaml.safe_load(text or "")
    except yaml.YAMLError:
        return None


def declared(owned_by: DataFrame, globs: DataFrame) -> DataFrame:
    """Adds ``declared``: the root always is, any other package if a glob matches its directory and no negative
    glob does."""
    hits = owned_by.select("repo", "directory").join(globs, "repo").where(F.rlike("directory", F.col("regex")))
    verdict = hits.groupBy("repo", "directory").agg((F.bool_or(~F.col("negative")) & ~F.bool_or("negative")).alias("_hit"))
    return owned_by.join(verdict, ["repo", "directory"], "left").withColumn("declared", (F.col("directory") == ".") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def _extended(root: str, path: str, wanted: str) -> str | None:
    """The file, relative to the root, that a configuration's ``extends`` names: a path beside it, or a package
    in the nearest ``node_modules``; null if it isn't there or lies outside the root."""
    here = os.path.dirname(path)
    if wanted.startswith((".", "/")):
        bases = [os.path.join(here, wanted)] if wanted.startswith(".") else []
    else:
        ups = [here] + [os.path.dirname(here[:i]) for i in range(len(here), 0, -1) if here[i - 1] == "/"] + [""]
        bases = [os.path.join(u, "node_modules", wanted) for u in dict.fromkeys(ups)]
    for base in map(os.path.normpath, bases):
        for name in (base, base + ".json", os.path.join(base, "tsconfig.json")):
            if not name.startswith("..") and os.path.isfile(os.path.join(root, name)):
                return name
    return None


def _effective(root: str, path: str, text: str, seen: frozenset = frozenset()) -> dict:
    """Base directory and path mappings of a configuration after those that it extends: a later one overrides an
    earlier one, its own override all, and mappings are replaced as a whole.  A cycle ends where it closes."""
    config = loose_json(text)
    out: dict = {}
    parents = config.get("extends")
    for wanted in [parents] if isinstance(parents, str) else parents if isinstance(parents, list) else []:
        file = _extended(root, path, wanted) if isinstance(wanted, str) else None
        if file and file not in seen | {path}:
            try:
                inherited = Path(root, file).read_text(encoding="utf-8", errors="replace")
            except OSError:
                continue
            out |= _effective(root, file, inherited, seen | {path})
    own = config.get("compilerOptions")
    own = own if isinstance(own, dict) else {}
    directory = os.path.dirname(path) or "."
    if own.get("baseUrl"):
        out["base"] = os.path.normpath(os.path.join(directory, str(own["baseUrl"])))
    if isinstance(own.get("paths"), dict):
        out |= {"paths": own["paths"], "stated_in": directory}
    return out


def path_mappings(entries: DataFrame) -> DataFrame:
    """repo, directory, pattern, targets: the path mappings of every compiler configuration and of those that it
    extends, targets relative to the workspace; pattern and targets are null for one without mappings."""
    configs = with_text(entries.where("status = 'config'").select("repo", "root", "path"))

    def read(batches):
        for batch in batches:
            rows = []
            for repo, root, path, text in zip(batch["repo"], batch["root"], batch["path"], batch["text"], strict=True):
                options = _effective(root, path, text)
                base = options.get("base", options.get("stated_in", "."))
                stated = options.get("paths", {})
                mapped = stated | {"*": ["*"]} if "base" in options and "*" not in stated else stated
                directory = os.path.dirname(path) or "."
                found = [(repo, directory, p, [os.path.normpath(os.path.join(base, str(x))) for x in xs], p in stated) for p, xs in mapped.items() if isinstance(xs, list)]
                rows += found or [(repo, directory, None, None, False)]
            yield pd.DataFrame(rows, columns=["repo", "directory", "pattern", "targets", "stated"])

    return configs.mapInPandas(read, "repo string, directory string, pattern string, targets array<string>, stated boolean")


def discover(targets: DataFrame, classify_as: list[tuple[str, str]] | None = None, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, entries, packages) of the workspaces.  files: repo, root, path, source_set, rule, package_path,
    text, read_error; its package is the deepest directory with a manifest."""
    entries = triage(listing(targets), exclude)
    owned_by = packages(entries)
    sources = classify.with_overrides(entries.where("status = 'source'").select("repo", "root", "path"), classify_as or [])
    owners = classify.nearest_owner(sources.select("repo", "path"), owned_by.select("repo", "directory"), by=["repo"])
    files = sources.join(owners.withColumnRenamed("owner", "package_path"), ["repo", "path"])
    return with_text(files), entries, owned_by


def unsupported_packages(files: DataFrame, owned_by: DataFrame) -> DataFrame:
    """repo, directory of the packages with a manifest that own no source file."""
    used = files.select("repo", F.col("package_path").alias("directory")).distinct()
    return owned_by.where("has_manifest").select("repo", "directory").join(used, ["repo", "directory"], "left_anti")


def unsupported_by_extension(entries: DataFrame) -> DataFrame:
    return entries.where("status = 'unsupported'").groupBy("repo", "extension").agg(F.count("*").alias("files"))
