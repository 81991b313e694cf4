"""How far hooks and budgets are wired in a workspace: one row per surface found, merged by rank.

A surface is a configuration that would enforce something.  ``structurally-wired`` means that a committed
script or workflow reaches it, ``configured`` that it is only there, ``unknown`` that it can't be read as data
(executable or malformed).  Nothing is executed."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators import safeguards
from skarn.sources.workspace import _yaml

# Files that are surfaces, and the command shapes that reach them.
HUSKY_HOOK = ".husky/pre-commit"
LEFTHOOK = ["lefthook.yml", "lefthook.yaml", ".lefthook.yml", ".lefthook.yaml"]
PRE_COMMIT = [".pre-commit-config.yaml", ".pre-commit-config.yml"]
EXECUTABLE_HOOKS = ["husky.config.js", "husky.config.cjs", ".huskyrc", ".huskyrc.js", ".huskyrc.json"]
AGENT_SETTINGS = ".claude/settings.json"
COVERAGE_BUDGETS = ["scripts/coverage-budgets.json", "coverage-budgets.json"]
EXECUTABLE_COVERAGE = ["vitest.config.ts", "vitest.config.js", "jest.config.ts", "jest.config.js"]
SIZE_BUDGETS = ["scripts/file-size-budgets.json", "file-size-budgets.json"]
DUPLICATION_CONFIG = ".jscpd.json"
HOOKS_PATH = r"\bgit\s+config\s+core\.hooksPath\s+(\S+)"
REACHES = {"husky": r"\bhusky\b", "lefthook": r"\blefthook\s+(?:install|run)\b", "pre-commit": r"\bpre-commit\s+run\b", "duplication": r"\bjscpd\b"}
PRE_COMMIT_ACTION = r"^pre-commit/action@"
# Ranks of the levels, by position.
LEVELS = ["absent", "unknown", "configured", "structurally-wired"]
SAFEGUARDS = ["git-hooks", "agent-hooks", "coverage-budget", "file-size-budget", "duplication-budget"]

_FORMS = {"yaml": LEFTHOOK + PRE_COMMIT, "json": [*COVERAGE_BUDGETS, *SIZE_BUDGETS, DUPLICATION_CONFIG, AGENT_SETTINGS], "any": [HUSKY_HOOK, *EXECUTABLE_HOOKS, *EXECUTABLE_COVERAGE]}


def _sound(form: str, text: str) -> bool:
    if form == "yaml":
        return isinstance(_yaml(text), dict | list)
    if form == "json":
        try:
            json.loads(text)
        except ValueError:
            return False
    return True


def surface_files(targets: DataFrame) -> DataFrame:
    """repo, root, path, text, sound: the surface files that a workspace has, and whether they parse."""

    def read(batches):
        for batch in batches:
            rows = []
            for repo, root in zip(batch["repo"], batch["root"], strict=True):
                for form, paths in _FORMS.items():
                    for path in paths:
                        file = Path(root, path)
                        if file.is_file():
                            try:
                                text = file.read_text(encoding="utf-8", errors="replace")
                                rows.append((repo, root, path, text, _sound(form, text)))
                            except OSError:
                                rows.append((repo, root, path, "", False))
            yield pd.DataFrame(rows, columns=["repo", "root", "path", "text", "sound"])

    return targets.select("repo", "root").mapInPandas(read, "repo string, root string, path string, text string, sound boolean")


def with_presence(named: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``present``: whether ``path`` is a file of the workspace; dot folders, which no listing enters, count."""
    rows = named.join(targets.select("repo", "root"), "repo")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", present boolean"

    def look(batches):
        for batch in batches:
            yield batch.assign(present=[os.path.isfile(os.path.join(r, p)) for r, p in zip(batch["root"], batch["path"], strict=True)])

    return rows.mapInPandas(look, schema).drop("root")


def _wired(found: Column) -> Column:
    return F.when(found, "structurally-wired").otherwise("configured")


def _reached(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds ``hit``: whether the row's workspace is among ``hits`` (repo)."""
    return rows.join(hits.select("repo").distinct().withColumn("_h", F.lit(True)), "repo", "left").withColumn("hit", F.coalesce("_h", F.lit(False))).drop("_h")


def _surface(rows: DataFrame, safeguard: str, level: Column) -> DataFrame:
    return rows.select("repo", F.lit(safeguard).alias("safeguard"), "path", level.alias("level"))


def _first(files: DataFrame, paths: list[str]) -> DataFrame:
    """The first of ``paths`` that each workspace has."""
    order = F.array_position(F.array(*map(F.lit, paths)), F.col("path"))
    return files.where(F.col("path").isin(paths)).groupBy("repo").agg(F.min_by(F.struct("path", "text", "sound"), order).alias("f")).select("repo", "f.*")


def git_hooks(targets: DataFrame, files: DataFrame, packages: DataFrame, declared: DataFrame, commands: DataFrame, uses: DataFrame) -> DataFrame:
    """Hook paths set by scripts, husky, and the hook managers' files."""
    everywhere = declared.select("repo", "command").unionByName(commands.select("repo", "command"))
    folder = F.regexp_replace(F.regexp_replace(F.regexp_extract("command", HOOKS_PATH, 1), r"^\.?/", ""), "/$", "")
    hooked = declared.select("repo", folder.alias("_d")).where("_d <> ''").select("repo", F.concat("_d", F.lit("/pre-commit")).alias("path")).distinct()
    out = _surface(with_presence(hooked, targets), "git-hooks", _wired(F.col("present")))
    installed = declared.where((F.col("name") == "prepare") & F.col("command").rlike(REACHES["husky"]))
    husky = files.where(F.col("path") == HUSKY_HOOK).select("repo", "path")
    out = out.unionByName(_surface(_reached(husky, installed), "git-hooks", _wired(F.col("hit"))))
    keyed = packages.where("directory = '.' AND get_json_object(manifest, '$.husky') IS NOT NULL").select("repo", F.lit("package.json").alias("path"))
    out = out.unionByName(_surface(keyed.join(husky.select("repo"), "repo", "left_anti"), "git-hooks", F.lit("configured")))
    lefthook = _first(files, LEFTHOOK)
    pre_commit = _first(files, PRE_COMMIT).join(lefthook.select("repo"), "repo", "left_anti")
    runs = everywhere.where(F.col("command").rlike(REACHES["pre-commit"])).select("repo").unionByName(uses.where(F.col("action").rlike(PRE_COMMIT_ACTION)).select("repo"))
    for managed, hits in ((lefthook, everywhere.where(F.col("command").rlike(REACHES["lefthook"]))), (pre_commit, runs)):
        out = out.unionByName(_surface(_reached(managed, hits), "git-hooks", F.when(~F.col("sound"), "unknown").otherwise(_wired(F.col("hit")))))
    return out.unionByName(_surface(files.where(F.col("path").isin(EXECUTABLE_HOOKS)), "git-hooks", F.lit("unknown")))


def budgets(files: DataFrame, packages: DataFrame, declared: DataFrame, commands: DataFrame) -> DataFrame:
    """Coverage, file-size and duplication budgets; one is enforced by a workflow command, or by a script that a
    workflow reaches."""
    reached = safeguards.reachable_scripts(declared, commands).select("repo", "name")
    running = commands.select("repo", "command").unionByName(declared.join(reached, ["repo", "name"], "left_semi").select("repo", "command"))

    def judged(rows: DataFrame, safeguard: str, enforces) -> DataFrame:
        hits = rows.select("repo", "path").join(running, "repo").where(enforces)
        return _surface(_reached(rows, hits), safeguard, F.when(~F.col("sound"), "unknown").otherwise(_wired(F.col("hit"))))

    named, tool = F.contains(F.col("command"), F.col("path")), F.col("command").rlike(REACHES["duplication"])
    coverage = _first(files, COVERAGE_BUDGETS)
    executable = _first(files, EXECUTABLE_COVERAGE).join(coverage.select("repo"), "repo", "left_anti")
    config = _first(files, [DUPLICATION_CONFIG]).select("repo", "path", "sound")
    keyed = packages.where("directory = '.' AND get_json_object(manifest, '$.jscpd') IS NOT NULL").select("repo", F.lit("package.json").alias("path"), F.lit(True).alias("sound"))
    config = config.unionByName(keyed.join(config.select("repo"), "repo", "left_anti"))
    out = judged(coverage, "coverage-budget", named).unionByName(_surface(executable, "coverage-budget", F.lit("unknown")))
    return out.unionByName(judged(_first(files, SIZE_BUDGETS), "file-size-budget", named)).unionByName(judged(config, "duplication-budget", tool))


def agent_hooks(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Hook commands of the agent settings: wired if they name only files that are there and at least one does;
    unknown if none names a file; instructions for agents are no surface."""
    settings = files.where(F.col("path") == AGENT_SETTINGS)
    form = "map<string,array<struct<hooks:array<struct<command:string>>>>>"
    event = F.explode_outer(F.map_values(F.from_json(F.get_json_object("text", "$.hooks"), form)))
    entries = settings.where("sound AND text RLIKE '^\\\\s*[{]'").select("repo", event.alias("e")).select("repo", F.explode("e.hooks").alias("h"))
    hooks = entries.select("repo", F.explode("h.command").alias("command")).where("command <> ''")
    paths = hooks.select("repo", F.explode(safeguards.local_paths(F.col("command"))).alias("path")).distinct()
    seen = with_presence(paths, targets).groupBy("repo").agg(F.bool_and("present").alias("whole"))
    level = F.when(F.col("whole").isNull(), "unknown").otherwise(_wired(F.col("whole")))
    told = hooks.select("repo").distinct().join(seen, "repo", "left").withColumn("path", F.lit(AGENT_SETTINGS))
    return _surface(told, "agent-hooks", level).unionByName(_surface(settings.where("NOT sound OR NOT text RLIKE '^\\\\s*[{]'"), "agent-hooks", F.lit("unknown")))


def merged(repos: DataFrame, surfaces: DataFrame) -> DataFrame:
    """repo, safeguard, level, paths: the highest level of all surfaces, their paths in order; absent without any."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    best = surfaces.groupBy("repo", "safeguard").agg(F.max_by("level", rank).alias("level"), F.array_sort(F.collect_set("path")).alias("paths"))
    every = repos.select("repo", F.explode(F.array(*map(F.lit, SAFEGUARDS))).alias("safeguard"))
    return every.join(best, ["repo", "safeguard"], "left").fillna("absent", ["level"]).withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))


def levels(targets: DataFrame, packages: DataFrame) -> DataFrame:
    """Git hooks, agent hooks and budgets of all workspaces (``merged``)."""
    declared, commands = safeguards.scripts(packages), safeguards.workflow_commands(targets)
    files, uses = surface_files(targets), safeguards.workflow_actions(targets)
    found = git_hooks(targets, files, packages, declared, commands, uses)
    found = found.unionByName(budgets(files, packages, declared, commands)).unionByName(agent_hooks(targets, files))
    return merged(targets, found)
