"""Which checks a workspace declares and which of them its workflows reach; nothing is executed."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators import graph

# The command shapes that count as a check or as a reference to a script.
RUN_REFERENCE = r"\b(?:bun|npm|pnpm|yarn)\s+run\s+([A-Za-z0-9:_-]+)"
CHECKS = {"test": r"\b(?:bun\s+test|vitest|jest|node\s+--test|mocha)\b", "lint": r"\b(?:biome\s+(?:check|lint|ci)|eslint|oxlint)\b", "typecheck": r"\btsc\b"}
NO_EMIT = r"(?:^|\s)--noEmit(?:\s|$|=)"
# A path of a command: two names or more, from a blank or quote to a blank, quote or separator.
LOCAL_PATH = r"""(?<![^\s"'])(?:\./)?((?!-)[\w.+-]+(?:/[\w.+-]+)+)/?(?=[\s"',;]|$)"""


def run_references(command: Column) -> Column:
    return F.regexp_extract_all(command, F.lit(RUN_REFERENCE), 1)


def recognised_check(command: Column) -> Column:
    """test, lint, typecheck (only without output) or null."""
    return F.when(command.rlike(CHECKS["test"]), "test").when(command.rlike(CHECKS["lint"]), "lint").when(command.rlike(CHECKS["typecheck"]) & command.rlike(NO_EMIT), "typecheck")


def local_paths(command: Column) -> Column:
    """Paths within the workspace that a command names, each once, in order; none that goes up."""
    return F.array_distinct(F.filter(F.regexp_extract_all(command, F.lit(LOCAL_PATH), 1), lambda t: ~t.contains("..")))


def scripts(packages: DataFrame) -> DataFrame:
    """repo, name, command of the scripts in root manifests."""
    parsed = F.from_json(F.get_json_object("manifest", "$.scripts"), "map<string,string>")
    return packages.where("directory = '.' AND has_manifest").select("repo", F.explode(parsed).alias("name", "command"))


def _scalars(node: yaml.Node | None, key: str) -> Iterator[yaml.ScalarNode]:
    """The values of ``key`` that are scalars, in all mappings of a document; an anchor's node is met once at each place."""
    for child in node.value if isinstance(node, yaml.CollectionNode) else []:
        if isinstance(child, tuple):
            name, value = child
            if name.value == key and isinstance(value, yaml.ScalarNode):
                yield value
            child = value
        yield from _scalars(child, key)


def _told(text: str, key: str) -> list[tuple[int, str]]:
    """(line, text) of each value of ``key``; of a block each line that isn't blank."""
    source, out = text.split("\n"), []
    for node in _scalars(yaml.compose(text, yaml.SafeLoader), key):
        first, last = node.start_mark.line, node.end_mark.line
        if node.style in ("|", ">"):
            out += [(n + 1, line) for n in range(first + 1, min(last + 1, len(source))) if (line := source[n].strip()) and line in node.value]
        elif node.value.strip():
            out.append((first + 1, node.value.strip()))
    return out


def _workflows(targets: DataFrame) -> DataFrame:
    """repo, workflow, line, key (run or uses), value of each file below .github/workflows; a file that can't be read or isn't YAML
    is one row with its ``problem``."""

    def read(batches):
        for batch in batches:
            rows = []
            for repo, root in zip(batch["repo"], batch["root"], strict=True):
                folder = Path(root, ".github", "workflows")
                for name in sorted(os.listdir(folder)) if folder.is_dir() else []:
                    if name.endswith((".yml", ".yaml")):
                        where = repo, f".github/workflows/{name}"
                        try:
                            text = (folder / name).read_text(errors="replace")
                            rows += [(*where, n, key, told, None) for key in ("run", "uses") for n, told in _told(text, key)]
                        except (OSError, yaml.YAMLError, RecursionError) as problem:
                            rows.append((*where, None, None, None, type(problem).__name__))
            yield pd.DataFrame(rows, columns=["repo", "workflow", "line", "key", "value", "problem"]).astype({"line": "Int32"})

    return targets.select("repo", "root").mapInPandas(read, "repo string, workflow string, line int, key string, value string, problem string")


def workflow_commands(targets: DataFrame) -> DataFrame:
    """repo, workflow, line, command of the ``run`` steps below .github/workflows."""
    return _workflows(targets).where("key = 'run'").select("repo", "workflow", "line", F.col("value").alias("command"))


def workflow_actions(targets: DataFrame) -> DataFrame:
    """repo, workflow, line, action of the ``uses`` steps."""
    return _workflows(targets).where("key = 'uses'").select("repo", "workflow", "line", F.col("value").alias("action"))


def workflow_problems(targets: DataFrame) -> DataFrame:
    """repo, workflow, problem of the workflows that can't be read; they stop no other."""
    return _workflows(targets).where("problem IS NOT NULL").select("repo", "workflow", "problem")


def reachable_scripts(declared: DataFrame, commands: DataFrame) -> DataFrame:
    """repo, name, depth of the scripts that a workflow runs, directly or through other scripts."""
    node = lambda name: F.concat_ws("\x1f", "repo", name)
    known = declared.select(node("name").alias("node"))
    refs = lambda rows: rows.withColumn("ref", F.explode(run_references(F.col("command"))))
    edges = refs(declared).select(node("name").alias("src"), node("ref").alias("dst")).join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").distinct()
    seeds = refs(commands).select(node("ref").alias("node")).join(known, "node", "left_semi")
    met = graph.reach(edges, seeds)
    return met.select(F.split_part("node", F.lit("\x1f"), F.lit(1)).alias("repo"), F.split_part("node", F.lit("\x1f"), F.lit(2)).alias("name"), "depth")


def check_levels(targets: DataFrame, packages: DataFrame) -> DataFrame:
    """repo, check, level: absent, configured, or structurally-wired (a workflow reaches the script or runs
    the same check itself)."""
    declared, commands = scripts(packages), workflow_commands(targets)
    reached = reachable_scripts(declared, commands).select("repo", "name", F.lit(True).alias("reached"))
    found = declared.withColumn("check", recognised_check(F.col("command"))).where("check IS NOT NULL").join(reached, ["repo", "name"], "left")
    level = found.groupBy("repo", "check").agg(F.max(F.coalesce("reached", F.lit(False))).alias("wired"))
    direct = commands.select("repo", recognised_check(F.col("command")).alias("check")).where("check IS NOT NULL").distinct().withColumn("direct", F.lit(True))
    every = targets.select("repo", F.explode(F.array(*map(F.lit, CHECKS))).alias("check"))
    full = every.join(level, ["repo", "check"], "left").join(direct, ["repo", "check"], "left")
    return full.select("repo", "check", F.when(F.col("wired").isNull(), "absent").when(F.col("wired") | F.coalesce("direct", F.lit(False)), "structurally-wired").otherwise("configured").alias("level"))


def broken_paths(targets: DataFrame, packages: DataFrame, entries: DataFrame) -> DataFrame:
    """repo, name, missing: files that a script names and that aren't there.  Paths in directories that the
    listing leaves out can't be told and aren't reported."""
    named = scripts(packages).select("repo", "name", F.explode(local_paths(F.col("command"))).alias("path")).where(F.col("path").rlike(r"\.[A-Za-z]\w*$") & ~F.col("path").rlike(r"(^|/)(\.|node_modules/)"))
    return named.join(entries.where("ignored IS NULL").select("repo", "path"), ["repo", "path"], "left_anti").select("repo", "name", F.col("path").alias("missing"))
