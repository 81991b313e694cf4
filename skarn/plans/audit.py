"""The audit of workspaces: discovery, syntax, complexity, duplication, imports, cycles, metrics, score.

One run audits any number of workspaces (repo, root); every table carries ``repo``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.functions import half_up
from skarn.operators import clone_groups, erosion, graph, resolve, scoring, syntax
from skarn.session import checkpointed
from skarn.sources import workspace

MEASURED = ("production", "test")


@dataclass
class Audit:
    files: DataFrame
    entries: DataFrame
    packages: DataFrame
    parsed: DataFrame
    functions: DataFrame
    clones: DataFrame
    edges: DataFrame
    cycles: DataFrame
    metrics: DataFrame
    findings: DataFrame
    score: DataFrame


def _state(frame: DataFrame, ids: list[tuple[str, Column, Column]]) -> DataFrame:
    """Metrics (repo, id, value, reason) in long form; their state follows: a reason makes one incomplete, no
    value not applicable."""
    rows = F.explode(F.array(*[F.struct(i.alias("id"), v.cast("double").alias("value"), r.cast("string").alias("reason")) for i, v, r in ids]))
    state = F.when(F.col("reason").isNotNull(), "incomplete").when(F.col("value").isNull(), "not-applicable").otherwise("complete")
    return frame.select("repo", rows.alias("m")).select("repo", "m.*").select("repo", "id", state.alias("state"), "value", "reason")


def _scopes(repos: DataFrame) -> DataFrame:
    return repos.withColumn("source_set", F.explode(F.array(*map(F.lit, MEASURED))))


def scope_metrics(repos: DataFrame, parsed: DataFrame, functions: DataFrame, clones: DataFrame) -> DataFrame:
    """Complexity, erosion and duplication metrics of the production and test scopes of every workspace."""
    key = ["repo", "source_set"]
    sizes = parsed.groupBy(*key).agg(F.sum(F.size("code_lines")).alias("sloc"), F.count_if(F.size("problems") > 0).alias("broken"))
    measured = erosion.with_mass(functions)
    micro = F.floor(F.col("mass") * 1e6 + 0.5).cast("bigint")
    sums = measured.groupBy(*key).agg(
        F.count("*").alias("functions"), F.sum(micro).alias("mass"), F.sum(F.when(F.col("eroded"), micro).otherwise(0)).alias("eroded_mass"), F.count_if("eroded").alias("eroded"), F.max("nesting").alias("nesting"), F.max("cc").alias("cc_max"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY cc)").alias("p50"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY cc)").alias("p90"),
    )
    groups = clones.groupBy(*key).agg(F.count_distinct("group_id").alias("groups"))
    lines = clone_groups.duplicated_lines(clones, parsed)
    full = _scopes(repos)
    for part in (sizes, sums, groups, lines):
        full = full.join(part, key, "left")
    full = full.fillna(0, ["sloc", "broken", "functions", "mass", "eroded_mass", "eroded", "groups", "duplicated"])
    why = F.when(F.col("broken") > 0, F.concat(F.col("broken").cast("string"), F.lit(" "), "source_set", F.lit(" file(s) produced parse diagnostics; values are partial")))
    of = lambda name: F.concat(F.lit(name + "."), "source_set")
    return _state(full, [
        (of("complexity.functions"), F.col("functions"), why), (of("complexity.cc.p50"), F.col("p50"), why), (of("complexity.cc.p90"), F.col("p90"), why), (of("complexity.cc.max"), F.col("cc_max"), why),
        (of("complexity.nesting.max"), F.col("nesting"), why), (of("erosion.mass"), half_up(F.col("mass") / 1e6, 3), why), (of("erosion.eroded-count"), F.col("eroded"), why),
        (of("erosion.eroded-share"), F.when(F.col("mass") > 0, half_up(F.col("eroded_mass") / F.col("mass"), 6)), why),
        (of("duplication.groups"), F.col("groups"), why), (of("duplication.duplicated-lines"), F.col("duplicated"), why),
        (of("duplication.density"), F.when(F.col("sloc") > 0, half_up(F.col("duplicated") / F.col("sloc"), 6)), why),
    ])


def cycle_groups(edges: DataFrame) -> DataFrame:
    """repo, edge_class, component, members, path, id: the import cycles of each edge class, with the shortest
    cycle through the first member."""
    separator = "\x1f"
    local = edges.where("status = 'local'").withColumn("edge_class", F.when(F.col("type_only"), "type-only").otherwise("runtime"))
    node = lambda c: F.concat_ws(separator, "repo", "edge_class", c)
    pairs = checkpointed(local.select(node("path").alias("src"), node("target").alias("dst")).distinct())
    members = checkpointed(graph.strong_components(pairs))
    gathered = members.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    if gathered.isEmpty():
        gathered = gathered.withColumn("path", F.col("members"))
    else:
        gathered = gathered.join(graph.shortest_cycle(pairs, members).select("component", "path"), "component")
    part = lambda c, n: F.element_at(F.split(c, separator), n)
    named = gathered.select(
        part(F.col("component"), 1).alias("repo"), part(F.col("component"), 2).alias("edge_class"), part(F.col("component"), 3).alias("component"),
        F.transform("members", lambda m: part(m, 3)).alias("members"), F.transform("path", lambda m: part(m, 3)).alias("path"),
    )
    w = Window.partitionBy("repo").orderBy("component", "edge_class")
    return named.withColumn("id", F.row_number().over(w))


def graph_metrics(repos: DataFrame, parsed: DataFrame, edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """Edge and cycle metrics of every workspace."""
    files = parsed.groupBy("repo").agg(F.count("*").alias("files"), F.count_if(F.size("problems") > 0).alias("broken"))
    counts = edges.groupBy("repo").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("local", "external", "unresolved")])
    touched = cycles.select("repo", F.explode("members").alias("m")).groupBy("repo").agg(F.count_distinct("m").alias("modules"))
    groups = cycles.groupBy("repo").agg(F.count("*").alias("groups"))
    full = repos
    for part in (files, counts, touched, groups):
        full = full.join(part, "repo", "left")
    full = full.fillna(0)
    broken = F.when(F.col("broken") > 0, F.concat(F.col("broken").cast("string"), F.lit(" file(s) produced parse diagnostics; their imports may be missing")))
    lost = F.when(F.col("unresolved") > 0, F.concat(F.col("unresolved").cast("string"), F.lit(" local import edge(s) could not be resolved")))
    both = F.when(lost.isNotNull() | broken.isNotNull(), F.concat_ws("; ", lost, broken))
    cyclic = F.when(both.isNotNull(), F.concat(F.lit("dependency graph incomplete: "), both))
    return _state(full, [
        (F.lit("graph.files"), F.col("files"), F.lit(None)), (F.lit("graph.edges.local"), F.col("local"), broken), (F.lit("graph.edges.external"), F.col("external"), broken), (F.lit("graph.edges.unresolved"), F.col("unresolved"), both),
        (F.lit("import-cycle.groups"), F.col("groups"), cyclic), (F.lit("import-cycle.modules"), F.col("modules"), cyclic),
        (F.lit("import-cycle.density"), F.when(F.col("files") > 0, half_up(F.col("modules") / F.col("files"), 6)), F.when(F.col("files") > 0, cyclic)),
    ])


def unlisted(metrics: DataFrame, entries: DataFrame) -> DataFrame:
    """The metrics, none of them complete in a workspace with folders that couldn't be read."""
    lost = entries.where("ignored = 'unreadable'").groupBy("repo").agg(F.count("*").alias("_n"))
    why = F.concat(F.col("_n").cast("string"), F.lit(" folder(s) could not be read"))
    full = metrics.join(lost, "repo", "left")
    state = F.when(F.col("_n").isNotNull() & (F.col("state") == "complete"), "incomplete").otherwise(F.col("state"))
    reason = F.when(F.col("_n").isNotNull() & (F.col("state") != "not-applicable"), F.concat_ws("; ", "reason", why)).otherwise(F.col("reason"))
    return full.withColumns({"state": state, "reason": reason}).select(metrics.columns)


FINDING = ["repo", "kind", "path", "start_line", "end_line", "summary", "identity"]


def findings(functions: DataFrame, clones: DataFrame, edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """Hotspots, clone groups, unresolved imports and cycles, one row each."""
    none = F.lit(None).cast("string")
    shown = lambda c, d=3: F.regexp_replace(F.format_string(f"%.{d}f", c), r"\.?0+$", "")
    hot = erosion.with_mass(functions).where("eroded")
    hot = hot.select("repo", F.lit("complexity.hotspot").alias("kind"), "path", "start_line", "end_line", F.concat(F.lit("CC "), "cc", F.lit(", mass "), shown(half_up(F.col("mass"), 3)), F.lit(", nesting "), "nesting", F.lit(", SLOC "), "sloc").alias("summary"), F.when(~F.col("ambiguous"), F.concat_ws("#", "path", "identity")).alias("identity"))
    first = clones.groupBy("repo", "source_set", "group_id", "token_count").agg(F.count("*").alias("n"), F.min(F.struct("path", "start_line", "end_line")).alias("f"))
    dup = first.select("repo", F.lit("duplication.clone-group").alias("kind"), "f.path", "f.start_line", "f.end_line", F.concat(F.col("n").cast("string"), F.lit(" copies of "), F.col("token_count").cast("string"), F.lit(" normalized tokens")).alias("summary"), none.alias("identity"))
    lost = edges.where("status = 'unresolved'").select("repo", F.lit("graph.unresolved-import").alias("kind"), "path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.concat(F.lit("unresolved "), "kind", F.lit(" '"), F.coalesce("specifier", F.lit("(non-literal)")), F.lit("': "), "reason").alias("summary"), none.alias("identity"))
    cyc = cycles.select("repo", F.lit("import-cycle").alias("kind"), F.col("component").alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.concat(F.col("edge_class"), F.lit(" cycle: "), F.array_join("path", " -> ")).alias("summary"), none.alias("identity"))
    return hot.unionByName(dup).unionByName(lost).unionByName(cyc).select(FINDING)


def audit(spark: SparkSession, roots: dict[str, str], classify_as: list[tuple[str, str]] | None = None, exclude: list[str] | None = None) -> Audit:
    """Audits the workspaces ``roots`` (repo name to folder).  One whose root can't be read is in ``entries``
    only and stops no other."""
    targets = workspace.targets(spark, roots)
    files, entries, packages = workspace.discover(targets, classify_as, exclude)
    entries = checkpointed(entries)
    packages = checkpointed(workspace.declared(packages, workspace.workspace_globs(entries, packages)))
    parsed = checkpointed(syntax.syntax(files))
    functions = checkpointed(syntax.identities(syntax.functions(parsed).where(F.col("source_set").isin(*MEASURED))))
    clones = checkpointed(clone_groups.clone_members(parsed.where(F.col("source_set").isin(*MEASURED))))
    edges = checkpointed(resolve.resolve(syntax.imports(parsed), entries, packages, workspace.path_mappings(entries)))
    cycles = checkpointed(cycle_groups(edges))
    repos = targets.select("repo").join(entries.where("ignored = 'unreadable' AND path = '.'").select("repo"), "repo", "left_anti")
    metrics = scope_metrics(repos, parsed, functions, clones).unionByName(graph_metrics(repos, parsed, edges, cycles))
    metrics = checkpointed(unlisted(metrics, entries))
    return Audit(files, entries, packages, parsed, functions, clones, edges, cycles, metrics, findings(functions, clones, edges, cycles), scoring.index(metrics, ["repo"]))


def run_rows(done: Audit, audited_at: Column | None = None) -> DataFrame:
    """One row per workspace: repo, audited_at, index, partial, completeness, metrics (a map of JSON)."""
    head = done.score.groupBy("repo").agg(F.max("index").alias("index"), F.bool_or("partial").alias("partial"))
    body = done.metrics.groupBy("repo").agg(F.when(F.bool_or(F.col("state") == "incomplete"), "incomplete").otherwise("complete").alias("completeness"), F.array_sort(F.collect_list(F.struct("id", "state", "value", "reason"))).alias("metrics"))
    return head.join(body, "repo").withColumn("audited_at", F.current_timestamp() if audited_at is None else audited_at)
