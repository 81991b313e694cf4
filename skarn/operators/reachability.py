"""Unused files and exports, derived from edges, declared roots and surfaces.

Every file carries the kinds of roots that reach it as bits; kinds travel along edges by OR until nothing changes.  What the
declarations leave open comes as rows beside the candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators import graph
from skarn.operators.evidence import standing_candidates
from skarn.session import written

ENTRY, TEST = 1, 2


def roots(files: DataFrame, entries: DataFrame, tests_are_roots: bool = True) -> DataFrame:
    """(node, bits) of the files (path, source_set): declared entries (path) by what they are, and all test files if they count."""
    declared = entries.select("path").distinct().join(files, "path").where(F.col("source_set").isin("production", "test"))
    kind = F.when(F.col("source_set") == "production", ENTRY).otherwise(TEST)
    found = declared.select("path", kind.alias("bits"))
    if tests_are_roots:
        found = found.unionByName(files.where("source_set = 'test'").select("path", F.lit(TEST).alias("bits")))
    return found.groupBy(F.col("path").alias("node")).agg(F.bit_or("bits").alias("bits"))


def assumptions(files: DataFrame, entries: DataFrame, surfaces: DataFrame, tests_are_roots: bool = True) -> DataFrame:
    """(id, path): what reachability rests on; a path for each declaration that isn't a measured file, or null."""
    known = files.select("path", "source_set")
    entry = entries.select("path").distinct().join(known, "path", "left").where("source_set IS NULL OR source_set NOT IN ('production', 'test')").select(F.lit("declared-entry-not-in-selection").alias("id"), "path")
    surface = surfaces.select("path").distinct().join(known, "path", "left").where("source_set IS NULL OR source_set <> 'production'")
    gaps = surface.select(F.when(F.col("source_set").isNull(), "declared-public-surface-not-in-selection").otherwise("public-surface-not-production").alias("id"), "path")
    path = files.schema["path"].dataType
    general = [("dependency-context-unverified", F.lit(True)), ("tests-excluded", F.lit(not tests_are_roots) & (F.count_if(F.col("source_set") == "test") > 0))]
    said = files.agg(F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in general))).alias("ids"))
    return entry.unionByName(gaps).unionByName(said.select(F.explode("ids").alias("id"), F.lit(None).cast(path).alias("path")))


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, bits): the OR of the bits of all ``starts`` (node, bits) that reach a node over edges (src, dst).  Chains are
    contracted; each round only carries bits that are new at a node."""
    plain = written(edges.select("src", "dst").where("src <> dst").distinct())
    core, links, _ = graph.chains(plain, starts)
    known = written(starts.select("node", "bits"))
    front = known
    while not front.isEmpty():
        offers = core.join(front.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.bit_or("bits").alias("offer"))
        both = F.coalesce("bits", F.lit(0)).bitwiseOR(F.coalesce("offer", F.lit(0)))
        merged = written(known.join(offers, "node", "full").select("node", both.alias("bits"), (both != F.coalesce("bits", F.lit(0))).alias("fresh")))
        known, front = merged.select("node", "bits"), merged.where("fresh").select("node", "bits")
    heads = core.where("chain IS NOT NULL").select(F.col("src").alias("node"), "chain").join(known, "node").select("chain", "bits")
    return known.unionByName(links.join(heads, "chain").select("node", "bits"))


def unused(files: DataFrame, imports: DataFrame, exports: DataFrame, starts: DataFrame, live: DataFrame) -> DataFrame:
    """(category, path, symbol) of the production files (path, source_set) that no root reaches, and of the exports (path, symbol,
    kind: export or type) of reached ones that no reached file's import (src, dst, symbol; null: all symbols) names.  An entry's own exports
    are used.  ``starts`` are the ``roots``, ``live`` is what is ``reached`` from them."""
    production = files.where("source_set = 'production'").select("path")
    dead = production.join(live.select(F.col("node").alias("path")), "path", "left_anti")
    unused_files = dead.select(F.lit("file").alias("category"), "path", F.lit(None).cast("string").alias("symbol"))
    entry = starts.where(F.col("bits").bitwiseAND(ENTRY) > 0).select(F.col("node").alias("path"))
    open_ = exports.join(production, "path", "left_semi").join(live.select(F.col("node").alias("path")), "path", "left_semi").join(entry, "path", "left_anti")
    named = imports.where("src <> dst").join(live.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("path"), "symbol").distinct()
    whole = named.where("symbol IS NULL").select("path")
    left = open_.join(whole, "path", "left_anti").join(named.where("symbol IS NOT NULL"), ["path", "symbol"], "left_anti")
    return unused_files.unionByName(left.select(F.col("kind").alias("category"), "path", "symbol").distinct())


def judged(candidates: DataFrame, surfaces: DataFrame, files: DataFrame) -> DataFrame:
    """The candidates with ``exempt_by``, by the public surfaces (path, export, place) that are production files."""
    resolved = surfaces.join(files.where("source_set = 'production'").select("path"), "path", "left_semi")
    return standing_candidates(candidates, resolved)
