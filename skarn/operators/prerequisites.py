"""Order of prerequisites within any number of scopes at once.

A scope's items (scope, id) require others (scope, id, requires).  A scope whose items require an unregistered one, or each
other in a circle, is refused by name; the others are ordered by level (the longest way to an item without prerequisites), then id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators import graph
from skarn.operators.keyed import numbered
from skarn.session import written

SEPARATOR = "\x1f"


def peeled(items: DataFrame, requires: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scope, id, level) of the items whose prerequisites all end, and (scope, id) of those on a circle or behind one.

    Each round takes off the items without a remaining prerequisite, in all scopes together, and lowers the counts of those that
    require them; so there are as many rounds as levels."""
    counts = requires.groupBy("scope", "id").agg(F.count("*").alias("open"))
    left = written(items.join(counts, ["scope", "id"], "left").select("scope", "id", F.coalesce("open", F.lit(0)).alias("open")))
    done = []
    while True:
        ready = left.where("open = 0").select("scope", "id", F.lit(len(done)).alias("level"))
        done.append(ready)
        if ready.isEmpty():
            return reduce(DataFrame.unionByName, done), left.select("scope", "id")
        # What is met goes, so later rounds only move the prerequisites that are still open.
        met = written(requires.join(ready.select("scope", F.col("id").alias("requires"), F.lit(True).alias("met")), ["scope", "requires"], "left"))
        freed = met.where("met").groupBy("scope", "id").agg(F.count("*").alias("freed"))
        requires = met.where("met IS NULL").select("scope", "id", "requires")
        left = written(left.where("open > 0").join(freed, ["scope", "id"], "left").select("scope", "id", (F.col("open") - F.coalesce("freed", F.lit(0))).alias("open")))


def unregistered(items: DataFrame, requires: DataFrame) -> DataFrame:
    """(scope, code, detail): the first unregistered prerequisite of each scope that has one."""
    known = items.select("scope", F.col("id").alias("requires"))
    missing = requires.join(known, ["scope", "requires"], "left_anti").groupBy("scope").agg(F.min(F.struct("id", "requires")).alias("m"))
    return missing.select("scope", F.lit("unregistered").alias("code"), F.concat("m.id", F.lit(" requires "), "m.requires").alias("detail"))


def circles(items: DataFrame, requires: DataFrame, stuck: DataFrame) -> DataFrame:
    """(scope, code, detail): the shortest circle through the smallest item of a scope that is on one (of several the first by ids),
    from there back to it."""
    node = lambda c: F.concat_ws(SEPARATOR, F.col("scope").cast("string"), c)
    among = requires.join(stuck, ["scope", "id"], "left_semi").join(stuck.withColumnRenamed("id", "requires"), ["scope", "requires"], "left_semi")
    edges = written(among.select(node("id").alias("src"), node("requires").alias("dst")).distinct())
    found = graph.shortest_cycle(edges, written(graph.strong_components(edges)))
    ids = F.transform("path", lambda x: F.element_at(F.split(x, SEPARATOR), -1))
    named = found.select(F.split("component", SEPARATOR)[0].cast(items.schema["scope"].dataType).alias("scope"), ids.alias("ids"))
    first = named.groupBy("scope").agg(F.min_by("ids", F.col("ids")[0]).alias("ids"))
    return first.select("scope", F.lit("cycle").alias("code"), F.array_join("ids", " -> ").alias("detail"))


def _judged(items: DataFrame, requires: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, registered requirements, levels, refused), the first two without the scopes that lack a prerequisite: those are refused
    first, and nothing more is asked of them."""
    items = written(items.select("scope", "id").distinct())
    requires = written(requires.select("scope", "id", "requires").distinct())
    missing = written(unregistered(items, requires))
    named = missing.select("scope")
    items = written(items.join(named, "scope", "left_anti"))
    registered = written(requires.join(named, "scope", "left_anti").join(items, ["scope", "id"], "left_semi"))
    levels, stuck = peeled(items, registered)
    return items, registered, levels, written(missing.unionByName(circles(items, registered, stuck)))


def refused(items: DataFrame, requires: DataFrame) -> DataFrame:
    """(scope, code, detail) of the scopes that have no order: by their first unregistered prerequisite, else a circle."""
    return _judged(items, requires)[3]


def ordered(items: DataFrame, requires: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(order, refused).  ``order`` (scope, id, level, place from 1, required) has the items of all scopes that aren't refused;
    ``required`` are the ``wanted`` (scope, id) and all that they require, over any number of steps."""
    items, registered, levels, refused = _judged(items, requires)
    registered = registered.join(refused.select("scope"), "scope", "left_anti")
    node = lambda c: F.struct("scope", F.col(c).alias("id"))
    closure = graph.reach(registered.select(node("id").alias("src"), node("requires").alias("dst")), wanted.join(items.join(refused.select("scope"), "scope", "left_anti"), ["scope", "id"], "left_semi").select(node("id").alias("node")))
    accepted = levels.join(refused.select("scope"), "scope", "left_anti").join(closure.select("node.scope", "node.id", F.lit(True).alias("required")), ["scope", "id"], "left")
    placed = numbered(accepted, ["scope"], ["level", "id"], "place")
    return placed.select("scope", "id", "level", (F.col("place") + 1).alias("place"), F.coalesce("required", F.lit(False)).alias("required")), refused
