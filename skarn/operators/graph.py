"""Graph fixpoints as joins; every round is written to the shared folder.

Rounds don't follow the length of chains: nodes with one edge in and one out are first contracted by pointer jumping, in a
number of rounds that is logarithmic in the longest chain, and what is left is worked on by labels that jump as well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.session import written

FEWER = 0.9  # a contraction that leaves more than this part of the edges is the last
TRIMS = 3


def chains(edges: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(core, links, rings) of distinct edges (src, dst) without loops.

    A link has one edge in and one out and isn't in ``keep`` (node).  ``core`` (src, dst, length, chain) has an edge for each chain of
    links between two other nodes, named by its first link, and those edges that touch no link (chain null); ``links`` (node, chain,
    place from 0) says where each link went; ``rings`` (node, least) are the links of closed rings without another node."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outs"), F.min("dst").alias("next"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ins"), F.min("src").alias("prev"))
    ends = out.join(into, "node").where("outs = 1 AND ins = 1").select("node", "prev", "next")
    ends = written(ends if keep is None else ends.join(keep.select("node"), "node", "left_anti"))
    is_link = ends.select(F.col("node").alias("prev"), F.lit(True).alias("inner"))
    # ``to`` is a link before the node, ``place`` its distance; done once ``to`` is its chain's first.
    walk = ends.join(is_link, "prev", "left").select("node", F.when(F.col("inner"), F.col("prev")).otherwise(F.col("node")).alias("to"), F.when(F.col("inner"), 1).otherwise(0).cast("bigint").alias("place"), F.col("inner").isNull().alias("done"), F.when(F.col("inner"), F.least("node", "prev")).otherwise(F.col("node")).alias("least"))
    walk = written(walk)
    total, covered = walk.count(), 1
    while covered <= total and not walk.where("NOT done").isEmpty():
        ahead = walk.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("place").alias("more"), F.col("done").alias("done2"), F.col("least").alias("least2"))
        jumped = walk.where("NOT done").join(ahead, "to").select("node", F.col("to2").alias("to"), (F.col("place") + F.col("more")).alias("place"), F.col("done2").alias("done"), F.least("least", "least2").alias("least"))
        # Dealt anew in every round, as a union's partitions add up.
        walk = written(jumped.unionByName(walk.where("done")).repartition("node"))
        covered *= 2
    links = walk.where("done").select("node", F.col("to").alias("chain"), "place")
    rings = walk.where("NOT done").select("node", "least")
    sizes = links.groupBy("chain").agg(F.count("*").alias("size"), F.max(F.struct("place", "node"))["node"].alias("tail"))
    first = ends.select(F.col("node").alias("chain"), F.col("prev").alias("src"))
    last = ends.select(F.col("node").alias("tail"), F.col("next").alias("dst"))
    spans = sizes.join(first, "chain").join(last, "tail").select("src", "dst", (F.col("size") + 1).alias("length"), "chain")
    plain = edges.join(ends.select(F.col("node").alias("src")), "src", "left_anti").join(ends.select(F.col("node").alias("dst")), "dst", "left_anti")
    core = plain.select("src", "dst", F.lit(1).cast("bigint").alias("length"), F.lit(None).cast(links.schema["chain"].dataType).alias("chain")).unionByName(spans)
    return written(core), links, rings


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, depth: all nodes reachable from ``seeds`` (node) over edges (src, dst), at least depth."""
    seeds = written(seeds.select("node").distinct())
    plain = written(edges.select("src", "dst").where("src <> dst").distinct())
    core, links, _ = chains(plain, seeds)
    known = written(seeds.withColumn("depth", F.lit(0).cast("bigint")))
    front = known
    while not front.isEmpty():
        step = core.join(front.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("length")).alias("offer"))
        merged = written(known.join(step, "node", "full").select("node", F.least("depth", "offer").alias("depth"), (F.coalesce(F.col("offer") < F.col("depth"), F.col("depth").isNull())).alias("fresh")))
        known, front = merged.select("node", "depth"), merged.where("fresh").select("node", "depth")
    heads = core.where("chain IS NOT NULL").select(F.col("src").alias("node"), "chain").join(known, "node").select("chain", "depth")
    return known.unionByName(links.join(heads, "chain").select("node", (F.col("depth") + F.col("place") + 1).alias("depth")))


def trimmed(edges: DataFrame, rounds: int = TRIMS) -> DataFrame:
    """Edges whose ends both have an edge in and one out, so many times over: all edges of cycles stay."""
    n = edges.count()
    for _ in range(rounds):
        both = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
        edges = written(edges.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def least_reaching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label: the smallest node from which each of ``nodes`` is reached (itself included).  A label's own label
    reaches the node too, so labels jump to it in every round."""
    labels = written(nodes.select("node", F.col("node").alias("label")))
    while True:
        offers = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("offer"))
        step = written(labels.join(offers, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label")))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = written(step.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")))
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels


def _dense_components(edges: DataFrame) -> DataFrame | None:
    """node, component of all nodes of edges that trimming leaves; a node alone may be a component.

    The smallest node that reaches a node is its label; nodes of a label that reach that node are one component.  Found
    nodes are taken out and the rest goes round again."""
    found = None
    while not edges.isEmpty():
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        forward = least_reaching(edges, nodes)
        label = lambda end: forward.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        inside = written(edges.join(label("src"), "src").join(label("dst"), "dst").where("src_label = dst_label").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # No node of a label is smaller than the label, so what reaches it has it as its least target.
        back = least_reaching(inside, nodes).withColumnRenamed("label", "target")
        part = written(forward.join(back, "node").where("label = target").select("node", F.col("label").alias("component")))
        found = part if found is None else written(found.unionByName(part))
        gone = part.select("node")
        edges = trimmed(edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component: for the nodes on a cycle, the smallest node of their strongly connected component.

    Chains are contracted as long as that takes away many edges; a chain belongs to the component that its two outer
    nodes share."""
    edges = written(edges.select("src", "dst").distinct())
    loops = written(edges.where("src = dst").select(F.col("src").alias("node")))
    edges = trimmed(edges.where("src <> dst"))
    found: list[DataFrame] = []
    contracted: list[tuple[DataFrame, DataFrame]] = []
    n = edges.count()
    while n:
        core, links, rings = chains(edges)
        found.append(rings.select("node", F.col("least").alias("component")))
        contracted.append((core, links))
        edges = trimmed(core.where("src <> dst").select("src", "dst").distinct())
        left = edges.count()
        if left > FEWER * n:
            break
        n = left
    dense = _dense_components(edges)
    known = loops.withColumn("component", F.col("node")).limit(0) if dense is None else dense
    for part in found:
        known = known.unionByName(part)

    def with_alone(known: DataFrame, nodes: DataFrame) -> DataFrame:
        """Nodes with a loop that are in no component are one each."""
        return written(known.unionByName(nodes.distinct().join(known.select("node"), "node", "left_anti").withColumn("component", F.col("node"))))

    for core, links in reversed(contracted):
        known = with_alone(known, core.where("src = dst").select(F.col("src").alias("node")))
        end = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))  # noqa: B023, E731
        within = core.where("chain IS NOT NULL").join(end("src"), "src").join(end("dst"), "dst").where("src_component = dst_component").select("chain", F.col("src_component").alias("component"))
        known = written(known.unionByName(links.join(within, "chain").select("node", "component")))
    known = with_alone(known, loops)
    least = known.groupBy("component").agg(F.count("*").alias("size"), F.min("node").alias("least"))
    kept = known.join(least, "component").join(loops.withColumn("loop", F.lit(True)), "node", "left")
    return kept.where("size > 1 OR loop").select("node", F.col("least").alias("component"))


def shortest_cycle(edges: DataFrame, members: DataFrame) -> DataFrame:
    """component, path: the shortest cycle through the smallest node of each component, the first in node order of several.

    Chains between other nodes are single steps with a length.  The best path to each node (length, then node order) is carried
    along, and only from nodes whose path improved and that are nearer than the cycle found so far."""
    c = F.col
    inner, outer = members.select(c("node").alias("src"), "component"), members.select(c("node").alias("dst"), c("component").alias("c"))
    within = written(edges.select("src", "dst").distinct().join(inner, "src").join(outer, "dst").where("component = c").select("component", "src", "dst"))
    roots = members.where("node = component").select("node")
    loops = within.where("src = dst AND src = component").select("component", F.array("src", "dst").alias("path"))
    core, links, _ = chains(within.where("src <> dst").select("src", "dst"), roots)
    inside = links.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]).alias("nodes"))
    steps = core.join(inside, "chain", "left").select("src", F.concat(F.coalesce("nodes", F.array().cast(inside.schema["nodes"].dataType)), F.array("dst")).alias("via"), "dst")
    steps = written(steps.join(members.withColumnRenamed("node", "src"), "src").groupBy("component", "src", "dst").agg(F.min(F.struct(F.size("via").alias("n"), "via")).alias("s")).select("component", "src", "dst", c("s.via").alias("via")))
    best = lambda path: F.min(F.struct(F.size(path).alias("n"), c(path).alias("path")))
    front = written(members.where("node = component").select("component", "node", F.array("node").alias("path")))
    found = written(loops)
    seen = written(front)
    while not front.isEmpty():
        step = written(front.join(steps.withColumnRenamed("src", "node"), ["component", "node"]).select("component", "dst", F.concat("path", "via").alias("path")))
        closed = found.unionByName(step.where("dst = component").select("component", "path"))
        found = written(closed.groupBy("component").agg(best("path").alias("b")).select("component", "b.path"))
        offers = step.where("dst <> component").groupBy("component", c("dst").alias("node")).agg(best("path").alias("b"))
        key = ["component", "node"]
        merged = seen.withColumn("s", F.struct(F.size("path").alias("n"), "path")).drop("path").join(offers, key, "full")
        merged = written(merged.select(*key, F.least("s", "b")["path"].alias("path"), F.coalesce(c("b") < c("s"), c("s").isNull()).alias("fresh")))
        seen = merged.drop("fresh")
        bound = found.select("component", F.size("path").alias("limit"))
        front = merged.where("fresh").drop("fresh").join(bound, "component", "left").where("limit IS NULL OR size(path) < limit").drop("limit")
        front = written(front)
    return found


def boundary_violations(edges: DataFrame, rules: list[dict], allowed: list[dict]) -> DataFrame:
    """Edges (src, dst, from_name, to_name, kind) that a forbidden rule's patterns and kinds match and no
    allowed rule's do; rules are a configuration, a condition each.  A rule without kinds has all."""

    def matches(r: dict) -> Column:
        kinds = F.col("kind").isin(r["edges"]) if "edges" in r else F.lit(True)
        return F.col("from_name").rlike(r["from"]) & F.col("to_name").rlike(r["to"]) & kinds

    free = F.lit(False)
    for r in allowed:
        free = free | matches(r)
    return edges.where(~free).withColumn("rule", F.explode(F.array_compact(F.array(*[F.when(matches(r), F.lit(r["name"])) for r in rules]))))
