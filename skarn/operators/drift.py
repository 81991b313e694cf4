"""Drift of workspaces from a canonical set of files: what differs, and whether that is allowed."""

from __future__ import annotations

import fnmatch
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHERS = ("exact", "text", "json-subset", "yaml-subset", "template")
STATES = ("match", "allowed-delta", "drift", "missing", "extra")
DIVERGENCES = "array<struct<path:string,kind:string>>"


_INNER = object()  # stands for the value of an inner node


def normalised_text(text: str) -> str:
    """Line feeds only, no blanks at line ends, no blank lines at the edges."""
    return re.sub(r"(?m)[ \t]+$", "", text.replace("\r\n", "\n").replace("\r", "\n")).strip("\n")


def nodes(document) -> dict[tuple, object]:
    """Every node of a document by its path; lists are values, told apart by their JSON."""
    out: dict[tuple, object] = {}
    pending = [((), document)]
    while pending:
        path, value = pending.pop()
        if isinstance(value, dict):
            out[path] = _INNER
            pending += [((*path, str(k)), v) for k, v in value.items()]
        else:
            out[path] = json.dumps(value, sort_keys=True, default=str)
    return out


def subset(canon, target) -> list[tuple[str, str]]:
    """What tells the target's nodes from the canon's, by path: the topmost nodes that it lacks (missing) or has
    of its own (added), and those whose value is another (changed)."""
    wanted, there = nodes(canon), nodes(target)
    rows = [(path, "changed") for path in wanted.keys() & there.keys() if wanted[path] != there[path]]
    for own, other, kind in ((wanted, there, "missing"), (there, wanted, "added")):
        rows += [(path, kind) for path in own.keys() - other.keys() if other.get(path[:-1]) is _INNER]
    return [(".".join(path), kind) for path, kind in sorted(rows)]


def headings(text: str) -> list[str]:
    """Second-level headings outside fences, in lower case with single blanks."""
    open_text = re.sub(r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\Z)", "", text)
    return [" ".join(h.lower().split()) for h in re.findall(r"(?m)^##[ \t]+(\S.*)$", open_text)]


def sections(canon: str, target: str) -> list[tuple[str, str]]:
    """Sections of the template that the target lacks, and those that only it has; <<...>> matches anything."""
    wanted, there = headings(canon), headings(target)
    # as globs: each placeholder a star, and what globs give a meaning in brackets
    globs = {h: "*".join(re.sub(r"[*?[]", r"[\g<0>]", x) for x in re.split(r"<<.*?>>", h)) for h in wanted}
    lacking = [h for h in wanted if not fnmatch.filter(there, globs[h])]
    own = [h for h in there if h not in globs and h != "replaceable tokens"]
    return [*((f"section:{h}", "missing") for h in lacking), *((f"section:{h}", "added") for h in own)]


def divergences(matcher: str, canon: str, target: str) -> list[tuple[str, str]]:
    """What differs, under the matcher; a target that doesn't parse has changed as a whole."""
    if matcher == "exact":
        return [] if canon == target else [("", "changed")]
    if matcher == "text":
        return [] if normalised_text(canon) == normalised_text(target) else [("", "changed")]
    if matcher == "template":
        return sections(canon, target)
    if matcher == "json-subset":
        read = json.loads
    else:
        import yaml

        read = yaml.safe_load
    try:
        found = read(target)
    except Exception as e:  # a malformed document, in either parser's own error class
        if not isinstance(e, ValueError) and type(e).__module__.split(".")[0] != "yaml":
            raise
        return [("", "changed")]
    return subset(read(canon), found)


def drift(canon: list[dict], targets: DataFrame, files: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """target, path, matcher, state, divergences for every target and canonical file.

    ``canon`` lists path, matcher and content (a manifest, part of the configuration); ``targets`` has target,
    ``files`` target, path and content, ``deltas`` target, path and prefixes (array; null allows all)."""
    wanted = F.explode(F.array(*[F.struct(*[F.lit(c[k]).alias(k) for k in ("path", "matcher")], F.lit(c["content"]).alias("canon")) for c in canon]))
    pairs = targets.select("target").distinct().select("target", wanted.alias("c")).select("target", "c.*").join(files.select("target", "path", "content"), ["target", "path"], "left")

    def differ(batches):
        for b in batches:
            found = [None if t is None else [{"path": p, "kind": k} for p, k in divergences(m, c, t)] for m, c, t in zip(b["matcher"], b["canon"], b["content"], strict=True)]
            yield pd.DataFrame({"target": b["target"], "path": b["path"], "matcher": b["matcher"], "divergences": found})

    told = pairs.mapInPandas(differ, f"target string, path string, matcher string, divergences {DIVERGENCES}")
    if deltas is None:
        told = told.withColumn("prefixes", F.lit(None).cast("array<string>"))
    else:
        everything = F.coalesce("prefixes", F.array(F.lit("")))
        told = told.join(deltas.groupBy("target", "path").agg(F.flatten(F.collect_set(everything)).alias("prefixes")), ["target", "path"], "left")
    required = F.filter("divergences", lambda d: d["kind"] != "added")
    allowed = lambda d: F.exists("prefixes", lambda p: (p == "") | (d["path"] == p) | d["path"].startswith(F.concat(p, F.lit("."))))
    refused = F.filter(required, lambda d: ~F.coalesce(allowed(d), F.lit(False)))
    state = F.when(F.col("divergences").isNull(), "missing").when(F.size(refused) > 0, "drift").when(F.size(required) > 0, "allowed-delta").when(F.size("divergences") > 0, "extra").otherwise("match")
    shown = F.when(state == "drift", refused).when(state == "allowed-delta", required).when(state == "missing", F.array().cast(DIVERGENCES)).otherwise(F.col("divergences"))
    return told.select("target", "path", "matcher", state.alias("state"), shown.alias("divergences"))


def summary(states: DataFrame) -> DataFrame:
    """Files of each state, zeros included."""
    return states.groupBy("target").agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])
