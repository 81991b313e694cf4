"""Syntax facts of source files as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.sources import typescript

SYNTAX = (
    "repo string, source_set string, package_path string, path string, total_lines int, comment_only int, signatures int, problems array<string>, code_lines array<int>, "
    "functions array<struct<kind:string,name:string,origin:string,start_line:int,end_line:int,depth:int,parent:int,overloads:int,cc:int,nesting:int,sloc:int>>, "
    "imports array<struct<kind:string,type_only:boolean,specifier:string,line:int>>, kinds array<string>, start_lines array<int>, end_lines array<int>"
)
_COLUMNS = "repo source_set package_path path total_lines comment_only signatures problems code_lines functions imports kinds start_lines end_lines".split()
_FUNCTION = ("kind", "name", "origin", "start_line", "end_line", "depth", "parent", "overloads", "cc", "nesting", "sloc")


def syntax(files: DataFrame) -> DataFrame:
    """One row per file (repo, source_set, package_path, path, text): what the front-end reads from it.  A
    null text is empty; a file that couldn't be read or doesn't parse lists its problems."""
    wanted = files.select("repo", "source_set", "package_path", "path", "text", F.col("read_error") if "read_error" in files.columns else F.lit(None).cast("string").alias("read_error"))

    def parse(batches):
        for batch in batches:
            rows = []
            for repo, group, package, path, text, error in batch.itertuples(index=False):
                facts = typescript.analyse(text)
                tokens = facts["tokens"]
                rows.append((
                    repo, group, package, path, facts["total_lines"], facts["comment_only"], facts["signatures"], facts["problems"] + ([f"read-error: {error}"] if isinstance(error, str) else []), facts["code_lines"],
                    [{k: f[k] for k in _FUNCTION} for f in facts["functions"]], facts["imports"], [t[0] for t in tokens], [t[1] for t in tokens], [t[2] for t in tokens],
                ))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return wanted.mapInPandas(parse, SYNTAX)


def functions(parsed: DataFrame) -> DataFrame:
    """One row per function, with its place in the file (``fn``)."""
    return parsed.select("repo", "source_set", "package_path", "path", F.posexplode("functions").alias("fn", "f")).select("repo", "source_set", "package_path", "path", "fn", "f.*")


def imports(parsed: DataFrame) -> DataFrame:
    """One row per import site; ``seq`` orders them within a file."""
    return parsed.select("repo", "path", F.posexplode("imports").alias("seq", "i")).select("repo", "path", "seq", "i.*")


def identities(fns: DataFrame) -> DataFrame:
    """Adds ``identity`` (the path of names down to the function) and ``ambiguous``: two siblings of the same
    kind and name, or an anonymous or ambiguous ancestor, make it no identity."""
    siblings = fns.groupBy("repo", "path", "parent", "kind", "name").agg(F.count("*").alias("n"))
    same = lambda c: fns[c].eqNullSafe(siblings[c])
    own = fns.join(siblings, same("repo") & same("path") & same("parent") & same("kind") & same("name")).select(fns["*"], ((F.col("n") > 1) | (fns["origin"] == "anonymous")).alias("own"))
    # a file's functions meet in one row; a file is one row of the input as well
    filed = own.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct("fn", "parent", "name", "own"))).alias("all"))
    blank = F.array().cast("array<struct<fn:int,identity:string,bad:boolean>>")
    step = lambda acc, f: F.concat(acc, F.array(F.struct(f["fn"].alias("fn"), F.concat(F.when(f["parent"].isNull(), F.lit("")).otherwise(F.concat(F.get(acc, f["parent"])["identity"], F.lit("/"))), f["name"]).alias("identity"), (f["own"] | F.coalesce(F.get(acc, f["parent"])["bad"], F.lit(False))).alias("bad"))))
    named = filed.select("repo", "path", F.explode(F.aggregate("all", blank, step)).alias("x")).select("repo", "path", F.col("x.fn").alias("fn"), F.col("x.identity").alias("identity"), F.col("x.bad").alias("ambiguous"))
    return fns.join(named, ["repo", "path", "fn"])
