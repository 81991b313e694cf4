"""Maximal repeated token runs as groups of equal content, exact, within each (repo, source_set).

A run belongs to a group if another occurrence of the same tokens differs on both sides (a file's edge differs
from everything).  No scope, file set or group is held by one task, and there is no bound on their sizes.

* **Anchors.**  A group's occurrences don't all have the same token before them, so neither do those of its first ``n``
  tokens, for any ``n``: a run starts at an anchor, a position whose window of ``n`` tokens is repeated after different tokens;
  and ends at one whose window before it is followed by different tokens.  Within a copied passage there are few.
* **Levels.**  Anchors of windows of ``least`` tokens come from counting: whole runs where copies agree, windows elsewhere.  Each further level takes
  windows ``FACTOR`` times as long at the anchors that are left; runs of lengths between two levels are pairs of a first and a
  last anchor.  So the number of rounds is logarithmic in the longest file, and most files drop out early.
* **Contents.**  Runs meet by their hash (two prefix look-ups, see ``functions.windows``).  All occurrences of a group have
  anchors, so they all meet.  A text's occurrences between the same sides go as one row, so repeated lines add few rows.
* **Both sides differ.**  One occurrence's sides (l, r) serve as witness for all that differ from both.  For the others
  the least and largest right side among those of another left side decide, and conversely; these come from
  aggregates that combine before the shuffle.

Within a file of one short period the pairs of anchors are quadratic in that file's length, never in the table's; they are made
and collapsed in pieces of PAIRS."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions import windows
from skarn.operators import clones
from skarn.operators.keyed import looked_up, numbered
from skarn.session import written

# The least run.
MIN_TOKENS, MIN_LINES = 100, 3
FACTOR = 2  # pairs of anchors grow with its square, rounds with the inverse of its logarithm
PAIRS = 1 << 20
RUN, FIRST, LAST = 0, 1, 2  # kinds of PLACES

PLACES = "kind tinyint, doc bigint, starts array<int>, length int, g1 bigint, g2 bigint, before bigint, after bigint"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _places(kind: np.ndarray, doc: np.ndarray, starts: np.ndarray, length: np.ndarray, *facts: np.ndarray) -> pa.RecordBatch:
    """PLACES: one row for all places of a text that have the same tokens between the same sides."""
    order = np.lexsort((starts, length, kind, *facts, doc))
    keys = [x[order] for x in (kind, doc, length, *facts)]
    firsts = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in keys], axis=0))))
    kinds, docs, lengths, *rest = (x[firsts] for x in keys)
    lists = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(order)), pa.int32()), pa.array(starts[order].astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(docs), lists, pa.array(lengths.astype(np.int32)), *map(pa.array, rest)], _names(PLACES))


def _pairs(first: np.ndarray, last: np.ndarray, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of all runs of ``least`` to below ``most`` tokens, in pieces of about PAIRS."""
    low, high = np.searchsorted(last, first + least), np.searchsorted(last, first + most)
    total = np.cumsum(high - low)
    block = total // PAIRS
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(first)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        n = high[a:b] - low[a:b]
        if n.sum():
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(first[a:b], n), last[np.repeat(low[a:b], n) + within]


def anchored_windows(texts: DataFrame, length: int) -> DataFrame:
    """PLACES of the texts (doc, scope, codes, first, last): runs of ``length`` to below FACTOR times as many tokens
    between anchors (RUN), and windows of FACTOR times as many from the first (FIRST) and before the last anchors (LAST)."""
    longer = FACTOR * length

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, scopes = (np.asarray(batch.column(i)) for i in (0, 1))
            for top, n, offsets, code in windows.parts(batch.column(2)):
                hashes = windows.PrefixHashes(code)
                waiting, size = [], 0
                for row in range(n):
                    begin, stop = offsets[row], offsets[row + 1]
                    first, last = (np.sort(np.asarray(batch.column(i)[top + row].values, dtype=np.int64)) + begin for i in (3, 4))
                    ahead, back = first[first + longer <= stop], last[last - longer >= begin]
                    found = [(RUN, a, b) for a, b in _pairs(first, last, length, longer)] + [(FIRST, ahead, ahead + longer), (LAST, back - longer, back)]
                    for kind, a, b in found:
                        if len(a):
                            waiting.append((np.full(len(a), kind, np.int8), np.full(len(a), row), a, b))
                            size += len(a)
                        if size >= PAIRS:
                            yield whole(waiting, top, offsets, code, hashes, docs, scopes)
                            waiting, size = [], 0
                if size:
                    yield whole(waiting, top, offsets, code, hashes, docs, scopes)

    def whole(waiting, top, offsets, code, hashes, docs, scopes) -> pa.RecordBatch:
        kinds, row, starts, ends = (np.concatenate(x) for x in zip(*waiting, strict=True))
        doc, scope = (x[top : top + len(offsets) - 1] for x in (docs, scopes))
        return _places(kinds, doc[row], starts - offsets[row], ends - starts, *hashes.windows(starts, ends, scope[row]), *windows.sides(code, offsets, doc, row, starts, ends))

    return texts.select("doc", "scope", "codes", "first", "last").mapInArrow(each, PLACES)


def _varied(found: DataFrame, key: list[str]) -> DataFrame:
    """The windows of ``found`` whose tokens occur after different tokens (``starts``) or before different ones (``ends``)."""
    differ = lambda c: F.min(c) != F.max(c)
    counted = found.groupBy(*key).agg(F.count("*").alias("n"), differ("before").alias("starts_vary"), differ("after").alias("ends_vary"))
    return looked_up(found, written(counted.where("starts_vary OR ends_vary")), key, "n")


def _anchors(windows_: DataFrame, first: Column, last: Column) -> DataFrame:
    """(doc, first, last): arrays of positions by text, where there are both."""
    marks = windows_.groupBy("doc").agg(F.flatten(F.collect_list(first)).alias("first"), F.flatten(F.collect_list(last)).alias("last"))
    return marks.where((F.size("first") > 0) & (F.size("last") > 0))


def varied_windows(texts: DataFrame, length: int) -> DataFrame:
    """(doc, first, last, starts_vary, ends_vary): the first window that occurs after different tokens and the last that occurs
    before different ones, of runs of windows of ``length`` tokens.

    Equal windows lie in runs of equal anchors (``clones.segments``).  Where all runs of an anchor are equal and hold no window
    twice, only a run's first window can come after different tokens and only its last one before; the others' windows are
    counted one by one."""
    found = clones.anchored_runs(texts, length)
    differ = lambda c: F.min(c) != F.max(c)
    counted = found.groupBy("a").agg(F.count("*").alias("n"), (differ("h") | F.max("moves")).alias("open"), differ("before").alias("starts_vary"), differ("after").alias("ends_vary"))
    counted = written(counted.where("open OR starts_vary OR ends_vary"))
    met = written(looked_up(found.select("a", "doc", "first", "last"), counted, ["a"], "n").drop("a", "n"))
    single = _varied(clones.open_windows(texts, met.where("open"), length), ["g1", "g2"])
    columns = ["doc", "first", "last", "starts_vary", "ends_vary"]
    return met.where("NOT open").select(*columns).unionByName(single.withColumns({"first": F.col("start"), "last": F.col("start")}).select(*columns))


def candidate_runs(texts: DataFrame, least: int) -> DataFrame:
    """PLACES of runs between anchors, of all levels: all occurrences of every maximal repeat."""
    c, length = F.col, least
    marks = _anchors(varied_windows(texts, least), F.when(c("starts_vary"), F.array("first")), F.when(c("ends_vary"), F.array(c("last") + least)))
    here = written(texts.join(marks, "doc"))
    levels = []
    while True:
        found = written(anchored_windows(here, length))
        levels.append(found.where(c("kind") == RUN).drop("kind"))
        length *= FACTOR
        longer = _varied(found.where(c("kind") != RUN), ["kind", "g1", "g2"])
        first = F.when(c("starts_vary") & (c("kind") == FIRST), c("starts"))
        last = F.when(c("ends_vary") & (c("kind") == LAST), F.transform("starts", lambda x: x + c("length")))
        here = written(here.drop("first", "last").where(F.size("codes") >= length).join(_anchors(longer, first, last), "doc"))
        if here.isEmpty():
            break
    runs = levels[0]
    for level in levels[1:]:
        runs = runs.unionByName(level)
    return runs


def maximal_repeats(texts: DataFrame, least: int = MIN_TOKENS) -> DataFrame:
    """(g1, g2, doc, start, end) of every occurrence that another of the same tokens differs from on both sides."""
    c, key = F.col, ["g1", "g2"]
    runs = candidate_runs(texts, least)
    one = F.min(F.struct("before", "after"))
    counted = runs.groupBy(*key).agg(F.count("*").alias("n"), one.alias("one"), F.min("before").alias("b1"), F.max("before").alias("b2"), F.min("after").alias("a1"), F.max("after").alias("a2"))
    met = written(looked_up(runs, written(counted.where("b1 <> b2 AND a1 <> a2").select(*key, "n", "one")), key, "n"))
    elsewhere, onward = c("before") != c("one.before"), c("after") != c("one.after")
    sides = met.groupBy(*key).agg(
        F.count("*").alias("n"), F.min(F.when(elsewhere, c("after"))).alias("a1"), F.max(F.when(elsewhere, c("after"))).alias("a2"),
        F.min(F.when(onward, c("before"))).alias("b1"), F.max(F.when(onward, c("before"))).alias("b2"),
    )
    varied = F.when(elsewhere & onward, True).when(~elsewhere & ((c("a1") != c("after")) | (c("a2") != c("after"))), True).when(~onward & ((c("b1") != c("before")) | (c("b2") != c("before"))), True)
    kept = looked_up(met.drop("n"), written(sides), key, "n").where(varied)
    return kept.select(*key, "doc", "length", F.explode("starts").alias("start")).select(*key, "doc", "start", (c("start") + c("length")).alias("end"))


def clone_members(parsed: DataFrame, least: int = MIN_TOKENS, min_lines: int = MIN_LINES) -> DataFrame:
    """repo, source_set, group_id, path, start_line, end_line, token_count, start_token of all groups of the files (repo,
    source_set, path, kinds, start_lines, end_lines).

    Members of under ``min_lines`` lines don't count; groups of one member, and those whose every member lies strictly within another
    group's in its file, go.  Groups are numbered within (repo, source_set) by their first member."""
    c, scope = F.col, ["repo", "source_set"]
    files = parsed.select(*scope, "path", "start_lines", "end_lines", F.monotonically_increasing_id().alias("doc"), F.xxhash64(*scope).alias("scope"), windows.codes(c("kinds")).alias("codes"))
    files = written(files)
    members = written(maximal_repeats(files.select("doc", "scope", "codes"), least))
    by_file = members.groupBy("doc").agg(F.collect_list(F.struct("g1", "g2", "start", "end")).alias("runs"))
    lines = lambda name, at: F.element_at(name, at)
    located = files.drop("codes", "scope").join(by_file, "doc").withColumn("run", F.explode("runs"))
    located = located.select(*scope, "path", "doc", "run.*", lines("start_lines", c("run.start") + 1).alias("start_line"), lines("end_lines", c("run.end")).alias("end_line"))
    located = written(located.where(c("end_line") - c("start_line") + 1 >= min_lines))
    group = ["g1", "g2"]
    first = F.min(F.struct("path", "start_line", "end_line", "start"))
    length = F.first(c("end") - c("start")).alias("token_count")
    groups = written(located.groupBy(*scope, *group).agg(F.count("*").alias("n"), first.alias("f"), length).where("n > 1"))
    kept = written(looked_up(located, groups.select(*group, "n"), group, "n"))
    earlier = Window.partitionBy("doc").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = kept.withColumn("reach", F.max("end").over(earlier)).where("reach IS NULL OR reach < end").select(*group).distinct()
    ordered = groups.join(outer, group, "left_semi").select(*scope, *group, "n", "token_count", "f.*").withColumn("by_length", -c("token_count")).withColumn("by_size", -c("n"))
    ids = written(numbered(ordered, scope, ["path", "start_line", "end_line", "by_length", "by_size", "start"], "group_id").select(*group, "n", "token_count", (c("group_id") + 1).cast("int").alias("group_id")))
    found = looked_up(kept.drop("n"), ids, group, "n")
    return found.select(*scope, "group_id", "path", "start_line", "end_line", "token_count", c("start").alias("start_token"))


def duplicated_lines(members: DataFrame, parsed: DataFrame) -> DataFrame:
    """repo, source_set, duplicated: code lines that any member covers, each once."""
    covered = members.select("repo", "source_set", "path", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    code = parsed.select("repo", "source_set", "path", F.explode("code_lines").alias("line"))
    return covered.join(code, ["repo", "source_set", "path", "line"]).groupBy("repo", "source_set").agg(F.count("*").alias("duplicated"))
