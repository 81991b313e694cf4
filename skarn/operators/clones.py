"""Repeated token runs, by windows of k tokens and counting; occurrences are never paired."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions import windows as prefix
from skarn.operators.keyed import looked_up
from skarn.session import written

RUNS = "a bigint, h bigint, doc bigint, first int, last int, moves boolean, before bigint, after bigint"
WINDOWS = "doc bigint, start int, g1 bigint, g2 bigint, before bigint, after bigint"
ANCHOR_BITS = 40
SEGMENT_TOKENS = 1 << 18
BUCKETS, BUCKET_SEGMENTS = 32, 40_000
HEAVY_PARTS, HEAVY_ROWS = 1000, 5000  # an anchor of more than this part and number of all runs is heavy
COUNTS = ("occurrences", "documents", "left_contexts", "right_contexts")


def tokens(docs: DataFrame, key: str, group: str, words) -> DataFrame:
    """key, group, pos (from 0), token."""
    return docs.select(key, group, F.posexplode(words).alias("pos", "token"))


def segments(code: np.ndarray, offsets: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first and last window, anchor, moves): runs of neighbouring k-windows of the same anchor, the least hash of
    the shorter windows within.  Equal windows of equal groups have equal anchors, whatever stands around them; equal windows
    of one run have different places of it (``moves``)."""
    short = max(1, 3 * k // 10)
    n = len(code) - k + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64), np.zeros(0, bool))
    at = np.arange(len(code) - short + 1)
    hashes = prefix.PrefixHashes(code).windows(at, at + short)[0]
    least, place = hashes[:n].copy(), np.arange(n)
    for j in range(1, k - short + 1):
        less = hashes[j : j + n] < least
        least[less] = hashes[j : j + n][less]
        place[less] = np.flatnonzero(less) + j
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(at[:n] + k <= offsets[row[:n] + 1])
    new = np.ones(len(starts), bool)
    new[1:] = (row[starts[1:]] != row[starts[:-1]]) | (least[starts[1:]] != least[starts[:-1]])
    firsts = np.flatnonzero(new)
    first, last = starts[firsts], starts[np.append(firsts[1:], len(starts))[: len(firsts)] - 1]
    anchor = prefix.mixed(least[first].view(np.uint64) ^ prefix.mixed(group[row[first]].view(np.uint64)))
    return row[first], first, last, (anchor >> np.uint64(64 - ANCHOR_BITS)).astype(np.int64), place[first] != place[last]


def anchored_runs(texts: DataFrame, k: int) -> DataFrame:
    """RUNS of the texts (doc, scope, codes): what ``segments`` finds, with a hash of the run's tokens and the codes on either side."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, scopes = (np.asarray(batch.column(i)) for i in (0, 1))
            for top, n, offsets, code in prefix.parts(batch.column(2), SEGMENT_TOKENS):
                doc, scope = docs[top : top + n], scopes[top : top + n]
                row, first, last, anchor, moves = segments(code, offsets, scope, k)
                h = prefix.PrefixHashes(code).windows(first, last + k, scope[row])[0]
                columns = anchor, h, doc[row], *((x - offsets[row]).astype(np.int32) for x in (first, last)), moves, *prefix.sides(code, offsets, doc, row, first, last + k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [c.split()[0] for c in RUNS.split(", ")])

    return texts.select("doc", "scope", "codes").mapInArrow(each, RUNS)


def open_windows(texts: DataFrame, runs: DataFrame, k: int, source: str = "codes", codes: Column | None = None) -> DataFrame:
    """WINDOWS of the texts (doc, scope, ``source``): every k-window of those runs (doc, first, last).  ``codes`` are made of the
    source behind the shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, scopes = (np.asarray(batch.column(i)) for i in (0, 1))
            for top, n, offsets, code in prefix.parts(batch.column(2), SEGMENT_TOKENS):
                doc, scope, lists = docs[top : top + n], scopes[top : top + n], batch.column(3).slice(top, n)
                first, last = (np.asarray(x).astype(np.int64) for x in lists.flatten().flatten())
                size = last - first + 1
                row = np.repeat(np.repeat(np.arange(n), np.asarray(lists.value_lengths())), size)
                starts = offsets[row] + np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                hashes = prefix.PrefixHashes(code).windows(starts, starts + k, scope[row])
                columns = doc[row], (starts - offsets[row]).astype(np.int32), *hashes, *prefix.sides(code, offsets, doc, row, starts, starts + k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [c.split()[0] for c in WINDOWS.split(", ")])

    lists = runs.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    held = written(texts.select("doc", "scope", source).join(lists, "doc"), compression="zstd")  # once, as windows are counted and then met
    return held.select("doc", "scope", (F.col(source) if codes is None else codes).alias("codes"), "runs").mapInArrow(each, WINDOWS)


def contexts(docs: DataFrame, key: str, group: str, words: Column, k: int) -> DataFrame:
    """group, sha256 (of the words, joined by blanks), occurrences, documents, left_contexts and right_contexts of every
    gram of k words that occurs twice in a group; a text's edge is a context of its own (none where ``key`` is null).

    Grams travel as the runs of text that share an anchor, and only those whose anchor occurs again: anchors are counted
    first, as short hashes, which may keep too much and never too little.  Runs of one anchor are counted together; those of
    a heavy one are dealt by ``key``, and their contexts are united afterwards."""
    texts = docs.select(F.col(key).alias("_key"), F.col(group).alias("_group"), F.coalesce(words, F.array().cast("array<string>")).alias("_w"))
    texts = texts.where(F.size("_w") >= k).select("_key", "_group", "_w", F.array_join("_w", " ").alias("_t"))
    texts = texts.withColumn("_row", F.shiftrightunsigned(F.xxhash64("_key", "_group", "_t"), 64 - ANCHOR_BITS))
    number = F.xxhash64("_group").alias("_g")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, groups = (np.asarray(batch.column(i)) for i in (0, 1))
            for first, n, offsets, code in prefix.parts(batch.column(2), SEGMENT_TOKENS):
                row, _, _, anchor, moves = segments(code, offsets, groups[first : first + n], k)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(rows[first + row]), pa.array(1 + moves.astype(np.int32))], ["a", "_row", "n"])

    found = texts.select("_row", number, prefix.codes(F.col("_w"))).mapInArrow(anchors, "a bigint, _row bigint, n int")
    counts = written(found.groupBy("a").agg(F.sum("n").alias("n")).where("n > 1"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = [r.a for r in counts.where(F.col("n") > max(HEAVY_ROWS, total / HEAVY_PARTS)).select("a").collect()]
    wanted = found.select("a", "_row").join(counts.select("a"), "a", "left_semi").groupBy("_row").agg(F.collect_set("a").alias("_as"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.asarray(batch.column(2))
            for top, n, offsets, code in prefix.parts(batch.column(3), SEGMENT_TOKENS):
                part = batch.slice(top, n)
                row, first, last, anchor, _ = segments(code, offsets, groups[top : top + n], k)
                lists = part.column(5)
                owner = np.repeat(np.arange(n), np.asarray(lists.value_lengths()))
                pair = lambda r, a: (r.astype(np.uint64) << np.uint64(ANCHOR_BITS)) | a.astype(np.uint64)
                own = np.isin(pair(row, anchor), pair(owner, np.asarray(lists.flatten())))
                row, first, last, anchor = row[own], first[own], last[own], anchor[own]
                left, right = first > offsets[row], last + k < offsets[row + 1]
                texts = part.column(4).cast(pa.large_string())
                ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
                data = memoryview(texts.buffers()[2])[ends[0] : ends[-1]]
                ends = ends - ends[0]
                blank = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
                begins = np.sort(np.concatenate([ends[:-1], blank + 1]))  # of all words, then the end; no text is empty
                stops = np.sort(np.concatenate([ends[1:], blank]))
                a, b = begins[first - left], stops[last + k - 1 + right]
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array((first - offsets[row]).astype(np.int32)),
                    pa.array(left), pa.array(right), pa.array([bytes(data[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()).cast(pa.string()),
                ], ["a", "_key", "_group", "pos", "left", "right", "words"])

    kinds = dict(docs.select(F.col(key).alias("key"), F.col(group).alias("group")).dtypes)
    # codes are eight bytes a word, so they are made again behind the shuffle
    met = texts.drop("_w").join(wanted, "_row").select("_key", "_group", number, prefix.codes(F.split("_t", " ")).alias("_c"), "_t", "_as")
    runs = met.mapInArrow(cut, f"a bigint, _key {kinds['key']}, _group {kinds['group']}, pos int, left boolean, right boolean, words string")
    dealt = F.col("a").isin(heavy) if heavy else F.lit(False)
    buckets = max(BUCKETS, math.ceil(total / BUCKET_SEGMENTS))
    bucket = F.when(dealt, buckets + F.pmod(F.xxhash64("a", "_key"), F.lit(buckets))).otherwise(F.pmod(F.xxhash64("a"), F.lit(buckets)))
    dealt_out = runs.select("_key", "_group", "pos", "left", "right", "words", bucket.cast("int").alias("bucket")).groupBy("bucket")

    def counted(apart: bool) -> DataFrame:
        def of(table: pa.Table) -> pa.Table:
            here = table.column("bucket")[0].as_py() >= buckets
            return _counted(table if here == apart else table.slice(0, 0), k, apart)

        return dealt_out.applyInArrow(of, f"_group {kinds['group']}, sha256 string, kind int, context string, {', '.join(f'{c} bigint' for c in COUNTS)}")

    whole = counted(False).select("_group", "sha256", *COUNTS)
    if heavy:
        parts = counted(True).groupBy("_group", "sha256", "kind", "context").agg(*(F.sum(c).alias(c) for c in COUNTS[:2]))
        parts = parts.groupBy("_group", "sha256").agg(*(F.sum(c).alias(c) for c in COUNTS[:2]), F.count_if(F.col("kind") == 2).alias(COUNTS[2]), F.count_if(F.col("kind") == 3).alias(COUNTS[3]))
        whole = whole.unionByName(parts.where("occurrences > 1"))
    return whole.withColumnRenamed("_group", group)


def _counted(table: pa.Table, k: int, apart: bool) -> pa.Table:
    """Kind 0: a gram with its counts.  ``apart``, as other tasks may have it too: its occurrences and documents here (1), and each
    context (2, 3)."""
    if not table.num_rows:
        kinds = [("_group", table.schema.field("_group").type), ("sha256", pa.string()), ("kind", pa.int32()), ("context", pa.string()), *((c, pa.int64()) for c in COUNTS)]
        return pa.schema(kinds).empty_table()
    runs = table.column("words").combine_chunks().cast(pa.large_string())
    split = pc.split_pattern(runs, " ")
    offsets = np.concatenate(([0], np.cumsum(np.asarray(split.value_lengths(), dtype=np.int64))))
    flat = split.flatten()
    names = flat.dictionary_encode()
    code = np.asarray(names.indices).astype(np.int64)
    ids = [table.column(c).combine_chunks().dictionary_encode() for c in ("_key", "_group")]
    key, group = (np.asarray(x.indices.fill_null(-1)).astype(np.int64) for x in ids)
    left, right = (table.column(c).to_numpy().astype(bool) for c in ("left", "right"))
    grams = np.diff(offsets) - left - right - k + 1
    run = np.repeat(np.arange(len(grams)), grams)
    within = np.arange(len(run)) - np.repeat(np.cumsum(grams) - grams, grams)
    starts = (offsets[:-1] + left)[run] + within
    key, pos = key[run], table.column("pos").to_numpy().astype(np.int64)[run] + within
    edge = np.where(key < 0, -1, -2 - (key * (1 << 31) + pos))
    no_left, no_right = (within == 0) & ~left[run], (within == grams[run] - 1) & ~right[run]
    padded = np.append(code, 0)
    sides = [np.where(no_left, edge, padded[starts - 1]), np.where(no_right, edge, padded[starts + k])]
    h1, h2 = prefix.PrefixHashes(code.view(np.uint64)).windows(starts, starts + k, group[run] << 32)
    by = np.lexsort((h2, h1))
    new = np.ones(len(by), bool)
    new[1:] = (h1[by[1:]] != h1[by[:-1]]) | (h2[by[1:]] != h2[by[:-1]])
    gram = np.empty(len(by), np.int64)
    gram[by] = np.cumsum(new) - 1
    some = by[new]  # an occurrence of each gram
    n = np.bincount(gram, minlength=len(some))

    def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram, value, of each pair one row)"""
        at = np.lexsort((values, gram))
        first = np.ones(len(at), bool)
        first[1:] = (gram[at[1:]] != gram[at[:-1]]) | (values[at[1:]] != values[at[:-1]])
        at = at[first & (values[at] != -1)]
        return gram[at], values[at], at

    kept = np.flatnonzero(n > 1 - apart)
    found = [distinct(x) for x in (key, *sides)]
    documents, lefts, rights = (np.bincount(g, minlength=len(some)) for g, _, _ in found)
    at, lengths = np.frombuffer(runs.buffers()[1], np.int64)[runs.offset :], np.asarray(pc.binary_length(flat), dtype=np.int64)
    ends = np.concatenate(([0], np.cumsum(lengths + 1)))  # each word with the blank after it
    begin, r = starts[some], run[some]
    a = at[r] + ends[begin] - ends[offsets[r]]
    b = a + ends[begin + k] - ends[begin] - 1
    data = memoryview(runs.buffers()[2])
    digests = np.full(len(some), None, object)
    digests[kept] = [hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(a[kept].tolist(), b[kept].tolist(), strict=True)]
    rows = [(kept, np.full(len(kept), int(apart)), [None] * len(kept), n[kept], documents[kept], lefts[kept], rights[kept])]
    for kind, (g, value, where) in zip((2, 3), found[1:] if apart else (), strict=False):
        words = names.dictionary.take(pa.array(np.maximum(value, 0))).to_pylist()
        keys = table.column("_key").take(pa.array(run[where])).to_pylist()
        said = [f"\n{d}:{p}" if v < 0 else w for v, w, d, p in zip(value.tolist(), words, keys, pos[where].tolist(), strict=True)]
        rows.append((g, np.full(len(g), kind), said, *[np.zeros(len(g), np.int64)] * 4))
    g, kind, *counts = (np.concatenate([x[i] for x in rows]) for i in (0, 1, 3, 4, 5, 6))
    return pa.table({
        "_group": table.column("_group").combine_chunks().take(pa.array(run[some[g]])), "sha256": pa.array(digests[g], pa.string()),
        "kind": pa.array(kind.astype(np.int32)), "context": pa.array([c for x in rows for c in x[2]], pa.string()), **{c: pa.array(x.astype(np.int64)) for c, x in zip(COUNTS, counts, strict=True)},
    })


def repeated_spans(docs: DataFrame, key: str, group: str, words: Column, k: int) -> DataFrame:
    """key, group, start, end (tokens, end exclusive): maximal runs whose every k-window is repeated in its group (null is a
    group, too).

    Equal windows lie in runs of equal anchors.  Where all runs of an anchor are equal, as within copies, all their windows are
    repeated; only where they differ are windows counted.  Counts come from aggregates that combine before the shuffle, and are
    joined back by keys whose heavy ones are broadcast, so what very many texts share doesn't gather in one task."""
    texts = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(key).alias("_key"), F.col(group).alias("_group"), F.xxhash64(group).alias("scope"), words.alias("_w"))
    texts = written(texts.where(F.size("_w") >= k).withColumn("_t", F.array_join("_w", " ")).drop("_w"), compression="zstd")
    codes = prefix.codes(F.split("_t", " "))  # eight bytes a word, so they are made where they are used
    found = anchored_runs(texts.select("doc", "scope", codes.alias("codes")), k)
    counted = found.groupBy("a").agg(F.count("*").alias("n"), F.max("moves").alias("moves"), (F.min("h") != F.max("h")).alias("differ"))
    counted = written(counted.where("n > 1 OR moves").select("a", "n", F.expr("n = 1 OR differ").alias("open")))
    met = written(looked_up(found.select("a", "doc", "first", "last"), counted, ["a"], "n").select("doc", "first", "last", "open"))
    grams = open_windows(texts, met.where("open"), k, "_t", codes).select("doc", F.col("start").alias("first"), "g1", "g2")
    twice = written(grams.groupBy("g1", "g2").agg(F.count("*").alias("n")).where("n > 1"))
    hits = looked_up(grams, twice, ["g1", "g2"], "n").select("doc", "first", F.lit(1).alias("n"))
    hits = hits.unionByName(met.where("NOT open").select("doc", "first", (F.col("last") - F.col("first") + 1).alias("n")))
    spans = _joined(hits, ["doc"]).join(texts.select("doc", "_key", "_group"), "doc")
    # A key may have several texts: their windows are numbered together, one by one where they overlap.
    by_key = Window.partitionBy("_key")
    earlier = by_key.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_over", F.max(F.col("first") + F.col("n")).over(earlier) > F.col("first")).withColumn("_over", F.coalesce(F.max("_over").over(by_key), F.lit(False)))
    each = F.when(F.col("_over"), F.sequence("first", F.col("first") + F.col("n") - 1)).otherwise(F.array("first"))
    spans = spans.select("_key", "_group", F.explode(each).alias("first"), F.when(F.col("_over"), 1).otherwise(F.col("n")).alias("n"))
    spans = spans.withColumn("_i", F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    spans = spans.groupBy("_key", "_group", "_i").agg(F.min("first").alias("start"), (F.max(F.col("first") + F.col("n")) + k - 1).alias("end"))
    return spans.select(F.col("_key").alias(key), F.col("_group").alias(group), "start", "end")


def _joined(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first, n: disjoint spans of ``n`` from ``first``, those that touch as one."""
    earlier = Window.partitionBy(*keys).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    islands = spans.withColumn("_i", F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return islands.groupBy(*keys, "_i").agg(F.min("first").alias("first"), F.sum("n").cast("int").alias("n")).drop("_i")
