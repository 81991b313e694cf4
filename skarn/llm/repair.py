"""Least-cost repair of damaged conversations by a dynamic programme that shares prefixes.

A conversation's turns become one letter each (role initial and first fault); these signatures, not
the texts, decide the repair.  Different signatures are range partitioned and sorted, so each task
walks a prefix trie branch by branch: a node's layer of the dynamic programme is computed once for
all signatures below it, and each terminal node emits its answer by backtracking.

Faults of a turn, the first counts: blank (no character but white space ``[\\x20\\x09-\\x0D]``),
duplicate (role and text seen earlier in the conversation), truncated (last such character is not
``.``, ``!`` or ``?``).  Edits: Keep (0), Rerole to user or assistant (3), Delete (4; blank and
duplicate turns must go), Insert an empty user or assistant turn (3); a truncated turn that stays
adds 3.  Role initials must come to ``(s?(ua)+)?``.  Of the cheapest edits those whose initials
(K, R, D, I) are least in ASCII order win.

A layer keeps, for each of four states, the cost and a rank: after n turns no two edit strings (each
ends with the edit of turn n) are prefixes of one another, so their order is that of the previous
ranks, then of what was added, and holds whatever follows.  Costs and one byte a state suffice: 36
bytes a turn of the present branch.

Every turn is shuffled by conversation twice: to order it (windows that stream and sort on disk),
and with the answer, to write it out.  A conversation's own turns pass one task, batch by batch, as
its digest is sequential; that task holds a byte a turn.

Defined cases: null roles and texts are one space; turns without a number come first; turns of one number are
ordered by role and text; turns without a conversation are a conversation of their own; an empty
role, or one of any other initial, can't be kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.jaccard import heavy_keys, looked_up
from skarn.llm.text import checkpointed

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
# States: nothing written, system turn written, user turn written (needs an assistant), pair complete.
START, SYSTEM, USER, PAIR = range(4)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, PAIR: USER}, "a": {USER: PAIR}, "x": {}}
BY_INSERTS = {START: {START: 0, USER: 1, PAIR: 2}, SYSTEM: {SYSTEM: 0, USER: 1, PAIR: 2}, USER: {USER: 0, PAIR: 1}, PAIR: {PAIR: 0, USER: 1}}
ENDINGS = {START: 0, SYSTEM: 2, USER: 1, PAIR: 0}
GONE = "d"
FAR = 1 << 60
ADDED = [i * "I" + e for i in range(3) for e in "DKR"]


def steps(letter: str) -> list[list[tuple[int, int, int]]]:
    """For each state after a turn: the ways to it as (state before, cost, index of what is added)."""
    ways: dict[tuple[int, int], tuple[int, str]] = {}
    extra = TRUNCATED if letter.isupper() else 0
    for before, inserts in BY_INSERTS.items():
        for middle, n in inserts.items():
            options = [(middle, DELETE, "D")]
            if letter != GONE:
                options += [(AFTER[letter.lower()][middle], extra, "K")] if middle in AFTER[letter.lower()] else []
                options += [(after[middle], REROLE + extra, "R") for r, after in AFTER.items() if r in "ua" and middle in after]
            for state, cost, edit in options:
                way = n * INSERT + cost, n * "I" + edit
                ways[state, before] = min(way, ways.get((state, before), (FAR, "")))
    return [[(before, cost, ADDED.index(added)) for (s, before), (cost, added) in sorted(ways.items()) if s == state] for state in range(4)]


STEPS = {letter: steps(letter) for letter in "suaxSUAX" + GONE}


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return n if a[:n] == b[:n] else bisect_left(range(n), True, key=lambda i: a[: i + 1] != b[: i + 1])


class Branch:
    """The present branch of the trie: four costs and four bytes (state before, what was added, rank) a node."""

    def __init__(self) -> None:
        self.signature = ""
        self.costs = array("q", [0, FAR, FAR, FAR])
        self.ways = bytearray(4)

    def descend(self, signature: str) -> None:
        """Goes back to the last node shared with ``signature`` and computes the layers below it."""
        keep = shared_prefix(self.signature, signature)
        costs, ways = self.costs, self.ways
        del costs[4 * keep + 4 :], ways[4 * keep + 4 :]
        for at in range(4 * keep, 4 * len(signature), 4):
            found = []
            for state, options in enumerate(STEPS[signature[at // 4]]):
                found.append(min(((costs[at + p] + c, ways[at + p] >> 6, ADDED[add], p, add) for p, c, add in options), default=(FAR, 0, "", 0, 0)))
            order = sorted(range(4), key=lambda q: found[q][1:3])
            for state, (cost, _, _, before, add) in enumerate(found):
                costs.append(min(cost, FAR))
                ways.append(before | add << 2 | order.index(state) << 6)
        self.signature = signature

    def answer(self) -> tuple[str, int]:
        """(initials of the cheapest edits, cost) at the node of the signature."""
        at = 4 * len(self.signature)
        cost, _, state = min((self.costs[at + s] + n * INSERT, self.ways[at + s] >> 6, s) for s, n in ENDINGS.items())
        edits = [ENDINGS[state] * "I"]
        while at:
            way = self.ways[at + state]
            edits.append(ADDED[way >> 2 & 15])
            state, at = way & 3, at - 4
        return "".join(reversed(edits)), cost


def answers(signatures: DataFrame) -> DataFrame:
    """(signature, audit, cost) of different signatures."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branch = Branch()
        for batch in batches:
            these = batch.column(0).to_pylist()
            found = []
            for s in these:
                branch.descend(s)
                found.append(branch.answer())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64())], ["signature", "audit", "cost"])

    ordered = signatures.repartitionByRange("signature").sortWithinPartitions("signature")
    return ordered.mapInArrow(walk, "signature string, audit string, cost bigint")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults that the crc32 of ``conv_id:turn`` deals out."""
    c = F.col
    filled = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    conversation, turn = (F.coalesce(c(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn"))
    dealt = filled.withColumn("fault", F.crc32(F.concat(conversation, F.lit(":"), turn)) % 20)
    text = F.when(c("fault") == 1, "").when(c("fault") == 2, F.translate("text", ".!?", "")).otherwise(c("text"))
    copies = F.when(c("fault") == 0, 0).when(c("fault") == 3, 2).otherwise(1)
    return dealt.select("conv_id", "turn", F.when(c("fault") == 4, "user").otherwise(c("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Rows by conversation in their order: position from 1, letter, and flags of the faults."""
    c = F.col
    rows = turns.select(c("conv_id").cast("bigint").alias("conv_id"), c("turn").cast("bigint").alias("turn"), *(F.coalesce(c(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")))
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "seen")
    initial = F.substring("role", 1, 1)
    end = F.substring(F.rtrim(c("text"), F.lit(SPACES)), -1, 1)
    blank, duplicate = end == "", c("seen") > 1
    truncated = ~end.isin(".", "!", "?")
    first = F.when(blank, "blank").when(duplicate, "duplicate").when(truncated, "truncated")
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(c("fault").isin("blank", "duplicate"), GONE).when(c("fault") == "truncated", F.upper(known)).otherwise(known)
    pair = F.concat(F.lag(initial).over(place), initial)
    rows = rows.repartition("conv_id").withColumn("seen", seen).withColumn("position", F.row_number().over(place))
    rows = rows.withColumn("illegal", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))).withColumn("fresh", c("turn").isNotNull() & ~F.lag("turn").over(place).eqNullSafe(c("turn")))
    return checkpointed(rows.withColumn("fault", first).withColumn("letter", letter))


SUMS = ["blank", "duplicate", "truncated", "illegal", "fresh"]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's stretches of one conversation: letters joined, flags added up, outermost turns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, position, turn, letters, fault = batch.columns[:5]
        plain = np.asarray(ids.fill_null(0))
        none = np.asarray(ids.is_null())
        cuts = np.flatnonzero(np.concatenate(([True], (np.diff(plain) != 0) | (none[1:] != none[:-1]))))
        ends = [*cuts[1:].tolist(), batch.num_rows]
        joined = "".join(letters.to_pylist())
        faults = np.array(fault.fill_null("").to_pylist(), dtype=object)
        flags = [faults == name for name in SUMS[:3]] + [np.asarray(batch.column(i)) for i in (5, 6)]
        turns = turn.to_pylist()
        known = [[t for t in turns[a:b] if t is not None] for a, b in zip(cuts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(cuts)), position.take(pa.array(cuts)), pa.array([joined[a:b] for a, b in zip(cuts, ends, strict=True)], pa.string())]
            + [pa.array([min(k, default=None) for k in known], pa.int64()), pa.array([max(k, default=None) for k in known], pa.int64())]
            + [pa.array(np.add.reduceat(f.astype(np.int64), cuts)) for f in flags],
            ["conv_id", "position", "letters", "first", "last", *SUMS],
        )


def conversations(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each conversation of ``ids``: signature, gaps and faults."""
    columns = ["conv_id", "position", "turn", "letter", "fault", "illegal", "fresh"]
    schema = "conv_id bigint, position int, letters string, first bigint, last bigint, " + ", ".join(f"{s} bigint" for s in SUMS)
    found = rows.sortWithinPartitions("conv_id", "position").select(*columns).mapInArrow(pieces, schema)
    none = ids.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.lit(0).alias("position"), F.lit("").alias("letters"), *(F.lit(None).cast("bigint").alias(x) for x in ("first", "last")), *(F.lit(0).cast("bigint").alias(s) for s in SUMS))
    whole = found.unionByName(none.distinct()).groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "letters"))), lambda p: p["letters"]), "").alias("signature"),
        F.coalesce(F.max("last") - F.min("first") + 1 - F.sum("fresh"), F.lit(0)).alias("gaps"),
        *(F.sum(s).alias(s) for s in SUMS[:4]),
    )
    return checkpointed(whole)


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str, str]]]]:
    """(conversation, (edit, role, text) of every turn that is written) in a stream of rows (conv_id, role, text,
    audit) whose first row of each conversation has its audit."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    stream = rows()
    row = next(stream, None)
    while row is not None:
        conversation, audit = row[0], row[3]

        def turns() -> Iterator[tuple[str, str, str]]:
            state = START
            for edit in audit:  # noqa: B023
                if edit == "I":
                    role, text = "assistant" if state == USER else "user", ""
                else:
                    _, role, text, _ = next(stream)
                    if edit == "D":
                        continue
                    if edit == "R":
                        role = "assistant" if state == USER else "user"
                state = AFTER[role[:1]][state]
                yield edit, role, text

        yield conversation, turns()
        row = next(stream, None)


def _with_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    first = audits.select("conv_id", F.lit(0).alias("position"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    both = rows.select("conv_id", "position", "role", "text", F.lit(None).cast("string").alias("audit")).unionByName(first)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "role", "text", "audit")


def audited(turns: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ordered rows; conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation of
    ``turns``, and of ``ids`` where given)."""
    rows = ordered_turns(turns)
    whole = conversations(rows, turns if ids is None else ids)
    found = checkpointed(answers(whole.select("signature").distinct()))
    met = looked_up(whole, found, ["signature"], heavy_keys(whole, "signature"))
    return rows, checkpointed(met.select("conv_id", "gaps", *SUMS[:4], "cost", "audit"))


def _batches(rows: Iterator[tuple], types: dict[str, pa.DataType], size: int) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), types.values(), strict=True)], list(types))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position from 0, edit (K, R or I), role, text."""
    rows, audits = audited(turns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = ((conversation, n, *turn) for conversation, written in edited(batches) for n, turn in enumerate(written))
        types = {"conv_id": pa.int64(), "position": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}
        yield from _batches(turns, types, 512)

    return _with_audits(rows, audits).mapInArrow(write, "conv_id bigint, position bigint, edit string, role string, text string")


def repair_digests(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The audit of every conversation with the sha256 of its repaired ``role:text`` lines."""
    rows, audits = audited(turns, ids)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[tuple]:
            for conversation, written in edited(batches):
                sha = hashlib.sha256()
                for n, (_, role, text) in enumerate(written):
                    sha.update(f"{chr(10) if n else ''}{role}:{text}".encode())
                yield conversation, sha.hexdigest()

        yield from _batches(hashed(), {"id": pa.int64(), "repaired_sha256": pa.string()}, 8192)

    found = _with_audits(rows, audits).mapInArrow(digest, "id bigint, repaired_sha256 string")
    return audits.join(found, audits.conv_id.eqNullSafe(found.id)).drop("id").select("conv_id", "gaps", *SUMS[:4], "cost", "audit", "repaired_sha256")
