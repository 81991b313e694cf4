"""Exact Jaccard self-join of word n-gram sets by several global token orders.

A document's tokens are its distinct n-word shingles (54-bit hashes).  Two sets of Jaccard
similarity ``t`` or more share a token within their first ``n - ceil(t n) + 1`` tokens under *any*
global order of the tokens, so candidates are the pairs that share a prefix token under every one
of three orders: by document frequency, then hash; and by two independent hashes (tokens of a
single document first and the very frequent last in all three, these again by frequency or hash).  Candidates are verified exactly.

Steps, all distributed:

1. Tokens that more than one row in ``FREQUENT_ROWS`` has are counted (at most ``FREQUENT`` of them; they
   only move to the end of the orders, and any other token takes the ordinary way).
2. Each task sends its tokens as packed blocks, by hash range; each range is sorted and gives back
   the tokens that occur in two rows or more.  Tokens of a single row need no place of their own:
   their number is what is left.  Equal sets are one class from here on.
3. Classes meet through shared prefix tokens.  In each token's group all members are first held
   against the group's hub (the member with the fewest tokens of its own), so a group of near copies
   costs one comparison a member.  Then members outside the hub's component are held against the
   group's other components: pairs within one component need no second link.
4. Components by minimum labels with pointer jumping, checkpointed each round.

Joins by token, hub, label or class look up one row for each key; keys of very many rows are found first and
meet their row by broadcast or salted copies, so no task gets a third of all rows.

Result per row: doc_id, n_shingles, component_id.

Defined cases: null text is empty; a text without words has no shingles and is alone; fewer words
than ``n`` are one shingle; equal sets are linked; repeated rows are each returned; a null doc_id
takes part but never names a component unless all its ids are null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.text import _mix, checkpointed, shingle_hashes, slices, word_hashes

WORDS = 3
PERCENT = 90
FREQUENT = 20_000
LEAST_FREQUENT = 512
FREQUENT_ROWS = 2048  # a token of more than one row in so many is frequent
HELD = 1 << 21  # tokens that a task counts at once
SHARE = 4  # so many parts of that wait for being added to them
HEAVY_SALTS = 128
HEAVY_PARTS, HEAVY_ROWS = 1000, 1000  # a key of more than this part and number of all rows is heavy
RANGE_TOKENS = 2_000_000
HASH_BITS = 54
HEAD = ["doc_id", "n", "s1", "s2", "frequent"]
ROWS = 1 << (64 - HASH_BITS)


def token_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each token, token): distinct tokens sorted by row and token."""
    texts = texts.fill_null("").cast(pa.large_string())
    for top in range(0, len(texts), ROWS):
        for at, part in slices(texts.slice(top, ROWS)):
            hashes, owners = shingle_hashes(*word_hashes(part), words)
            keys = np.unique((owners.astype(np.uint64) << np.uint64(HASH_BITS)) | (hashes >> np.uint64(64 - HASH_BITS)))
            yield top + at, len(part), (keys >> np.uint64(HASH_BITS)).astype(np.int64), keys & np.uint64((1 << HASH_BITS) - 1)


def planes(x: np.ndarray, width: int) -> bytes:
    """The bytes of little-endian numbers, lowest bytes of all first: they compress better so."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(x: bytes, width: int) -> np.ndarray:
    n = len(x) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(x, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def joined(blocks: pa.ChunkedArray, width: int, extra: pa.ChunkedArray | None = None) -> np.ndarray:
    """The numbers of all blocks one after the other, each block's ``extra`` added to its own; one block is unpacked at a time."""
    sizes = np.asarray(pc.binary_length(blocks), dtype=np.int64) // width
    out = np.empty(sizes.sum(), np.uint64)
    ends = np.cumsum(sizes)
    for i, (block, end, n) in enumerate(zip(blocks, ends.tolist(), sizes.tolist(), strict=True)):
        out[end - n : end] = unplanes(block.as_py(), width)
        if extra is not None:
            out[end - n : end] += np.uint64(extra[i].as_py())
    return out


def frequent_tokens(texts: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """(frequent tokens, rarest first; number of tokens of all rows).

    Each task counts all its tokens; of more than ``HELD`` it takes from every count that of the first one too
    many, and forgets those that come to nothing.  A count is thus too low by ``lost`` at most, which is no more than
    a ``HELD``-th of the task's tokens.  Tokens of one row in ``FREQUENT_ROWS`` are reported, allowing for
    ``lost`` up to half of that: all of them are found, however they are spread, where rows have
    ``HELD / FREQUENT_ROWS / 2`` tokens or fewer on average; where they have more, those of a ``HELD``-th of all tokens more."""

    def smallest(counts: np.ndarray, k: int) -> int:
        """The k-th smallest; most are small."""
        few = np.cumsum(np.bincount(np.minimum(counts, 255).astype(np.uint8), minlength=256))
        n = int(np.searchsorted(few, k))
        return n if n < 255 else int(np.partition(counts, k - 1)[k - 1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = rows = size = lost = 0
        held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        waiting: list[np.ndarray] = []

        def settle() -> None:
            """Adds the waiting tokens to the sorted ones; each array goes as soon as there is a new one."""
            nonlocal held, waiting, size, lost
            new, more = np.unique(np.concatenate([*waiting, np.zeros(0, np.uint64)]), return_counts=True)
            (t, c), held, waiting, size = held, (), [], 0
            at = np.searchsorted(t, new)
            met = t[np.minimum(at, len(t) - 1)] == new if len(t) else np.zeros(len(new), bool)
            c[at[met]] += more[met]
            at, new, more = at[~met], new[~met], more[~met]
            t = np.insert(t, at, new)
            c = np.insert(c, at, more)
            if len(t) > HELD:
                cut = smallest(c, len(c) - HELD)
                lost += cut
                c -= cut
                left = c > 0
                t = t[left]
                c = c[left]
            held = (t, c)

        for batch in batches:
            rows += batch.num_rows
            for _, _, _, tokens in token_sets(batch.column(1), words):
                waiting.append(tokens)
                total += len(tokens)
                size += len(tokens)
                if size > HELD // SHARE:
                    settle()
        settle()
        t, c = held
        least = max(8, rows // FREQUENT_ROWS)
        often = c >= least - min(lost, least // 2)
        yield pa.RecordBatch.from_arrays([pa.array([*t[often].astype(np.int64), -1], pa.int64()), pa.array([*c[often], total], pa.int64())], ["token", "n"])

    counts = checkpointed(texts.mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")))
    total = counts.where("token = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.where((F.col("token") >= 0) & (F.col("n") >= LEAST_FREQUENT))
    by_size = sorted(((r.b, r.k) for r in often.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, kept = None, 0
    for b, k in by_size:
        if kept + k > FREQUENT:
            break
        least, kept = b, kept + k
    if least is None:
        return np.zeros(0, np.uint64), total
    rows = often.where(F.floor(F.log2("n")) >= least).orderBy("n", "token").collect()
    return np.array([r.token for r in rows], np.uint64), total


def shared_tokens(texts: DataFrame, frequent: np.ndarray, total: int, words: int) -> DataFrame:
    """Rows dealt to buckets of keys, of two kinds: for each row of ``texts`` its key and HEAD, and
    blocks of the tokens that other rows have too (keys; number of the token within its hash
    range and its frequency, by steps of an eighth of a doubling from 128 on)."""
    ranges = max(12, math.ceil(total / RANGE_TOKENS))
    order = np.argsort(frequent)
    by_value = frequent[order]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        seen = 0
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            all_tokens, all_keys = [], []
            for at, rows, owners, tokens in token_sets(batch.column(1), words):
                bounds = np.searchsorted(owners, np.arange(rows + 1))
                mixed, second = (np.concatenate([[0], np.cumsum(_mix(x).view(np.int64))]) for x in (tokens, ~tokens))
                if len(by_value) and len(tokens):
                    near = np.minimum(np.searchsorted(by_value, tokens), len(by_value) - 1)
                    often = by_value[near] == tokens
                else:
                    near, often = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
                marks = [(x[bounds[1:]] - x[bounds[:-1]]).tolist() for x in (mixed, second)]
                ranks = order[near] if len(order) else near
                for r in range(rows):
                    a, b = bounds[r], bounds[r + 1]
                    own = np.sort(ranks[a:b][often[a:b]]).tolist()
                    out.append((int(tokens[a] if b > a else r) % ranges, (task << 32) + seen + at + r, ids[at + r], int(b - a), marks[0][r], marks[1][r], own, None, None))
                all_tokens.append(tokens[~often])
                all_keys.append(owners[~often] + (at + seen))
            if all_tokens:
                tokens, keys = np.concatenate(all_tokens), np.concatenate(all_keys)
                by = np.argsort(tokens, kind="stable")
                tokens, keys = tokens[by], keys[by]
                target = ((tokens >> np.uint64(22)) * np.uint64(ranges)) >> np.uint64(32)
                cuts = np.searchsorted(target, np.arange(ranges + 1))
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    a, b = cuts[p], cuts[p + 1]
                    out.append((p, task << 32, None, None, None, None, None, planes(tokens[a:b], 7), planes(keys[a:b], 4)))
            seen += batch.num_rows
            types = (pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int32()), pa.binary(), pa.binary())
            names = ("range", "key", "doc_id", "n", "s1", "s2", "frequent", "tokens", "rows")
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], list(names))

    blocks = texts.mapInArrow(send, "range int, key bigint, doc_id bigint, n bigint, s1 bigint, s2 bigint, frequent array<int>, tokens binary, rows binary")

    def meet(table: pa.Table) -> pa.Table:
        whole = pc.is_valid(table.column("n"))
        rows = table.filter(whole)
        packed = table.filter(pc.invert(whole))
        t = joined(packed.column("tokens"), 7)
        k = joined(packed.column("rows"), 4, packed.column("key"))
        del packed
        by = np.argsort(t)
        t = t[by]
        same = t[1:] == t[:-1]
        many = np.zeros(len(t), bool)
        many[1:] |= same
        many[:-1] |= same
        t, k = t[many], k[by[many]]
        del by, same, many
        start = np.ones(len(t), bool)
        start[1:] = t[1:] != t[:-1]
        number = np.cumsum(start) - 1  # of the token within its range
        df = frequency_code(np.bincount(number))[number] if len(t) else number
        del t, start
        target = bucket_of(k, ranges)
        by = np.lexsort((k, target))
        k, target, entry = k[by], target[by], (number[by] << 8) | df[by]
        cuts = np.searchsorted(target, np.arange(ranges + 1))
        full = np.flatnonzero(np.diff(cuts)).tolist()
        m, n = rows.num_rows, len(full)
        here = table.column("range")[0].as_py()
        packs = [(planes(k[x:y], 8), planes(entry[x:y], 5)) for x, y in zip(cuts[full].tolist(), cuts[np.array(full, int) + 1].tolist(), strict=True)]
        keys = np.asarray(rows.column("key").combine_chunks())
        return pa.table({
            "bucket": pa.array(np.concatenate([bucket_of(keys.astype(np.uint64), ranges), full]).astype(np.int32)),
            "range": pa.array([here] * (m + n), pa.int32()),
            **{c: pa.concat_arrays([rows.column(c).combine_chunks(), pa.nulls(n, rows.schema.field(c).type)]) for c in ("key", *HEAD)},
            "keys": pa.array([None] * m + [x for x, _ in packs], pa.binary()),
            "entries": pa.array([None] * m + [x for _, x in packs], pa.binary()),
        })

    return blocks.groupBy("range").applyInArrow(meet, "bucket int, range int, key bigint, doc_id bigint, n bigint, s1 bigint, s2 bigint, frequent array<int>, keys binary, entries binary")


def frequency_code(n: np.ndarray) -> np.ndarray:
    """8 bits that never fall with n: n itself below 128, from there steps of 2 ** (1 / 8)."""
    return np.where(n < 128, n, np.minimum(128 + 8 * np.log2(np.maximum(n, 128) / 128), 255).astype(n.dtype))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((_mix(keys) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def with_prefixes(met: DataFrame, percent: int) -> DataFrame:
    """Per row: key, doc_id, n, s1, s2; and, if its prefix holds a token of other rows: own (the
    number of tokens of no other row), its shared tokens as one array (frequent ones as negative
    numbers), and its prefix under each order."""

    def cut(table: pa.Table) -> pa.Table:
        whole = pc.is_valid(table.column("n"))
        packed = table.filter(pc.invert(whole))
        k = joined(packed.column("keys"), 8)
        e = joined(packed.column("entries"), 5, pc.multiply(packed.column("range").cast(pa.int64()), 1 << 40))
        del packed
        by = np.argsort(k)
        k, e = k[by], e[by]
        rows = table.filter(whole).select(["key", *HEAD]).to_pydict()
        mine = np.array(rows["key"], np.uint64)
        firsts, ends = np.searchsorted(k, mine), np.searchsorted(k, mine, side="right")
        del k, by
        more: list[list] = [[], [], [], [], []]
        for n, often, a, b in zip(rows["n"], rows["frequent"], firsts.tolist(), ends.tolist(), strict=True):
            own = n - (b - a) - len(often)
            room = prefix_length(n, percent) - own
            values = [None] * 5
            if n and room > 0:
                u, c = e[a:b] >> np.uint64(8), e[a:b] & np.uint64(255)
                t = u.astype(np.int64)
                orders = [np.lexsort((t, c)), np.argsort(_mix(u)), np.argsort(_mix(u ^ np.uint64(0x5BD1E9955BD1E995)))]
                last = np.sort(np.array(often, np.int64))
                lasts = [last, *(last[np.argsort(_mix(last.astype(np.uint64) ^ np.uint64(x)))] for x in (1 << 40, 1 << 41))]
                fronts = [[*t[o[:room]].tolist(), *(-1 - x[: max(0, room - len(t))]).tolist()] for o, x in zip(orders, lasts, strict=True)]
                last = (-1 - last).tolist()
                values = [own, [*t.tolist(), *last], *fronts]
            for column, v in zip(more, values, strict=True):
                column.append(v)
        longs = pa.list_(pa.int64())
        return pa.table({
            **{c: pa.array(rows[c], pa.int64()) for c in ("key", "doc_id", "n", "s1", "s2")},
            **{c: pa.array(x, y) for c, x, y in zip(("own", "tokens", "p1", "p2", "p3"), more, (pa.int64(), longs, longs, longs, longs), strict=True)},
        })

    arrays = ", ".join(f"{c} array<bigint>" for c in ("tokens", "p1", "p2", "p3"))
    return met.groupBy("bucket").applyInArrow(cut, f"key bigint, doc_id bigint, n bigint, s1 bigint, s2 bigint, own bigint, {arrays}")


def heavy_keys(df: DataFrame, *keys: str) -> list[int]:
    """Hashes of the keys that more than one in HEAVY_PARTS of all rows have: fewer than HEAVY_PARTS."""
    n = F.count("*").alias("_n")
    least = max(HEAVY_ROWS, df.count() / HEAVY_PARTS)
    return [r[0] for r in df.groupBy(*keys).agg(n).where(F.col("_n") > least).select(F.xxhash64(*keys)).collect()]


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], heavy: list[int], how: str = "inner", salt: str | None = None) -> DataFrame:
    """Join with ``right``, which has one row for each key, so that no task gets all rows of a heavy key: they
    meet its row by broadcast where they are; or, where such a row may be wide, are dealt by ``salt`` to one
    of ``HEAVY_SALTS`` copies of it."""
    if not heavy:
        return left.join(right, keys, how)
    these = F.xxhash64(*keys).isin(heavy)
    rest = left.where(~these).join(right.where(~these), keys, how)
    if salt is None:
        return left.where(these).join(F.broadcast(right.where(these)), keys, how).unionByName(rest)
    copies = right.where(these).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(HEAVY_SALTS - 1))))
    dealt = left.where(these).withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(HEAVY_SALTS)).cast("int"))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt").unionByName(rest)


def linked(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share a prefix token under every order and whose exact similarity is enough."""
    sides = [nodes.select(F.col("key").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "tokens", "p2", "p3"))) for s in ("a", "b")]
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    pairs = checkpointed(pairs)
    met = looked_up(pairs, sides[0], ["a"], heavy_keys(pairs, "a"), salt="b")
    met = looked_up(met, sides[1], ["b"], heavy_keys(pairs, "b"), salt="a").where(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b"))
    return met.where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(key, label): the smallest key reachable, for the nodes that have a link."""
    edges = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    heavy = heavy_keys(edges, "b")
    labels = checkpointed(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        offers = looked_up(edges, labels.select(F.col("key").alias("b"), "label"), ["b"], heavy).groupBy(F.col("a").alias("key")).agg(F.min("label").alias("offer"))
        step = checkpointed(labels.join(offers, "key", "left").select("key", F.col("label").alias("old"), F.least("label", "offer").alias("label")))
        if not step.where(F.col("old") != F.col("label")).limit(1).count():
            return labels
        jump = step.select(F.col("key").alias("label"), F.col("label").alias("next"))
        labels = checkpointed(looked_up(step, jump, ["label"], heavy_keys(step, "label"), "left").select("key", F.least("label", "next").alias("label")))


def _possible(before_a: Column, n_a: Column, before_b: Column, n_b: Column, percent: int) -> Column:
    """Whether what follows suffices for the similarity, if the first common token has so many
    tokens before it.  For a later common token the bound is lower, and nothing is lost by it: the
    pair's first one is a row of its own."""
    most = F.least(n_a - before_a, n_b - before_b)
    return 100 * most >= percent * (n_a + n_b - most)


def class_links(nodes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that connect all classes with a path of links, and only those."""
    slots = nodes.select("key", "n", "own", F.posexplode("p1").alias("place", "token")).withColumn("before", F.col("own") + F.col("place")).drop("place")
    hubs = slots.groupBy("token").agg(F.count("*").alias("members"), F.min(F.struct("own", "key", "n", "before")).alias("h")).where("members > 1")
    hubs = checkpointed(hubs.select("token", "members", F.col("h.key").alias("hub"), F.col("h.before").alias("hub_before"), F.col("h.n").alias("hub_n")))
    c = F.col
    heavy = [r[0] for r in hubs.where(c("members") > max(HEAVY_ROWS, slots.count() / HEAVY_PARTS)).select(F.xxhash64("token")).collect()]
    met = checkpointed(looked_up(slots, hubs.drop("members"), ["token"], heavy))
    stars = met.where((c("key") != c("hub")) & _possible(c("before"), c("n"), c("hub_before"), c("hub_n"), percent))
    first = checkpointed(linked(stars.select(c("key").alias("a"), c("hub").alias("b")).distinct(), nodes, percent))
    labels = components(nodes, first)
    named = met.select("token", "key", "n", "before").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    hub_labels = checkpointed(hubs.join(labels.withColumnRenamed("key", "hub"), "hub", "left").select("token", F.coalesce("label", "hub").alias("hub_label")))
    placed = checkpointed(looked_up(named, hub_labels, ["token"], heavy))
    left = placed.where(c("label") != c("hub_label")).select("token", *(c(x).alias(f"{x}_a") for x in ("key", "n", "before", "label")))
    right = placed.select(c("token").alias("token_b"), *(c(x).alias(f"{x}_b") for x in ("key", "n", "before", "label", "hub_label")))
    pairs = left.join(
        right,
        (c("token") == c("token_b"))
        & (c("label_a") != c("label_b"))
        & ((c("key_a") < c("key_b")) | (c("label_b") == c("hub_label_b")))
        & _possible(c("before_a"), c("n_a"), c("before_b"), c("n_b"), percent),
    )
    return first.union(linked(pairs.select(c("key_a").alias("a"), c("key_b").alias("b")).distinct(), nodes, percent))


def similarity_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    texts = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    frequent, total = frequent_tokens(texts, words)
    rows = checkpointed(with_prefixes(shared_tokens(texts, frequent, total, words), percent))
    same = ["n", "s1", "s2"]
    classes = rows.where("n > 0").groupBy(*same).agg(F.min("key").alias("class"), F.min("doc_id").alias("least"), F.count("*").alias("size"))
    classes = checkpointed(classes)
    nodes = rows.where("own is not null").join(classes.select(F.col("class").alias("key")), "key", "left_semi").select("key", "n", "own", "tokens", "p1", "p2", "p3")
    nodes = checkpointed(nodes)
    labels = components(nodes, class_links(nodes, percent)).withColumnRenamed("key", "class")
    named = checkpointed(classes.join(labels, "class", "left").select(*same, "least", "size", F.coalesce("label", "class").alias("label")))
    firsts = checkpointed(named.groupBy("label").agg(F.min("least").alias("component_id")))
    placed = checkpointed(looked_up(named, firsts, ["label"], heavy_keys(named, "label")).select(*same, "size", "component_id"))
    copied = [r[0] for r in placed.where(F.col("size") > max(HEAVY_ROWS, rows.count() / HEAVY_PARTS)).select(F.xxhash64(*same)).collect()]
    members = rows.select("doc_id", *same)
    found = looked_up(members.where("n > 0"), placed.drop("size"), same, copied).select("doc_id", "n", "component_id")
    return found.unionByName(members.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))).withColumnRenamed("n", "n_shingles")
