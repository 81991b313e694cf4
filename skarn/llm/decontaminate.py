"""Benchmark decontamination by SimHash windows.

For each benchmark item, windows of the item's own length in words slide over the documents.
A window's and an item's fingerprint is the SimHash of ``BITS`` bits of its five-word shingles, weighted by
how rare they are among the items.  It has ``BLOCKS`` blocks of 16 bits: two fingerprints within
``RADIUS`` bits agree to within ``NEAR`` bits in one block at least, as ``BLOCKS * (NEAR + 1) > RADIUS``.
For each length and block all values within ``NEAR`` bits of an item's are marked, so a window that meets no mark
is within the radius of no item; one that does is held against the items' values in that block, and
so every item within the radius is found.  What is found there is verified by the exact
weighted similarity, ``sum(w * min) / sum(w * max)`` over shingle counts, of ``SIMILARITY``
or more; the best window of each (document, item) is returned.

Windows without any shingle of an item have similarity 0 with it, so only windows that hold one are
fingerprinted (for the lengths of the items that have it).

Items are a query set: the index is built for blocks of ``ITEM_BLOCK`` items or ``ITEM_CHARS`` characters, one
after the other, each held against all documents.  Between two blocks the rows are checkpointed and the
index before is let go, so a task has one worker and one index however many items there are.

Words are compared without regard to case, in all scripts.

Defined cases: null or empty documents and items match nothing; an item of fewer than five words
is one shingle, its whole sequence; documents of any length are scanned whole; repeated documents
or items are reported each; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.text import _mix, checkpointed, shingle_hashes, slices, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BITS = 256
BLOCKS = BITS // 16
NEAR = 3
RADIUS = BLOCKS * (NEAR + 1) - 1
WINDOWS = 8192  # places whose windows are fingerprinted at once
ITEM_BLOCK = 4096
ITEM_CHARS = 2_000_000  # a block ends with the item that reaches it
FEW = 16  # items of one length that are looked through without marks
PAIRS = 1 << 20  # (window, item) looked at at once
FILTER_BITS = 22

SCHEMA = "doc_id bigint, item_id bigint, first_word int, n_words int, distance int, similarity double"
_BITS = np.arange(64, dtype=np.uint64)
_ALL = np.arange(1 << 16, dtype=np.uint16)
_CHANGES = _ALL[np.bitwise_count(_ALL) <= NEAR]


class Index:
    """Fingerprints and shingles of a bounded block of items."""

    def __init__(self, ids: list[int | None], texts: list[str | None], frequency: dict[int, int] | None = None, total: int | None = None) -> None:
        words, first = word_hashes(pc.utf8_lower(pa.array(texts, pa.large_string())))
        self.ids, self.size = ids, np.diff(first)
        hashes, owners = shingle_hashes(words, first, SHINGLE)
        self.counts = [Counter() for _ in ids]
        for h, o in zip(hashes.tolist(), owners.tolist(), strict=True):
            self.counts[o][h] += 1
        # of all items; without them these are all
        frequency, total = frequency or Counter(h for c in self.counts for h in c), total or len(ids)
        self.unknown = float(np.log1p(total))
        self.weight = {h: float(np.log1p(total / frequency[h])) for h in {h for c in self.counts for h in c}}
        self.holders: dict[int, list[int]] = {}
        for o, c in enumerate(self.counts):
            for h in c:
                self.holders.setdefault(h, []).append(o)
        self.shingles = np.array(sorted(self.weight), np.uint64)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.shingles >> np.uint64(64 - FILTER_BITS)] = True
        self.prints = np.zeros((len(ids), BITS // 64), np.uint64)
        for o, c in enumerate(self.counts):
            if c:
                h = np.array(list(c), np.uint64)
                w = np.array([self.weight[x] * n for x, n in c.items()])
                self.prints[o] = fingerprints((signs(h) * w[:, None]).sum(0)[None])[0]
        self.sizes = np.unique(self.size)
        self.short = sorted({int(n) for n in self.size if 0 < n < SHINGLE})
        self.marks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray | None]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"marks": {}}  # each worker marks the lengths that it meets

    def marked(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(items of a size, their values by block, bits of all values near one of them by block; 128 KB, none for a ``FEW`` items)."""
        if size not in self.marks:
            items = np.flatnonzero(self.size == size)
            values = np.ascontiguousarray(self.prints[items]).view(np.uint16).reshape(len(items), BLOCKS)
            bits = None
            if len(items) >= FEW:
                bits = np.zeros((BLOCKS, 1 << 13), np.uint8)
                for b in range(BLOCKS):
                    near = np.zeros(1 << 16, bool)
                    near[values[:, b, None] ^ _CHANGES] = True
                    bits[b] = np.packbits(near, bitorder="little")
            self.marks[size] = items, values, bits
        return self.marks[size]

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that some item has."""
        at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
        if not len(at) or not len(self.shingles):
            return at[:0]
        near = np.minimum(np.searchsorted(self.shingles, hashes[at]), len(self.shingles) - 1)
        return at[self.shingles[near] == hashes[at]]

    def within(self, prints: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
        """(place in prints, item, distance) of all items of a size within RADIUS, by way of the blocks."""
        items, values, bits = self.marked(size)
        if not len(items) or not len(prints):
            return
        theirs = prints.view(np.uint16).reshape(len(prints), BLOCKS)
        step = max(1, PAIRS // len(items))
        met = []
        for b in range(BLOCKS):
            mine = theirs[:, b]
            places = np.arange(len(prints)) if bits is None else np.flatnonzero((bits[b][mine >> 3] >> (mine & 7).astype(np.uint8)) & 1)
            for part in (places[x : x + step] for x in range(0, len(places), step)):
                p, i = np.nonzero(np.bitwise_count(mine[part, None] ^ values[:, b]) <= NEAR)
                met.append(part[p] * len(items) + i)
        if not met:
            return
        place, item = np.divmod(np.unique(np.concatenate(met)), len(items))
        item = items[item]
        far = np.bitwise_count(prints[place] ^ self.prints[item]).sum(1)
        near = far <= RADIUS
        yield from zip(place[near].tolist(), item[near].tolist(), far[near].tolist(), strict=True)

    def similarity(self, window: Counter, item: int) -> float:
        both = total = 0.0
        own = self.counts[item]
        for h in own.keys() | window.keys():
            w = self.weight.get(h, self.unknown)
            a, b = own[h], window[h]
            both += w * min(a, b)
            total += w * max(a, b)
        return both / total if total else 0.0

    def search(self, shingles: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(item, first word, distance, similarity): for each item its best window in one
        document, whose shingles (by place) and places of known shingles are given."""
        starts: dict[tuple[int, int], set[int]] = {}  # by window's and item's size
        last = len(shingles) + SHINGLE - 1
        for q in hits.tolist():
            for n in {int(self.size[o]) for o in self.holders[int(shingles[q])]}:
                if SHINGLE <= n <= last:
                    starts.setdefault((n, n), set()).update(range(max(0, q - n + SHINGLE), min(q, last - n) + 1))
                elif n > last:
                    starts.setdefault((last, n), set()).add(0)
        best: dict[int, tuple] = {}
        for (n, size), places in starts.items():
            places = np.array(sorted(places))
            for at in np.split(places, np.flatnonzero(np.diff(places // WINDOWS)) + 1):
                low, high = int(at[0]), int(at[-1]) + n - SHINGLE + 1
                part = shingles[low:high]
                w = np.array([self.weight.get(h, self.unknown) for h in part.tolist()])
                sums = np.zeros((len(part) + 1, BITS))
                np.cumsum(signs(part) * w[:, None], axis=0, out=sums[1:])
                windows = fingerprints(sums[at - low + n - SHINGLE + 1] - sums[at - low])
                for p, item, d in self.within(windows, size):
                    a = int(at[p])
                    s = self.similarity(Counter(shingles[a : a + n - SHINGLE + 1].tolist()), item)
                    if s >= SIMILARITY and (item not in best or (s, -a) > (best[item][2], -best[item][0])):
                        best[item] = (a, d, s)
        for item, (a, d, s) in sorted(best.items()):
            yield item, a, d, s


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of BITS bits that a shingle's hash is drawn out to."""
    drawn = np.stack([_mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(BITS // 64)], 1)
    return ((drawn[:, :, None] >> _BITS) & np.uint64(1)).reshape(len(hashes), BITS).astype(np.float64) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).reshape(len(sums), BITS // 64)


def matches_in(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, item, first word, distance, similarity) over the rows of an Arrow string array."""
    for base, part in slices(texts.fill_null("").cast(pa.large_string())):
        words, first = word_hashes(pc.utf8_lower(part))
        whole = np.diff(first)
        hashes, owners = shingle_hashes(words, first, SHINGLE)
        hits = index.found(hashes)
        hits = hits[whole[owners[hits]] >= SHINGLE]
        bounds = np.searchsorted(owners[: len(hashes) - np.count_nonzero((whole > 0) & (whole < SHINGLE))], np.arange(len(part) + 1))
        rows = owners[hits]
        for row in np.unique(rows).tolist():
            a, b = bounds[row], bounds[row + 1]
            for item, at, d, s in index.search(hashes[a:b], hits[rows == row] - a):
                yield base + row, item, at, d, s
        owners = np.repeat(np.arange(len(part)), whole)
        for n in index.short:
            m = max(len(words) - n + 1, 0)
            windows = _mix(words[:m])
            for j in range(1, n):
                windows = _mix(windows + words[j : j + m])
            at = index.found(_mix(windows + np.uint64(n)))
            seen = set()
            for q in at[owners[at] == owners[at + n - 1]].tolist():
                row = int(owners[q])
                for item in index.holders[int(_mix(windows[q : q + 1] + np.uint64(n))[0])]:
                    if index.size[item] == n and (row, item) not in seen:
                        seen.add((row, item))
                        yield base + row, item, q - int(first[row]), 0, 1.0


def _item_shingles(texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
    return shingle_hashes(*word_hashes(pc.utf8_lower(pa.array(texts, pa.large_string()))), SHINGLE)


def _frequencies(items: DataFrame, text: str) -> DataFrame:
    """h, n: the number of items that hold each shingle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owners = _item_shingles(batch.column(0).to_pylist())
            once = np.unique(np.stack([hashes.view(np.int64), owners.astype(np.int64)], 1), axis=0)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(once, pa.int64())], ["h"])

    return items.select(F.col(text).cast("string")).mapInArrow(count, "h bigint").groupBy("h").agg(F.count("*").alias("n"))


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Index]:
    """Indexes over blocks of items, read one block at a time; shingles weigh by their frequency in all items."""
    total = items.count()
    chars = items.agg(F.coalesce(F.sum(F.length(F.col(text).cast("string"))), F.lit(0))).first()[0]
    held = checkpointed(_frequencies(items, text)) if total > ITEM_BLOCK or chars >= ITEM_CHARS else None

    def index(ids: list, texts: list) -> Index:
        if held is None:
            return Index(ids, texts)
        mine = held.sparkSession.sparkContext.broadcast(np.unique(_item_shingles(texts)[0].view(np.int64)))

        def of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(np.isin(batch.column(0).to_numpy(), mine.value)))

        found = held.mapInArrow(of_block, "h bigint, n bigint").collect()
        return Index(ids, texts, {r.h % (1 << 64): r.n for r in found}, total)

    ids, texts, size = [], [], 0
    for r in items.select(F.col(item_id).cast("bigint"), F.col(text).cast("string")).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "")
        if len(ids) == ITEM_BLOCK or size >= ITEM_CHARS:
            yield index(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield index(ids, texts)


def find_contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each (document, item) that has a window of the item's length at SIMILARITY."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    parts: list[DataFrame] = []
    held = None
    for index in _blocks(items, item_id, text):
        if parts:
            parts[-1] = checkpointed(parts[-1])
            held.unpersist()
        held = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[r], index.ids[i], at, int(index.size[i]), d, s) for r, i, at, d, s in matches_in(index, batch.column(1))]
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in SCHEMA.split(", ")])

        parts.append(texts.mapInArrow(search, SCHEMA))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], SCHEMA)


def keep_uncontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any matching window, with all their columns."""
    place, schema = docs.columns.index(text), docs.schema
    held = None
    for index in _blocks(items, item_id, item_text):
        if held is not None:
            docs = checkpointed(docs)
            held.unpersist()
        held = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in matches_in(held.value, batch.column(place))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, schema)
    return docs
