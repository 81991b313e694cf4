"""Pairs of sites whose item sets nearly agree: by prefixes of rare items, and block by block where items are common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators.keyed import looked_up, numbered
from skarn.session import written

BLOCK, COLUMNS = 1024, 4096
PAIRS = 1 << 18  # pairs of a batch, or those of one pair of sets


class _Sets:
    """The different sets of some sites, which come with equal sets side by side."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        new = np.ones(len(sizes), bool)
        keys = [flat[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        new[1:] = [x != y for x, y in zip(keys[1:], keys[:-1], strict=True)]
        self.first = np.flatnonzero(new)  # the first site of each, and how many there are
        self.count = np.diff(np.append(self.first, len(sizes)))
        self.size = sizes[self.first]
        self.items = flat[np.repeat(new, sizes)]
        self.owner = np.repeat(np.arange(len(self.first)), self.size)
        place = np.arange(len(self.items)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.prefix = place <= (self.size - -(-2 * self.size // 3))[self.owner]

    def held(self, codes: np.ndarray, these: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.first), len(codes)), np.float32)
        at = np.searchsorted(codes, self.items[these])
        inside = at < len(codes)
        inside[inside] = codes[at[inside]] == self.items[these][inside]
        out[self.owner[these][inside], at[inside]] = 1
        return out


def _common(a: _Sets, b: _Sets, these_a: np.ndarray, these_b: np.ndarray) -> np.ndarray:
    """Number of these items that each set of ``a`` shares with each of ``b``."""
    codes = np.intersect1d(a.items[these_a], b.items[these_b])
    out = np.zeros((len(a.first), len(b.first)), np.float32)
    for at in range(0, len(codes), COLUMNS):
        out += a.held(codes[at : at + COLUMNS], these_a) @ b.held(codes[at : at + COLUMNS], these_b).T
    return out.astype(np.int64)


def _near(a: _Sets, b: _Sets) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs of sets are near, items shared)"""
    shared = _common(a, b, np.ones(len(a.items), bool), np.ones(len(b.items), bool))
    both = a.size[:, None] + b.size[None, :] - shared
    return (shared >= 2) & (3 * shared >= 2 * both) & (shared < both), shared


def _pairs(a: _Sets, b: _Sets, near: np.ndarray, shared: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in a, place in b, shared) of all sites of near sets."""
    x, y = np.nonzero(near)
    n = a.count[x] * b.count[y]
    block = np.cumsum(n) // PAIRS
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(x)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        if low < high:
            of = np.repeat(np.arange(low, high), n[low:high])
            within = np.arange(len(of)) - np.repeat(np.cumsum(n[low:high]) - n[low:high], n[low:high])
            yield a.first[x[of]] + within // b.count[y[of]], b.first[y[of]] + within % b.count[y[of]], shared[x[of], y[of]]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.value_lengths()).astype(np.int64), np.asarray(column.flatten()).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BLOCK rows (site, items) as one: sites, sizes, items, and the different items of all prefixes."""
    for batch in batches:
        for top in range(0, batch.num_rows, BLOCK):
            sites, lists = (batch.column(i).slice(top, BLOCK) for i in (0, 1))
            sizes, flat = _lists(lists)
            sets = _Sets(sizes, flat)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (sites, pa.array(sizes), pa.array(flat), pa.array(np.unique(sets.items[sets.prefix])))],
                ["sites", "sizes", "items", "prefix"],
            )


def near_sets(rows: DataFrame) -> DataFrame:
    """site_a, site_b, shared: pairs of sites (site_a < site_b) that share two items at least and 2/3 of
    all their items, but not all.  ``rows`` has site and item; null sites and items take no part.

    Items are numbered by how many sites hold them: sets that share 2/3 of all their items share one of the first
    ``n - ceil(2 n / 3) + 1``.  Items of BLOCK sites at most are slots: the sites at one are compared in one task, and a pair is
    kept at the first that both have.  Sites with a more common item among their first ones are compared with each other by
    blocks, whose rows aren't copied for it: what is kept on disk grows with the sets, not with their pairs."""
    items = written(rows.where("site IS NOT NULL AND item IS NOT NULL").select("site", "item").distinct())
    held = items.groupBy("item").agg(F.count("*").alias("held"))
    codes = written(numbered(held, [], ["held", "item"], "code"))
    common = codes.where(F.col("held") > BLOCK).agg(F.min("code")).first()[0]
    common = (1 << 62) if common is None else common  # items from this one on aren't slots
    sets = looked_up(items, codes, ["item"], "held").groupBy("site").agg(F.array_sort(F.collect_list("code")).alias("items")).where(F.size("items") >= 2)
    n = F.size("items")
    sets = written(sets.withColumn("prefix", F.slice("items", 1, n - F.ceil(2 * n / 3).cast("int") + 1)).withColumn("dense", F.element_at("prefix", -1) >= common))
    site = dict(sets.dtypes)["site"]
    out = f"a {site}, b {site}, shared bigint"

    def at_slot(table: pa.Table) -> pa.Table:
        slot, dense = table.column("slot")[0].as_py(), table.column("dense").to_numpy()
        lists = table.column("items").combine_chunks()
        order = np.array(sorted(range(len(lists)), key=[x.values.to_numpy().tobytes() for x in lists].__getitem__), np.int64)
        table, dense = table.take(pa.array(order)), dense[order]
        sets = _Sets(*_lists(table.column("items").combine_chunks()))
        near, shared = _near(sets, sets)
        near &= np.triu(np.ones(near.shape, bool), 1) & ~(dense[sets.first][:, None] & dense[sets.first][None, :])
        earlier = sets.prefix & (sets.items < slot)
        near &= _common(sets, sets, earlier, earlier) == 0
        found = [np.concatenate(x) for x in zip(*_pairs(sets, sets, near, shared), strict=True)] or [np.zeros(0, np.int64)] * 3
        sites = table.column("site").combine_chunks()
        return pa.table({"a": sites.take(pa.array(found[0])), "b": sites.take(pa.array(found[1])), "shared": pa.array(found[2])})

    def by_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                low, high = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                sites, sizes, flat = ([batch.column(j)[i].values for j in (k, k + 3)] for k in (2, 3, 4))
                a, b = (_Sets(np.asarray(s), np.asarray(f)) for s, f in zip(sizes, flat, strict=True))
                near, shared = _near(a, b)
                if low == high:
                    near &= np.triu(np.ones(near.shape, bool), 1)
                for x, y, both in _pairs(a, b, near, shared):
                    yield pa.RecordBatch.from_arrays([sites[0].take(pa.array(x)), sites[1].take(pa.array(y)), pa.array(both)], ["a", "b", "shared"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = sets.select("site", "items", "dense", F.explode(F.filter("prefix", lambda x: x < common)).alias("slot"))
    pairs = slots.groupBy("slot").applyInArrow(at_slot, out)
    dense = sets.where("dense").select("site", "items").repartitionByRange(tasks, "items", "site").sortWithinPartitions("items", "site")
    blocks = dense.mapInArrow(_packed, f"sites array<{site}>, sizes array<bigint>, items array<bigint>, prefix array<bigint>")
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()))
    low, high = blocks.repartition(tasks).alias("low"), blocks.alias("high")
    met = low.join(high, (F.col("low.block") <= F.col("high.block")) & F.arrays_overlap("low.prefix", "high.prefix"))
    met = met.select(*(F.col(f"{s}.block").alias(f"{s}_block") for s in ("low", "high")), *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("low", "high") for c in ("sites", "sizes", "items")))
    pairs = pairs.unionByName(met.mapInArrow(by_blocks, out))
    return pairs.select(F.least("a", "b").alias("site_a"), F.greatest("a", "b").alias("site_b"), "shared")
