"""Shards of nearly equal bytes: longest-processing-time scheduling of groups of equal texts.

A row weighs the UTF-8 bytes of its text and ``OVERHEAD``; rows of equal texts are a group that
stays together.  Groups, heaviest first, go to the least loaded shard (of equal loads the smallest
number) through a heap.  Groups of one weight are interchangeable, so the heap deals a whole class
of them at a time, in rounds, and needs no row for each group:

1. Rows become (128 bits of the text's sha256, size); texts are read once and not shuffled.
2. Copies are added up map-side; groups are counted by weight.
3. One task reads the classes of weight in order and keeps a heap of ``shards`` loads.  It reads
   one row for each different weight: ``k`` different weights sum up to ``k * k / 2`` at least, so
   there are at most ``sqrt(2 * bytes)`` of them.
4. Within a class groups are numbered in the order of their texts' hashes, by ranges of hashes
   that hold ``BUCKET_GROUPS`` groups on average; the class's first numbers go to its first shard and so on.
5. Rows meet their group's shard by hash; groups of over a thousandth of all rows by broadcast.
6. Slots number a shard's rows by (id, checksum, size) after one range partitioning of these
   narrow rows, so neither a shard nor a group of copies is ever gathered.

The heaviest load is at most 4/3 - 1/(3 * shards) times the least that any dealing of whole groups
allows.  A group heavier than a shard's even part has a shard whose load is its own weight.

Defined cases: a null text has no bytes and is one group with the empty text; repeated rows and
rows without an id each have a slot; fewer groups than shards leave shards empty; an empty table
gives an empty result; other columns are ignored, or returned in ``row`` if asked for.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.jaccard import HEAVY_PARTS, HEAVY_ROWS, looked_up
from skarn.llm.text import checkpointed

SHARDS = 40
OVERHEAD = 16
LAW = "bytes"
KEY_BYTES = 16
BUCKET_GROUPS = 50_000
FILE_ROWS = 1_000_000


def deal(heap: list[tuple[int, int]], weight: int, count: int) -> dict[int, int]:
    """How many of ``count`` groups of one weight each shard gets if they go one by one to the least
    loaded; ``heap`` holds (load, shard) and is brought up to date.

    The shards within one weight of the least loaded get one group each before any other gets one
    or any of them a second, so whole rounds are dealt at once, until the next shard is within reach."""
    given: dict[int, int] = {}
    while count:
        least = heap[0][0]
        level = []
        while heap and heap[0][0] < least + weight:
            level.append(heapq.heappop(heap))
        rounds = count // len(level)
        if heap:
            rounds = min(rounds, (heap[0][0] - least) // weight)
        takers = len(level) if rounds else count
        rounds = max(rounds, 1)
        for n, (load, shard) in enumerate(level):
            got = rounds if n < takers else 0
            given[shard] = given.get(shard, 0) + got
            heapq.heappush(heap, (load + got * weight, shard))
        count -= rounds * takers
    return {shard: n for shard, n in given.items() if n}


def shares(classes: DataFrame, shards: int) -> DataFrame:
    """(weight, shares): for each class (weight, groups) the shards and the first number beyond each one's groups."""
    schema = pa.schema([("weight", pa.int64()), ("shares", pa.list_(pa.struct([("upto", pa.int64()), ("shard", pa.int32())])))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = [(0, shard) for shard in range(shards)]
        for batch in batches:
            rows = []
            for weight, groups in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                upto, parts = 0, []
                for shard, n in sorted(deal(heap, weight, groups).items()):
                    upto += n
                    parts.append({"upto": upto, "shard": shard})
                rows.append({"weight": weight, "shares": parts})
            yield pa.RecordBatch.from_pylist(rows, schema)

    ordered = classes.select("weight", "groups").repartition(1).sortWithinPartitions(F.desc("weight"))
    return ordered.mapInArrow(scan, "weight bigint, shares array<struct<upto: bigint, shard: int>>")


def shards_of_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(key, shard) of the groups (key, weight); keys are uniform hashes."""
    buckets = max(1, math.ceil(groups.count() / BUCKET_GROUPS))
    head = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("bigint")
    bucketed = groups.select("key", "weight", F.shiftright(head * F.lit(buckets), 32).alias("bucket"))
    sizes = checkpointed(bucketed.groupBy("weight", "bucket").agg(F.count("*").alias("groups")))
    classes = shares(sizes.groupBy("weight").agg(F.sum("groups").alias("groups")), shards)
    earlier = Window.partitionBy("weight").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spots = sizes.withColumn("before", F.coalesce(F.sum("groups").over(earlier), F.lit(0))).drop("groups").join(classes, "weight")
    number = F.row_number().over(Window.partitionBy("weight", "bucket").orderBy("key")) - 1
    numbered = bucketed.withColumn("within", number).join(spots, ["weight", "bucket"])
    return numbered.select("key", F.expr("filter(shares, s -> before + within < s.upto)[0].shard").alias("shard"))


def assign_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: no law of keys) of every row; with
    ``keep`` also these columns of it, in the struct ``row``."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = [
        F.col(doc_id).cast("bigint").alias("doc_id"),
        (F.octet_length(content) + F.lit(OVERHEAD)).cast("bigint").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.substring(F.unhex(F.sha2(content, 256)), 1, KEY_BYTES).alias("key"),
        F.monotonically_increasing_id().alias("at"),
    ]
    rows = checkpointed(docs.select(*own, *([F.struct(*keep).alias("row")] if keep else [])))
    groups = checkpointed(rows.groupBy("key", "size").agg(F.count("*").alias("copies")))
    least = max(HEAVY_ROWS, rows.count() / HEAVY_PARTS)
    copied = [r[0] for r in groups.where(F.col("copies") > least).select(F.xxhash64("key")).collect()]
    placed = shards_of_groups(groups.select("key", (F.col("size") * F.col("copies")).alias("weight")), shards)
    met = looked_up(rows, placed, ["key"], copied).drop("key")
    return numbered_slots(met, ["doc_id", "text_crc32", "size", "at"]).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *(["row"] if keep else []))


def numbered_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``slot``: each shard's rows from 0 on, in this order."""
    keys = ["shard", *order]
    ordered = checkpointed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()))
    runs = ordered.groupBy("shard", F.shiftright("_place", 33).alias("_part")).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select("shard", "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    # Ranges hold whole stretches of shards, so there are fewer runs than partitions and shards together.
    met = ordered.withColumn("_part", F.shiftright("_place", 33)).join(F.broadcast(shifts), ["shard", "_part"])
    return met.withColumn("slot", F.col("_place") + F.col("_shift")).drop("_place", "_part", "_shift")


def write_shards(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, file_rows: int = FILE_ROWS) -> None:
    """Writes all rows as Parquet, a folder for each shard, its files in the order of their slots; columns
    ``slot`` and ``row``."""
    placed = assign_shards(docs, doc_id, text, shards, docs.columns).select("shard", "slot", "row")
    files = placed.withColumn("_file", F.floor(F.col("slot") / F.lit(file_rows))).repartition("shard", "_file").sortWithinPartitions("shard", "slot")
    files.drop("_file").write.mode("errorifexists").partitionBy("shard").parquet(folder)
