"""Fingerprints against a plain version of one-permutation MinHash."""

from __future__ import annotations

import random
import re

import xxhash
from pyspark.sql import functions as F

from skarn.llm import fingerprint

MASK = (1 << 64) - 1


def spark_hash(*values: str | int) -> int:
    """xxhash64 of Spark: each value is hashed with the hash of those before it as the seed, from 42."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), seed)
    return seed


def plain_fingerprint(text: str | None, orders: list[list[int]]) -> str:
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if len(w) < 5:
        hashes = [spark_hash(" ".join(w)) >> 1]
    else:
        h = [spark_hash(x) for x in w]
        hashes = [spark_hash(spark_hash(spark_hash(*h[i : i + 2]), spark_hash(*h[i + 2 : i + 4])), h[i + 4]) >> 1 for i in range(len(w) - 4)]
    least: dict[int, int] = {}
    for x in hashes:
        b = x >> 56
        least[b] = min(least.get(b, MASK), x)
    out = []
    for b in range(128):
        owner = b if b in least else next(k for k in orders[b] if k in least)
        out.append(f"{least[owner] & 255:02X}")
    return "".join(out)


def test_fingerprints_against_plain_version(spark):
    """Full and nearly empty fingerprints: texts of no word to 3,000 words."""
    r = random.Random(12)
    words = [f"Word{i}" for i in range(400)] + ["é", "\U0001f600", "ÀB"]
    texts = [None, "", " \n", "one", "A b C d", "a b c d e"] + [" ".join(r.choices(words, k=k)) for k in (6, 7, 9, 20, 60, 128, 300, 3000) for _ in range(4)]
    orders = fingerprint._probing_orders()
    assert all(sorted([*o, b]) == list(range(128)) for b, o in enumerate(orders))
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string").withColumn("text", F.coalesce("text", F.lit("")))
    got = {x.i: x.f.upper() for x in fingerprint.with_fingerprint(df, "text", "f").collect()}
    assert got == {i: plain_fingerprint(t, orders) for i, t in enumerate(texts)}


def spread(orders: list[list[int]]) -> float:
    """Relative deviation of how often the bins lend, over random sets of eight full bins."""
    r = random.Random(4)
    lent = [0] * 128
    for _ in range(1000):
        full = set(r.sample(range(128), 8))
        for b in set(range(128)) - full:
            lent[next(k for k in orders[b] if k in full)] += 1
    mean = sum(lent) / 128
    return (sum((x - mean) ** 2 for x in lent) / 128) ** 0.5 / mean


def test_empty_bins_borrow_as_evenly_as_by_random_permutations():
    r = random.Random(1)
    at_random = [spread([r.sample([k for k in range(128) if k != b], 127) for b in range(128)]) for _ in range(5)]
    assert spread(fingerprint._probing_orders()) <= max(at_random)
