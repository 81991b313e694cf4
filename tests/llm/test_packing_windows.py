"""Every full window is the programme's best fill, closed by one cut at most, however the documents are dealt."""

from __future__ import annotations

import random
from collections import Counter

from skarn.llm import packing


def best_sum(lengths, first, capacity):
    """The largest sum up to ``capacity`` of ``first`` and some of the others, by all sums."""
    others = list(lengths)
    others.remove(first)
    sums = {first}
    for n in others:
        sums |= {s + n for s in sums if s + n <= capacity}
    return max(sums)


def test_windows_are_best_fills():
    r = random.Random(1)
    for _ in range(300):
        capacity = r.choice([10, 37, 64])
        lengths = [r.randint(1, capacity - 1) for _ in range(r.randint(0, 25))]
        remaining, held = dict(Counter(lengths)), list(lengths)
        for window, closing, gap in packing.minimum_slack(remaining, capacity):
            assert max(window) == max(held) and sum(window) == best_sum(held, max(held), capacity) and sum(window) + gap == capacity
            for n in window:
                held.remove(n)
            if closing:
                assert 0 < gap < closing and closing == max(held)
                held.remove(closing)
                held.append(closing - gap)
        assert sum(held) < capacity and Counter(held) == Counter({n: c for n, c in remaining.items() if c})


def test_few_documents_a_task(spark):
    """64 tasks of 15 documents: no padding, at most one piece a window that goes on in another, and what isn't in a full
    window is less than one in each task."""
    from skarn.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(64)
    pieces = packing.pack_documents(docs, queries.tokenizer_path()).collect()
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append(p)
    full, rest = 0, Counter()
    for number, held in windows.items():
        total = sum(p.length for p in held)
        assert total & (total - 1) == 0 and total <= packing.CAPACITY
        assert sorted(p.offset for p in held) == [sum(q.length for q in held if q.offset < p.offset) for p in sorted(held, key=lambda p: p.offset)]
        if total == packing.CAPACITY:
            full += 1
            assert sum((p.start + p.length) % packing.CAPACITY != 0 and p.start + p.length < p.doc_tokens for p in held) <= 1
        else:
            rest[number >> 36] += total
    assert full > 100 and all(n < packing.CAPACITY for n in rest.values())
    assert sum(p.length for p in pieces) == sum({(p.doc_id, p.doc_tokens) for p in pieces} and [p.doc_tokens for p in pieces if p.start == 0])
