"""Ranks by narrowing histograms against sorting."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from skarn.operators import keyed, selection


def test_selected_equals_sorting(spark, monkeypatch):
    """Ties, nulls, NaN, infinities, signs, tiny and huge values, a key of nearly all rows, null keys."""
    monkeypatch.setattr(keyed, "HEAVY_ROWS", 100)
    r = random.Random(12)
    kinds = {
        "ties": [1.5] * 50 + [2.5] * 49,
        "odd": [None, None, float("nan"), float("inf"), float("-inf"), 0.0, -1.0, 1.0],
        "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(300)],
        "near": [1 + i * 2.0**-52 for i in r.choices(range(40), k=200)],
        "hot": [r.gauss(0, 1e6) for _ in range(3000)],
        "one": [7.25],
        None: [r.random() for _ in range(99)],
        "largest": [1.7976931348623157e308, 1.6e308, 1.2e308, 1.7e308, 1.5e308],
        "lowest": [5e-324, 1e-323, 1.5e-323, 2e-323],
    }
    rows = [(k, v) for k, values in kinds.items() for v in values]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    n = F.col("n")
    got = selection.selected(df, ["k"], "v", {"least": F.lit(0), "median": F.floor(n / 2), "p90": F.ceil(n * 0.9) - 1, "last": n - 1}).collect()
    assert len(got) == len(kinds)
    order = lambda v: (v is not None, v is not None and math.isnan(v), v if v is not None and not math.isnan(v) else 0)
    for row in got:
        values = sorted(kinds[row.k], key=order)
        want = [values[i] for i in (0, len(values) // 2, math.ceil(len(values) * 0.9) - 1, len(values) - 1)]
        assert row.n == len(values) and list(map(str, (row.least, row.median, row.p90, row.last))) == list(map(str, want)), row.k
    assert selection.selected(df.where(F.lit(False)), ["k"], "v", {"m": F.floor(n / 2)}).count() == 0
