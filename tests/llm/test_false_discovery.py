"""False-discovery control of the secret scan against a plain Benjamini-Hochberg procedure."""

from __future__ import annotations

import random
import string

from skarn.llm import secret_scan

ALPHABETS = ["0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"]
ENGLISH = "the quick river stone cloud apple and then over from with some other words that are not keys".split()


def texts() -> list[str]:
    r = random.Random(21)
    out = []
    for i in range(240):
        key = "".join(r.choices(ALPHABETS[i % 4], k=r.choice([24, 32, 40, 64, 100])))
        joined = r.choice(["", "-", "_"]).join(r.choices(ENGLISH, k=r.randint(5, 12)))
        camel = "".join(w.title() for w in r.choices(ENGLISH, k=6)) + str(r.randint(0, 99))
        out.append(" ".join(r.sample([key, joined, camel, "plain words"], r.randint(1, 4))))
    return [*out, "", "no runs here"]


def accepted(pairs: list[tuple[object, float]], q: float) -> set:
    """Candidates whose p-value is at most the largest p(k) with p(k) <= q k / m."""
    ranked = sorted(pairs, key=lambda x: x[1])
    passed = [p for k, (_, p) in enumerate(ranked, 1) if p <= q * k / len(ranked)]
    return {x for x, p in ranked if passed and p <= passed[-1]}


def test_thresholds_equal_plain_benjamini_hochberg(spark):
    all_texts = texts()
    df = spark.createDataFrame([(t,) for t in all_texts] + [(None,)], "text string").repartition(7)
    sizes = []
    for q in (0.0001, 0.01, 0.2):
        least = secret_scan.fit_thresholds(df, q=q)
        cells: dict = {}
        for i, t in enumerate(all_texts):
            for start, _, encoding, n, b in secret_scan.candidates(t):
                cells.setdefault((encoding, n), []).append(((i, start, b), 10 ** (-b / secret_scan.BINS_PER_DECADE)))
        assert set(least) == set(cells) and len(cells) > 4
        for cell, pairs in cells.items():
            want = accepted(pairs, q)
            assert {x for x, _ in pairs if x[2] >= least[cell]} == want
            sizes.append((len(want), len(pairs)))
    assert any(k for k, _ in sizes) and any(k < m for k, m in sizes)


def test_empty_table_has_no_thresholds(spark):
    assert secret_scan.fit_thresholds(spark.createDataFrame([], "text string")) == {}
