"""Findings of the fourth review."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from skarn.operators import clones
from skarn.plans import catalogue


def odd_documents() -> list[tuple]:
    rng = random.Random(5)
    line = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        a = rng.randrange(0, 30)
        words = [f"x{rng.randrange(4)}" for _ in range(rng.randrange(3))] + line[a : a + rng.randrange(18, 40)] + [f"y{rng.randrange(4)}" for _ in range(rng.randrange(3))]
        rows.append((i % 50 if i % 13 else None, "  ".join(words), [None, "en", "fr"][i % 3]))
    rows += [(100, "a " * 70, "en"), (101, "A\tb " * 40, "en"), (102, None, "en"), (103, "", "fr"), (104, "\u00e9\u4e16 " * 25, "fr"), (104, "\u00e9\u4e16 " * 25, "fr"), (105, " ".join(line[:20]), None)]
    return rows


@pytest.mark.parametrize("heavy", [5000, 2])
def test_context_counts_equal_sql_on_odd_rows(spark, tmp_path, monkeypatch, heavy):
    """Null languages and ids, ids twice, texts of one period, runs dealt by document (F3)."""
    monkeypatch.setattr(clones, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(clones, "HEAVY_PARTS", 10**9)
    rows = odd_documents()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["clone_context_count"](spark, str(tmp_path))
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(catalogue.oracle_sql()["clone_context_count"])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in got.collect())


def test_runs_of_one_anchor_cover_every_window_once():
    rng = np.random.default_rng(7)
    k = 20
    for kinds in (1, 2, 1000):
        sizes = [0, 19, 20, 21, 300, 5]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        code = rng.integers(0, kinds, offsets[-1]).astype(np.uint64)
        row, first, last, anchor, moves = clones.segments(code, offsets, np.arange(len(sizes)), k)
        covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
        assert covered.tolist() == [p for a, b in zip(offsets, offsets[1:], strict=False) for p in range(a, b - k + 1)]
        assert (row == np.searchsorted(offsets, first, side="right") - 1).all()
        for a, b, m in zip(first, last, moves, strict=True):
            assert m or len({tuple(code[p : p + k]) for p in range(a, b + 1)}) == b - a + 1
    assert len(first) < (offsets[-1] - 3 * k) / 4  # far fewer rows than windows


def test_near_duplicates_write_texts_in_columns(spark, monkeypatch):
    cut, kept = corpus_pipeline.checkpointed, []
    monkeypatch.setattr(corpus_pipeline, "checkpointed", lambda df: kept.append(df.columns) or cut(df))
    docs = spark.createDataFrame([(1, "a b c d e f", "en"), (None, "a b c d e f", "en"), (2, None, None), (1, "other words", "fr")], "doc_id bigint, text string, lang string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(2), "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a b c d e f", "en"), (1, "other words", "fr"), (2, None, None)]
    assert kept and not any("text" in x for x in kept)
