"""Findings of the fifth review."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest

from skarn.functions import windows
from skarn.operators import agreement, clone_groups, clones
from skarn.plans import catalogue
from tests.test_whole import near_pairs


def odd_documents() -> list[tuple]:
    """Ids twice (in one language) and null ids, null languages, texts of one period, edited copies."""
    rng = random.Random(8)
    line = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(60):
        a = rng.randrange(0, 40)
        words = [f"x{rng.randrange(4)}" for _ in range(rng.randrange(3))] + line[a : a + rng.randrange(18, 50)] + [f"y{rng.randrange(4)}" for _ in range(rng.randrange(3))] + line[: rng.randrange(30)]
        rows.append((i % 45, "  ".join(words), [None, "en", "fr"][i % 3]))
    rows += [(None, " ".join(line[i : i + 30]), "en") for i in (0, 5, 50)]
    rows += [(100, "a " * 70, "en"), (101, "A\tb " * 40, "en"), (102, None, "en"), (103, "", "fr"), (104, "é世 " * 25, "fr"), (104, "é世 " * 25, "fr"), (105, "c " * 20, "en"), (106, " ".join(line[:20]), None)]
    return rows


def test_runs_equal_sql_on_odd_rows(spark, tmp_path):
    rows = odd_documents()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["clone_runs"](spark, str(tmp_path))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang"]).astype({"doc_id": "Int64"}))
    want = con.execute(catalogue.oracle_sql()["clone_runs"])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in got.collect())


def test_windows_of_copies_are_not_counted_one_by_one(spark, monkeypatch):
    """Runs that agree everywhere need no windows (F1, F3)."""
    rng = random.Random(2)
    copied = [f"c{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join([*copied, *(f"u{i}x{j}" for j in range(300))]), "en") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    counted, cut = [], clones.open_windows
    monkeypatch.setattr(clones, "open_windows", lambda *a: counted.append(cut(*a)) or counted[-1])
    words = catalogue.words()
    got = clones.repeated_spans(docs, "doc_id", "lang", words, 20)
    assert sorted(map(tuple, got.collect())) == [(i, "en", 0, 400) for i in range(30)]
    texts = docs.select(docs.doc_id.alias("doc"), docs.doc_id.alias("scope") * 0, windows.codes(words).alias("codes")).toDF("doc", "scope", "codes")
    assert {(r.start, r.end) for r in clone_groups.maximal_repeats(texts, 20).collect()} == {(0, 400)}
    assert len(counted) == 2 and all(x.count() < 30 * 40 for x in counted)  # of 30 * 381 repeated windows, those at the edge


def test_few_pairs_of_anchors_are_made(spark):
    """Lines in any order: runs of a level are at most twice as long as its windows (F1)."""
    rng = random.Random(3)
    lines = [[rng.randrange(10**6) for _ in range(6)] for _ in range(40)]
    files = [("r", "s", f"f{i}", [t for _ in range(120) for t in rng.choice(lines)]) for i in range(12)]
    docs = spark.createDataFrame([(i, 0, f[3]) for i, f in enumerate(files)], "doc bigint, scope bigint, kinds array<int>")
    texts = docs.select("doc", "scope", windows.codes(docs.kinds).alias("codes"))
    assert clone_groups.candidate_runs(texts, 8).count() < 1500  # 2,140 at four times


@pytest.mark.parametrize("block", [1024, 30, 1])
def test_near_sets_with_rare_and_common_items(spark, monkeypatch, block):
    """Slots only, slots and blocks, blocks only; many sites of one set; names for sites (F2)."""
    monkeypatch.setattr(agreement, "BLOCK", block)
    rng = random.Random(11)
    sets = {f"s{i:03}": {f"i{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(1, 9))} for i in range(150)}
    sets |= {f"t{i:02}": {"i1", "i2", "rare"} for i in range(40)} | {"u": {"i1", "i2", "rare", "rarer"}}
    df = spark.createDataFrame([(s, x) for s, items in sets.items() for x in items], "site string, item string").repartition(3)
    got = sorted(map(tuple, agreement.near_sets(df).collect()))
    assert got == near_pairs(sets) and len(got) > 200


def test_pairs_of_near_sets_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, f"x{k}") for i in range(6) for k in range(i, i + 5)], "site bigint, item string")
    plan = agreement.near_sets(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" in plan and "Join" not in plan[: plan.index("InArrow")]
