"""Findings of the third review."""

from __future__ import annotations

import pyarrow as pa

from skarn.functions import windows
from skarn.llm import hmm, jaccard, text
from skarn.operators import agreement, clone_groups, graph, reachability
from skarn.plans import structure

SF = "/root/testdata/sf0.001"


def test_modules_import_what_they_call(monkeypatch):
    """As in a worker in which nothing else has imported pyarrow.compute (making an array of lists does, by way of pandas)."""
    lists, texts = pa.array([[1, 2], [3]], pa.list_(pa.int64())), pa.array(["a b", "c"], pa.large_string())
    monkeypatch.delattr(pa, "compute", raising=False)
    assert [x[:2] for x in windows.parts(lists)] == [(0, 2)]
    assert [a for a, _ in text.slices(texts)] == [0]


def test_arrow_words_are_those_of_the_contract():
    texts = ["", None, " a  B\x0b\x0c c\x1f d\x85e F ", "\t\n", "ÄÖ İx y", "one"]
    for kind in (pa.string(), pa.large_string()):
        words, sizes = hmm.words_in(pa.array(texts, kind))
        assert words.to_pylist() == [w for x in texts for w in text.words_of(x)] and sizes.tolist() == [len(text.words_of(x)) for x in texts]


def test_counting_tokens_takes_little_memory(monkeypatch):
    """All tokens different, so every task holds HELD of them: what it takes beyond that is less than three times as much."""
    import tracemalloc

    n = 400
    rows = pa.table({"i": pa.array(range(n), pa.int64()), "t": [" ".join(f"a{i}b{k}" for k in range(600)) for i in range(n)]})
    monkeypatch.setattr(jaccard, "HELD", 1 << 17)
    monkeypatch.setattr(jaccard, "checkpointed", lambda df: df)
    jaccard.word_hashes(pa.array(["x"]))
    counters = []

    class Texts:
        def mapInArrow(self, count, schema):  # noqa: N802
            counters.append(count)
            raise StopIteration

    try:
        jaccard.frequent_tokens(Texts(), 3)
    except StopIteration:
        pass
    tracemalloc.start()
    out = list(counters[0](iter(rows.to_batches(max_chunksize=20))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[-1].column(1)[-1].as_py() == n * 598
    assert peak < 3 * 16 * (1 << 17)


def test_large_steps_are_written_in_columns(spark):
    """A checkpoint holds whole rows without compression."""
    for df in (structure.registry(spark, SF)[0], structure.part_imports(spark, SF)):
        assert "ExistingRDD" not in df._jdf.queryExecution().toString()


def test_refusals_ask_for_no_closure(spark, monkeypatch):
    monkeypatch.setattr(graph, "reach", None)
    assert structure.prerequisite_refusals(spark, SF).count()


def test_candidates_reach_once(spark, monkeypatch):
    calls, reached = [], reachability.reached
    monkeypatch.setattr(reachability, "reached", lambda *a: calls.append(a) or reached(*a))
    assert structure.unused_candidates(spark, SF).count() and len(calls) == 1


def test_near_sets_and_clone_members_are_written_in_columns(spark):
    rows = spark.createDataFrame([(i, f"x{k}") for i in range(6) for k in range(i, i + 5)], "site bigint, item string")
    files = spark.createDataFrame([("r", "s", p, list("abcdabcd"), [1] * 8, [3] * 8) for p in "pq"], "repo string, source_set string, path string, kinds array<string>, start_lines array<int>, end_lines array<int>")
    for df in (agreement.near_sets(rows), clone_groups.clone_members(files, least=4)):
        assert df.count() and "ExistingRDD" not in df._jdf.queryExecution().toString()
