"""The store's commit log: retries, concurrent writers, failed writers, migrations, rewrites."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from skarn.plans import history
from skarn.sources.commit_log import CommitLog, MigrationError


def rows(spark, *names, value=1):
    return spark.createDataFrame([(n, value) for n in names], "id string, value int")


def values(log):
    return sorted((r.id, r.value) for r in log.read()["main"].collect())


def test_appends_are_idempotent(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "s"), [])
    assert log.read() == {} and log.commits() == []
    assert log.append({"main": rows(spark, "a", "b", "b")}, "id", "main") == 1
    assert log.append({"main": rows(spark, "a", "b", value=2)}, "id", "main") is None
    assert log.append({"main": rows(spark, "b", "c", value=3)}, "id", "main") == 2
    assert values(log) == [("a", 1), ("b", 1), ("c", 3)]
    assert log.append({"main": rows(spark)}, "id", "main") is None
    assert [c["version"] for c in log.commits()] == [1, 2] and log.vacuum() == []


def test_two_writers_and_a_failed_one(spark, tmp_path):
    """Writers that started from the same commit: each key is there once, whoever was first."""
    folder = str(tmp_path / "s")
    CommitLog(spark, folder, []).append({"main": rows(spark, "x")}, "id", "main")
    late = CommitLog(spark, folder, [])
    put, met = late._put, []

    def overtaken(version, commit):
        if not met:
            met.append(CommitLog(spark, folder, []).append({"main": rows(spark, "a", "b", value=7)}, "id", "main"))
        return put(version, commit)

    late._put = overtaken
    assert late.append({"main": rows(spark, "b", "c", value=8)}, "id", "main") == 3 and met == [2]
    assert values(late) == [("a", 7), ("b", 7), ("c", 8), ("x", 1)]
    threads = [threading.Thread(target=lambda k=k: CommitLog(spark, folder, []).append({"main": rows(spark, "shared", f"own{k}")}, "id", "main")) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [i for i, _ in values(late)] == ["a", "b", "c", "own0", "own1", "own2", "own3", "shared", "x"]
    rows(spark, "lost").write.parquet(f"{folder}/data/main/txn=0123")  # a writer that never committed
    assert ("lost", 1) not in values(late) and late.vacuum() == ["data/main/txn=0123"]


def test_migrations_and_rewrite(spark, tmp_path):
    folder = str(tmp_path / "s")
    CommitLog(spark, folder, []).append({"main": rows(spark, "a")}, "id", "main")
    steps = [(2, lambda t: {"main": t["main"].withColumn("note", F.lit("two"))}), (5, lambda t: {"main": t["main"].withColumn("value", F.col("value") * 10), "more": t["main"].select("id")})]
    new = CommitLog(spark, folder, steps)
    added = rows(spark, "b", value=5).withColumn("note", F.lit("new"))
    assert new.append({"main": added, "more": added.select("id")}, "id", "main") == 2
    want = [("a", 10, "two"), ("b", 5, "new")]
    assert sorted(tuple(r) for r in new.read()["main"].collect()) == want and sorted(r.id for r in new.read()["more"].collect()) == ["a", "b"]
    assert new.rewrite() == 3 and [(c["version"], c["format"]) for c in new.commits()] == [(3, 5)]
    assert sorted(tuple(r) for r in new.read()["main"].collect()) == want and len(new.vacuum()) == 3
    assert new.append({"main": added}, "id", "main") is None
    for wrong in ([(2, None), (2, None)], [(3, None), (2, None)], [(0, None)]):
        with pytest.raises(MigrationError):
            CommitLog(spark, folder, wrong)


def run(spark, repo, day, findings):
    found = ", ".join(f"named_struct('kind', 'k', 'path', '{p}', 'start_line', 1, 'end_line', 2, 'summary', 's', 'identity', 'i')" for p in findings)
    empty = "CAST(array() AS array<struct<kind:string,path:string,start_line:int,end_line:int,summary:string,identity:string>>)"
    return spark.sql(f"""SELECT '{repo}' AS repo, timestamp'{day}' AS audited_at, 1 AS schema_version, '1' AS analyzer_version, 'v' AS scoring_version, 5L AS index, false AS partial, 'complete' AS completeness,
    array(named_struct('id', 'm', 'state', 'complete', 'value', 1.0D, 'reason', CAST(NULL AS string))) AS metrics, array(named_struct('dimension', 'd', 'score', 0.5D, 'points', 5L)) AS contributions, {f'array({found})' if found else empty} AS findings""")


def test_store_of_version_one(spark, tmp_path):
    """Runs by workspace without a log, a workspace named like a number: read after migration, added to, rewritten."""
    store = str(tmp_path / "runs")
    old = run(spark, "007", "2024-01-01 00:00:00", ["a.ts", "b.ts"]).unionByName(run(spark, "two", "2024-01-01 00:00:00", []))
    old.write.partitionBy("repo").parquet(store)
    read = lambda: sorted((r.repo, str(r.audited_at), [f.path for f in r.findings]) for r in history.load(spark, store).collect())
    want = [("007", "2024-01-01 00:00:00", ["a.ts", "b.ts"]), ("two", "2024-01-01 00:00:00", [])]
    assert read() == want
    assert history.append(old.unionByName(run(spark, "two", "2024-01-02 00:00:00", ["c.ts"])), store) == 1
    assert history.append(run(spark, "two", "2024-01-02 00:00:00", ["c.ts"]), store) is None
    want.append(("two", "2024-01-02 00:00:00", ["c.ts"]))
    assert read() == want and sorted((r.repo, r.path) for r in history.load_findings(spark, store).collect()) == [("007", "a.ts"), ("007", "b.ts"), ("two", "c.ts")]
    assert history.append(run(spark, "9", "2024-01-03 00:00:00", ["d.ts"]), store) == 2
    want.append(("9", "2024-01-03 00:00:00", ["d.ts"]))
    assert read() == sorted(want)
    want.sort()
    history.store_log(spark, store).rewrite("repo")
    assert read() == want
    assert [(r.repo, str(r.audited_at)) for r in history.latest_full(history.load_runs(spark, store)).orderBy("repo").collect()] == [("007", "2024-01-01 00:00:00"), ("9", "2024-01-03 00:00:00"), ("two", "2024-01-02 00:00:00")]
    assert history.load(spark, str(tmp_path / "none")).count() == 0
