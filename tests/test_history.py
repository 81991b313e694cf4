"""Stored runs, comparison, policies, the command line, the feed, and safeguards."""

from __future__ import annotations

import json

import pytest

from skarn import client
from skarn.__main__ import main
from skarn.operators import safeguards
from skarn.plans import comparison, history
from skarn.sources import workspace
from skarn.streaming import feed


def branches(n: int) -> str:
    return "export function f(x: number) {\n" + "".join(f"  if (x === {i}) {{\n    return {i};\n  }}\n" for i in range(n)) + "  return -1;\n}\n"


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("history")
    for name, n in (("calm", 2), ("busy", 12)):
        (root / name / "src").mkdir(parents=True)
        (root / name / "src" / "f.ts").write_text(branches(n))
    store = str(root / "store")
    roots = {k: str(root / k) for k in ("calm", "busy")}
    client.fleet(spark, roots, store=store, audited_at="2024-01-01 00:00:00")
    (root / "calm" / "src" / "f.ts").write_text(branches(12))
    client.fleet(spark, roots, store=store, audited_at="2024-01-02 12:00:00")
    return root, store


def test_history(spark, place):
    told = client.report(spark, place[1])
    by = {s["repo"]: s for s in told["snapshot"]}
    assert by["busy"]["delta"] == 0 and by["busy"]["trend"] == str(by["busy"]["index"])
    assert by["calm"]["previous"] == 0 and by["calm"]["index"] == by["busy"]["index"] > 0
    assert by["calm"]["trend"] == f"0 → {by['calm']['index']}"
    only = client.report(spark, place[1], "calm", "2024-01-02 00:00:00")["snapshot"]
    assert [(s["repo"], s["previous"]) for s in only] == [("calm", None)]


def test_comparison_and_policies(spark, place):
    rows = history.load(spark, place[1])
    before, after = rows.where("audited_at < '2024-01-02'"), rows.where("audited_at >= '2024-01-02'")
    changed = {(r.repo, r.id): r.delta for r in comparison.metric_deltas(before, after).where("changed").collect()}
    assert changed["calm", "complexity.cc.max.production"] == 10
    assert not any(repo == "busy" for repo, _ in changed)
    found = {(r.repo, r.kind, r.status) for r in comparison.finding_changes(before, after).collect()}
    kinds = ("complexity.hotspot", "duplication.clone-group")  # a long run of equal branches repeats itself
    assert found == {("busy", k, "persistent") for k in kinds} | {("calm", k, "new") for k in kinds}
    results = {(r.repo, r.policy, r.subject): (r.status, r.code) for r in comparison.assess(after, before, 10, {"complexity.cc.max.production": 13, "no.such": 1, "complexity.cc.max.test": 1}, {}, ["complexity.hotspot"]).collect()}
    assert results["calm", "score-regression", None] == ("fail", "regression-exceeds-absolute")
    assert results["busy", "score-regression", None] == ("pass", None)
    assert results["calm", "new-findings", "complexity.hotspot"] == ("fail", "new-finding")
    assert results["busy", "new-findings", "complexity.hotspot"] == ("pass", None)
    assert results["calm", "metric-budget", "complexity.cc.max.production"] == ("pass", None)
    assert results["calm", "metric-budget", "no.such"] == ("fail", "budget-metric-unknown")
    assert results["calm", "metric-budget", "complexity.cc.max.test"] == ("skipped", "budget-metric-unevaluable")
    assert results["busy", "max-index", None] == ("fail", "index-exceeds-max")
    absent = {r.code for r in comparison.assess(after, None, regression={}, fail_on_new=["import-cycle"]).collect()}
    assert absent == {"baseline-absent"}
    old = before.withColumn("scoring_version", history.F.lit("0"))
    assert {r.code for r in comparison.assess(after, old, regression={}).collect()} == {"baseline-incompatible"}


def test_reports_as_json(spark, place, tmp_path):
    rows = history.load(spark, place[1])
    history.write_reports(rows, str(tmp_path / "json"))
    back = history.load_reports(spark, str(tmp_path / "json"))
    key = lambda r: (r["repo"], r["audited_at"])
    columns = [f.name for f in back.schema]
    assert sorted((r.asDict(True) for r in back.collect()), key=key) == sorted((r.asDict(True) for r in rows.select(columns).collect()), key=key)
    (tmp_path / "bad.json").write_text('{"repo": "x", "schema_version": 9, "metrics": []}\n')
    with pytest.raises(Exception, match="not a valid report"):
        history.load_reports(spark, str(tmp_path / "bad.json")).collect()


def test_command_line(spark, place, tmp_path, capsys):
    root, store = place
    one, two = str(tmp_path / "one.json"), str(tmp_path / "two.md")
    assert main(["audit", str(root / "busy"), "--out", one]) == 0
    assert main(["audit", str(root / "busy"), "--out", two, "--max-index", "5", "--baseline", one]) == 2
    assert "index-exceeds-max" in (tmp_path / "two.md").read_text()
    assert main(["compare", one, one, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["index"]["delta"] == 0
    assert main(["audit", str(root / "nowhere")]) == 1
    (root / "targets.json").write_text('{"busy": "busy", "gone": "gone"}')
    assert main(["fleet", str(root / "targets.json")]) == 1
    assert "gone: path not found or not a directory" in capsys.readouterr().out
    assert main(["report", store, "--repo", "calm"]) == 0


def test_feed(spark, place, tmp_path):
    days = feed.index_by_day(feed.run_stream(spark, place[1]), "0 seconds")
    q = days.writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    # the last day stays open
    assert {(r.repo, str(r.day.date()), r.runs) for r in spark.table("days").collect()} == {("busy", "2024-01-01", 1), ("calm", "2024-01-01", 1)}


def test_safeguards(spark, tmp_path):
    (tmp_path / ".github" / "workflows").mkdir(parents=True)
    (tmp_path / ".github" / "workflows" / "ci.yml").write_text("jobs:\n  a:\n    steps:\n      - run: |\n          npm run all\n          echo ok\n      - run: npx vitest\n      - uses: x/y@v1\n")
    (tmp_path / "package.json").write_text(json.dumps({"scripts": {"all": "npm run lint && echo", "lint": "eslint src/x.ts", "types": "tsc --noEmit", "build": "tsc", "hook": "node ./tools/gone.js"}}))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.ts").write_text("export {};\n")
    targets = workspace.targets(spark, {"r": str(tmp_path)})
    entries = workspace.triage(workspace.listing(targets))
    packages = workspace.packages(entries)
    assert {(r.workflow, r.line, r.command) for r in safeguards.workflow_commands(targets).collect()} == {(".github/workflows/ci.yml", 5, "npm run all"), (".github/workflows/ci.yml", 6, "echo ok"), (".github/workflows/ci.yml", 7, "npx vitest")}
    assert {(r.check, r.level) for r in safeguards.check_levels(targets, packages).collect()} == {("lint", "structurally-wired"), ("typecheck", "configured"), ("test", "absent")}
    assert [(r.name, r.missing) for r in safeguards.broken_paths(targets, packages, entries).collect()] == [("hook", "tools/gone.js")]
