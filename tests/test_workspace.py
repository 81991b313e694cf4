"""Declared packages, inherited compiler configurations, unreadable folders, fleets, and wired hooks and budgets."""

from __future__ import annotations

import json
import os

import pytest

from skarn import client
from skarn.operators import surfaces
from skarn.plans import audit
from skarn.sources import workspace


def put(root, path, text):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text if isinstance(text, str) else json.dumps(text))


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("declared")
    put(root, "w/package.json", {"name": "w", "workspaces": {"packages": ["packages/*", 7, "!packages/old"]}})
    put(root, "w/pnpm-workspace.yaml", "packages:\n  - 'apps/**'\n")
    for name in ("packages/a", "packages/old", "apps/x/y", "tools/t"):
        put(root, f"w/{name}/package.json", {"name": name.replace("/", "-")})
    put(root, "w/node_modules/base/tsconfig.json", {"compilerOptions": {"baseUrl": ".", "paths": {"#gone/*": ["./gone/*"]}}})
    put(root, "w/tsconfig.shared.json", '{ // shared\n "extends": "./tsconfig.json", "compilerOptions": {"paths": {"#lib/*": ["./lib/*"]},},}')
    put(root, "w/tsconfig.json", {"extends": ["base", "./missing", "./tsconfig.shared"], "compilerOptions": {"baseUrl": "./src"}})
    put(root, "w/packages/a/tsconfig.json", {"extends": "../../tsconfig.shared.json"})
    put(root, "w/src/lib/one.ts", "export const one = 1;\n")
    put(root, "w/src/main.ts", "import { one } from '#lib/one';\nimport { two } from 'lib/one';\nimport x from '#gone/x';\nexport const m = one + two;\n")
    put(root, "w/lib/two.ts", "export const two = 2;\n")
    put(root, "w/packages/a/i.ts", "import { two } from '#lib/two';\nexport const a = two;\n")
    return audit.audit(spark, {"w": str(root / "w"), "nowhere": str(root / "nowhere")})


def test_declared_packages(done):
    globs = workspace.workspace_globs(done.entries, done.packages)
    assert {(r.glob, r.negative) for r in globs.collect()} == {("packages/*", False), ("!packages/old", True), ("apps/**", False)}
    got = {r.directory: r.declared for r in workspace.declared(done.packages.where("repo = 'w'"), globs).collect()}
    assert got == {".": True, "packages/a": True, "packages/old": False, "apps/x/y": True, "tools/t": False}


def test_inherited_mappings(done):
    got = {(r.path, r.specifier): (r.status, r.target or r.package_name) for r in done.edges.collect()}
    assert got == {
        ("src/main.ts", "#lib/one"): ("local", "src/lib/one.ts"),
        ("src/main.ts", "lib/one"): ("local", "src/lib/one.ts"),
        ("src/main.ts", "#gone/x"): ("external", "#gone"),
        # through the shared file and the root's own one, whose base is src: src/lib/two isn't there
        ("packages/a/i.ts", "#lib/two"): ("unresolved", None),
    }


def test_mappings_start_where_stated(tmp_path):
    put(tmp_path, "base.json", {"compilerOptions": {"paths": {"a": ["./x"]}}})
    put(tmp_path, "deep/tsconfig.json", {"extends": "../base"})
    read = lambda path: workspace._effective(str(tmp_path), path, (tmp_path / path).read_text())
    assert read("deep/tsconfig.json") == {"paths": {"a": ["./x"]}, "stated_in": "."}
    put(tmp_path, "deep/own.json", {"extends": "./tsconfig.json", "compilerOptions": {"baseUrl": "lib"}})
    assert read("deep/own.json") == {"paths": {"a": ["./x"]}, "stated_in": ".", "base": "deep/lib"}
    put(tmp_path, "loop.json", {"extends": "./loop.json", "compilerOptions": {"paths": {}}})
    assert read("loop.json") == {"paths": {}, "stated_in": "."}
    put(tmp_path, "out.json", {"extends": "../../etc/passwd"})
    assert read("out.json") == {}


def test_unreadable_root_stops_no_other(done):
    assert [(r.path, r.ignored) for r in done.entries.where("repo = 'nowhere'").collect()] == [(".", "unreadable")]
    assert {r.repo for r in done.metrics.select("repo").distinct().collect()} == {"w"}
    assert {r.repo for r in audit.run_rows(done).collect()} == {"w"}


def test_unreadable_folder(monkeypatch, tmp_path):
    put(tmp_path, "a/x.ts", "")
    put(tmp_path, "b/y.ts", "")
    scan = os.scandir

    def refusing(path):
        if str(path).endswith("/a"):
            raise PermissionError(path)
        return scan(path)

    monkeypatch.setattr(os, "scandir", refusing)
    assert [r[2:] for r in workspace._list("r", str(tmp_path))] == [("b/y.ts", None), ("a", "unreadable")]


def test_unreadable_folder_makes_metrics_incomplete(spark):
    metrics = spark.createDataFrame([("r", "a", "complete", 1.0, None), ("r", "b", "not-applicable", None, None), ("s", "a", "complete", 1.0, None)], "repo string, id string, state string, value double, reason string")
    entries = spark.createDataFrame([("r", "a", "unreadable"), ("s", "b", None)], "repo string, path string, ignored string")
    got = {(r.repo, r.id): (r.state, r.reason) for r in audit.unlisted(metrics, entries).collect()}
    assert got == {("r", "a"): ("incomplete", "1 folder(s) could not be read"), ("r", "b"): ("not-applicable", None), ("s", "a"): ("complete", None)}


def test_fleet(spark, tmp_path):
    put(tmp_path, "fine/f.ts", "export const f = 1;\n")
    put(tmp_path, "strict/f.ts", "export function f(x: number) {\n" + "".join(f"  if (x === {i}) {{\n    return {i};\n  }}\n" for i in range(12)) + "  return -1;\n}\n")
    put(tmp_path, "strict/skarn.json", {"policy": {"maxIndex": 1}})
    put(tmp_path, "odd/skarn.json", {"nonsense": {}})
    put(tmp_path, "fleet.yaml", "defaults: {canonicalVersion: 1.2.0}\ntargets:\n- {id: fine, path: fine}\n- {id: odd, path: odd}\n- {id: strict, path: strict, canonical: {version: 2.0.0}}\n- {id: gone, path: gone}\n")
    targets = client.load_targets(str(tmp_path / "fleet.yaml"))
    assert [(t["id"], t["canonical"]["version"]) for t in targets] == [("fine", "1.2.0"), ("odd", "1.2.0"), ("strict", "2.0.0"), ("gone", "1.2.0")]
    store = str(tmp_path / "store")
    first = client.run_fleet(spark, targets, store)
    assert [(e["id"], e["ok"], e.get("previous_index")) for e in first] == [("fine", True, None), ("odd", False, None), ("strict", True, None), ("gone", False, None)]
    verdict = client.assess_fleet(first)
    assert verdict["failed"] and [r.split(":")[0] for r in verdict["reasons"]] == ["odd", "gone", "strict"]
    again = client.run_fleet(spark, targets[:1], store)
    assert again[0]["previous_index"] == first[0]["run"]["index"] and again[0]["index_delta"] == 0
    assert client.assess_fleet(again) == {"failed": False, "reasons": []}
    for text in ("targets: []", "targets: [{id: a, path: a}, {id: a, path: b}]", "targets: [{id: a, path: a, more: 1}]", "other: 1"):
        (tmp_path / "bad.yaml").write_text(text)
        with pytest.raises(ValueError, match="invalid"):
            client.load_targets(str(tmp_path / "bad.yaml"))


def test_surfaces(spark, tmp_path):
    put(tmp_path, "a/package.json", {"scripts": {"prepare": "husky", "cov": "node check.js scripts/coverage-budgets.json", "all": "npm run cov", "hooks": "git config core.hooksPath ./hooks/"}})
    put(tmp_path, "a/.github/workflows/ci.yml", "steps:\n  - run: npm run all\n  - uses: pre-commit/action@v3\n")
    put(tmp_path, "a/.husky/pre-commit", "x")
    put(tmp_path, "a/scripts/coverage-budgets.json", "{}")
    put(tmp_path, "a/.jscpd.json", "{}")
    put(tmp_path, "a/coverage-budgets.json", "not json")
    put(tmp_path, "a/check.sh", "")
    put(tmp_path, "a/.claude/settings.json", {"hooks": {"Pre": [{"matcher": "x", "hooks": [{"command": "bash tools/run.sh"}, {"command": "echo hi"}]}]}})
    put(tmp_path, "a/tools/run.sh", "")
    put(tmp_path, "b/package.json", {"husky": {}, "jscpd": {}, "scripts": {"dup": "jscpd ."}})
    put(tmp_path, "b/.pre-commit-config.yaml", "[: bad")
    put(tmp_path, "b/file-size-budgets.json", "nope")
    put(tmp_path, "b/jest.config.js", "")
    put(tmp_path, "b/.claude/settings.json", {"hooks": {"Pre": [{"hooks": [{"command": "bash tools/gone.sh"}]}]}})
    put(tmp_path, "c/.pre-commit-config.yaml", "repos: []\n")
    put(tmp_path, "c/.github/workflows/ci.yml", "  - uses: pre-commit/action@v3\n")
    put(tmp_path, "c/.claude/settings.json", "{}")
    put(tmp_path, "d/.claude/settings.json", "[")
    targets = workspace.targets(spark, {k: str(tmp_path / k) for k in "abcd"})
    packages = workspace.packages(workspace.triage(workspace.listing(targets)))
    got = {(r.repo, r.safeguard): r.level for r in surfaces.levels(targets, packages).collect()}
    level = lambda s: [got[r, s] for r in "abcd"]
    assert len(got) == 20
    assert level("git-hooks") == ["structurally-wired", "configured", "structurally-wired", "absent"]
    assert level("agent-hooks") == ["structurally-wired", "configured", "absent", "unknown"]
    assert level("coverage-budget") == ["structurally-wired", "unknown", "absent", "absent"]
    assert level("file-size-budget") == ["absent", "unknown", "absent", "absent"]
    assert level("duplication-budget") == ["configured", "configured", "absent", "absent"]
