"""The calls that most users need: audit, compare, fleet, report, and how their results read as text."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from skarn.operators import safeguards, surfaces
from skarn.plans import audit as plan
from skarn.plans import comparison, history
from skarn.sources import workspace

CONFIG_NAMES = ("skarn.json", "skarn.yaml", "skarn.yml")
CONFIG_KEYS = {"source": {"exclude", "classify"}, "policy": {"maxIndex", "budgets", "failOnNew", "regression"}}
SOURCE_SETS = {"production", "test", "generated", "vendored", "declaration-only"}


def load_config(root: str, file: str | None = None) -> dict:
    """The configuration of a workspace; unknown keys and source sets are errors, no file is the default."""
    found = [Path(file)] if file else [p for p in (Path(root, n) for n in CONFIG_NAMES) if p.is_file()]
    if not found:
        return {}
    text = found[0].read_text()
    if found[0].suffix == ".json":
        config = json.loads(text)
    else:
        import yaml

        config = yaml.safe_load(text) or {}
    if not isinstance(config, dict):
        raise ValueError(f"invalid {found[0].name}: not an object")
    for section, fields in config.items():
        if section not in CONFIG_KEYS or not isinstance(fields, dict) or set(fields) - CONFIG_KEYS[section]:
            raise ValueError(f"invalid {found[0].name}: {section}")
    unknown = set(config.get("source", {}).get("classify", {}).values()) - SOURCE_SETS
    if unknown:
        raise ValueError(f"invalid {found[0].name}: source.classify {sorted(unknown)}")
    return config


def fleet(spark: SparkSession, roots: dict[str, str], config: dict | None = None, store: str | None = None, audited_at: str | None = None) -> DataFrame:
    """Runs of all workspaces in one plan; with ``store`` they are appended to it."""
    source = (config or {}).get("source", {})
    done = plan.audit(spark, roots, sorted(source.get("classify", {}).items()), source.get("exclude"))
    rows = history.runs(done, audited_at)
    if store:
        history.append(rows, store)
    return rows


def load_targets(file: str) -> list[dict]:
    """The targets of a fleet, from YAML or JSON: ``{"defaults": {"canonicalVersion"}, "targets": [{"id", "path",
    "config", "canonical"}]}``, or an object of names and paths.  Paths start at the file's folder; unknown keys
    and repeated ids are errors.  Each target has its canonical version, its own or the default."""
    import yaml

    stated = yaml.safe_load(Path(file).read_text())
    if isinstance(stated, dict) and stated and "targets" not in stated and all(isinstance(v, str) for v in stated.values()):
        stated = {"targets": [{"id": k, "path": v} for k, v in stated.items()]}
    if not isinstance(stated, dict) or set(stated) - {"defaults", "targets"} or not isinstance(stated.get("targets"), list) or not stated["targets"]:
        raise ValueError(f"invalid {Path(file).name}: no list of targets")
    defaults = stated.get("defaults") or {}
    if set(defaults) - {"canonicalVersion"}:
        raise ValueError(f"invalid {Path(file).name}: defaults")
    here, out = Path(file).resolve().parent, []
    for t in stated["targets"]:
        if not isinstance(t, dict) or set(t) - {"id", "path", "config", "canonical"} or not t.get("id") or not t.get("path") or set(t.get("canonical") or {}) - {"version", "allowedDeltas"}:
            raise ValueError(f"invalid {Path(file).name}: target {t}")
        canonical = {"version": defaults.get("canonicalVersion"), "allowedDeltas": []} | (t.get("canonical") or {})
        out.append({"id": t["id"], "path": str(here / t["path"]), "config": str(here / t["config"]) if t.get("config") else None, "canonical": canonical})
    repeated = sorted({t["id"] for t in out if sum(u["id"] == t["id"] for u in out) > 1})
    if repeated:
        raise ValueError(f"invalid {Path(file).name}: repeated target {repeated}")
    return out


def run_fleet(spark: SparkSession, targets: list[dict], store: str | None = None, audited_at: str | None = None) -> list[dict]:
    """One entry per target, in their order: id, path, ok, and either the error or the run with its policy
    results and its change since the store's last run on the same basis.  A target that fails stops no other;
    targets with equal source settings are one plan."""
    entries, plans = {}, {}
    audited_at = audited_at or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    for t in targets:
        try:
            if not Path(t["path"]).is_dir():
                raise FileNotFoundError("path not found or not a directory")
            config = load_config(t["path"], t.get("config"))
            plans.setdefault(json.dumps(config.get("source", {}), sort_keys=True), []).append((t, config))
        except (OSError, ValueError) as error:
            entries[t["id"]] = {"id": t["id"], "path": t["path"], "ok": False, "error": str(error)}
    kept = store is not None and Path(store).is_dir()
    previous = {r.repo: r.asDict(recursive=True) for r in history.latest_full(history.load(spark, store)).collect()} if kept else {}
    for members in plans.values():
        rows = fleet(spark, {t["id"]: t["path"] for t, _ in members}, members[0][1], store, audited_at)
        runs = {r.repo: r.asDict(recursive=True) for r in rows.collect()}
        for t, config in members:
            run, before = runs.get(t["id"]), previous.get(t["id"])
            if run is None:
                entries[t["id"]] = {"id": t["id"], "path": t["path"], "ok": False, "error": "unreadable"}
                continue
            same = before is not None and history.same_basis(before, run)
            policy = assess(spark, run, before, config["policy"]) if config.get("policy") else []
            entries[t["id"]] = {"id": t["id"], "path": t["path"], "ok": True, "run": run, "policy": policy, "previous_index": before["index"] if same else None, "index_delta": run["index"] - before["index"] if same else None}
    return [entries[t["id"]] for t in targets]


def assess_fleet(entries: list[dict]) -> dict:
    """Whether a fleet failed, with a reason for each target that couldn't be audited or whose policy failed."""
    reasons = [f"{e['id']}: {e['error']}" for e in entries if not e["ok"]]
    for e in entries:
        codes = [r["code"] for r in e.get("policy", []) if r["status"] == "fail"]
        if codes:
            reasons.append(f"{e['id']}: policy failed: {', '.join(codes)}")
    return {"failed": bool(reasons), "reasons": reasons}


def audit(spark: SparkSession, root: str, config: dict | None = None, store: str | None = None, repo: str | None = None) -> dict:
    """The run of one workspace as a plain object."""
    name = repo or Path(root).resolve().name
    if not Path(root).is_dir():
        raise FileNotFoundError(root)
    return fleet(spark, {name: root}, config if config is not None else load_config(root), store).first().asDict(recursive=True)


def run_frame(spark: SparkSession, run: dict) -> DataFrame:
    return spark.createDataFrame([run], history.RUN)


def compare(spark: SparkSession, baseline: dict, current: dict) -> dict:
    """Changes from one run to another; scores only where both have the same basis."""
    a, b = run_frame(spark, baseline | {"repo": "run"}), run_frame(spark, current | {"repo": "run"})
    gate = comparison.compatibility(a, b).first()
    out = {"compatible": gate.compatible, "issues": list(gate.issues)}
    if gate.compatible:
        out["index"] = {"baseline": baseline["index"], "current": current["index"], "delta": current["index"] - baseline["index"]}
        out["metrics"] = [r.asDict() for r in comparison.metric_deltas(a, b).where("changed").drop("repo", "changed").orderBy("id").collect()]
        out["findings"] = [r.asDict() for r in comparison.finding_changes(a, b).drop("repo").orderBy("status", "kind", "path", "line").collect()]
    return out


def assess(spark: SparkSession, current: dict, baseline: dict | None, policy: dict) -> list[dict]:
    """Results of the policies of a configuration."""
    r = policy.get("regression")
    regression = None if r is None else {"max_increase": r.get("maxIncrease"), "max_increase_percent": r.get("maxIncreasePercent")}
    before = None if baseline is None else run_frame(spark, baseline | {"repo": "run"})
    rows = comparison.assess(run_frame(spark, current | {"repo": "run"}), before, policy.get("maxIndex"), {k: v["max"] for k, v in policy.get("budgets", {}).items()}, regression, policy.get("failOnNew"))
    return [x.asDict() for x in rows.drop("repo").orderBy("policy", "subject").collect()]


def safeguard_levels(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """repo, safeguard, level of checks, hooks and budgets."""
    targets = workspace.targets(spark, roots)
    packages = workspace.packages(workspace.triage(workspace.listing(targets)))
    checks = safeguards.check_levels(targets, packages).withColumnRenamed("check", "safeguard")
    return checks.unionByName(surfaces.levels(targets, packages).drop("paths"))


def report(spark: SparkSession, store: str, repo: str | None = None, since: str | None = None) -> dict:
    """Latest runs and their trends, of all workspaces or one."""
    rows = history.load_runs(spark, store, repo, since)
    trends = {r.repo: r.trend for r in history.trend(rows).collect()}
    latest = history.snapshot(rows).orderBy("repo").collect()
    return {"scope": {"repo": repo, "since": since}, "snapshot": [r.asDict() | {"trend": trends.get(r.repo)} for r in latest]}


def as_json(value) -> str:
    return json.dumps(value, indent=2, default=str, sort_keys=False)


def as_text(run: dict, markdown: bool = False, limit: int = 10) -> str:
    """The headline, contributions, metrics and first findings of a run."""
    found = sorted(run["findings"], key=lambda f: (f["kind"], f["path"], f["start_line"]))
    number = lambda v: "-" if v is None else f"{v:g}"
    head = f"{run['repo']}: index {run['index']} of 100, lower is better{' (partial)' if run['partial'] else ''}, {run['completeness']}"
    if markdown:
        lines = [f"# {head}", "", "| dimension | points |", "|---|---|", *[f"| {c['dimension']} | {c['points']} |" for c in run["contributions"]]]
        lines += ["", "| metric | state | value |", "|---|---|---|", *[f"| {m['id']} | {m['state']} | {number(m['value'])} |" for m in run["metrics"]]]
        lines += ["", f"{len(found)} findings", "", *[f"- {f['kind']} {f['path']}:{f['start_line']} {f['summary']}" for f in found[:limit]]]
    else:
        lines = [head, *[f"  {c['dimension']:<20}{c['points']:>4}" for c in run["contributions"]], *[f"  {m['id']:<44}{m['state']:<16}{number(m['value']):>10}" for m in run["metrics"]]]
        lines += [f"findings: {len(found)}", *[f"  {f['kind']} {f['path']}:{f['start_line']} {f['summary']}" for f in found[:limit]]]
    if len(found) > limit:
        lines.append(f"{'- ' if markdown else '  '}+{len(found) - limit} more")
    return "\n".join(lines) + "\n"


def load_run(spark: SparkSession, file: str) -> dict:
    """A run that ``audit --json`` wrote, validated."""
    run = json.loads(Path(file).read_text())
    if not isinstance(run, dict) or run.get("schema_version") != history.SCHEMA_VERSION:
        raise ValueError(f"{file}: not a report of version {history.SCHEMA_VERSION}")
    ids = [m["id"] for m in run["metrics"]]
    if len(ids) != len(set(ids)):
        raise ValueError(f"{file}: repeated metric id")
    return run | {"audited_at": datetime.fromisoformat(run["audited_at"])}
