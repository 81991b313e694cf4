"""Command line: audit, compare, fleet, report.  Exit codes: 0 fine, 1 an error, 2 a policy failed."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from skarn import client
from skarn.session import session


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skarn")
    verbs = top.add_subparsers(dest="verb", required=True)
    a = verbs.add_parser("audit", help="audit one workspace")
    a.add_argument("path")
    for flag in ("--config", "--baseline", "--store"):
        a.add_argument(flag)
    a.add_argument("--max-index", type=int)
    c = verbs.add_parser("compare", help="compare two reports")
    c.add_argument("baseline")
    c.add_argument("current")
    f = verbs.add_parser("fleet", help="audit the targets of a YAML or JSON file")
    f.add_argument("targets")
    f.add_argument("--store")
    r = verbs.add_parser("report", help="history of a store")
    r.add_argument("store")
    for flag in ("--repo", "--since"):
        r.add_argument(flag)
    for p in (a, c, f, r):
        style = p.add_mutually_exclusive_group()
        style.add_argument("--json", action="store_true")
        style.add_argument("--md", action="store_true")
        p.add_argument("--out")
    return top


def _emit(args, value, text) -> None:
    suffix = Path(args.out).suffix if args.out else ""
    as_json = args.json or (suffix == ".json" and not args.md)
    as_md = args.md or (suffix == ".md" and not args.json)
    shown = client.as_json(value) + "\n" if as_json else text(as_md)
    if args.out:
        Path(args.out).write_text(shown)
    else:
        sys.stdout.write(shown)


def _audit(spark, args) -> int:
    config = client.load_config(args.path, args.config)
    baseline = client.load_run(spark, args.baseline) if args.baseline else None
    run = client.audit(spark, args.path, config, args.store)
    policy = dict(config.get("policy", {}))
    if args.max_index is not None:
        policy["maxIndex"] = args.max_index
    results = client.assess(spark, run, baseline, policy) if policy else []
    _emit(args, run | {"policy": results}, lambda md: client.as_text(run, md) + "".join(f"{'- ' if md else ''}policy {r['policy']} {r['subject'] or ''} {r['status']} {r['code'] or ''}".rstrip() + "\n" for r in results))
    return 2 if any(r["status"] == "fail" for r in results) else 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        spark = session()
        if args.verb == "audit":
            return _audit(spark, args)
        if args.verb == "compare":
            changes = client.compare(spark, client.load_run(spark, args.baseline), client.load_run(spark, args.current))
            _emit(args, changes, lambda md: client.as_json(changes) + "\n")
        elif args.verb == "fleet":
            entries = client.run_fleet(spark, client.load_targets(args.targets), args.store)
            verdict = client.assess_fleet(entries)
            heads = [{k: e.get(k) for k in ("id", "ok", "error", "index_delta")} | {"index": e["run"]["index"] if e["ok"] else None} for e in entries]
            _emit(args, {"entries": heads, **verdict}, lambda md: "".join(f"{'- ' if md else ''}{h['id']}: {h['error'] or h['index']}\n" for h in heads))
            return 1 if any(not e["ok"] for e in entries) else 2 if verdict["failed"] else 0
        else:
            told = client.report(spark, args.store, args.repo, args.since)
            _emit(args, told, lambda md: "".join(f"{'- ' if md else ''}{s['repo']}: {s['index']} ({s['trend']})\n" for s in told["snapshot"]))
    except (OSError, ValueError, KeyError) as error:
        sys.stderr.write(f"error: {error}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
