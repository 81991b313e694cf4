"""The front-end and the audit on small workspaces written here, and clone groups against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skarn.operators import syntax
from skarn.plans import audit
from skarn.sources import typescript, workspace

COPY = """export function {name}({a}: number[], {b}: number): number {{
  let total = 0;
  for (const item of {a}) {{
    if (item > 10 && item < 90) {{
      total = total + item * {b};
    }} else if (item >= 90) {{
      total = total + item * 2 - {b};
    }} else {{
      total = total - item / 3 + {b};
    }}
  }}
  const scaled = total * 100 + {b} * 7;
  const rounded = Math.round(scaled / 10) * 10;
  const shifted = rounded - (scaled % 10) + {b};
  return shifted > 0 ? shifted : rounded;
}}
"""


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("function f(a?: string) { if (a) { return a?.length ?? 0; } return 1; }", [("f", 4, 1)]),
        ("const g = (x: number): string => x > 1 ? 'a' : 'b';", [("g", 2, 0)]),
        ("type T = (a: string) => void;\ninterface I { run(a: () => void): void }\nexport const v: T = () => {};", [("v", 1, 0)]),
        ("class A { constructor(private x: number) {}\n get v(): number { return this.x || 1; }\n m<T>(t: T): Promise<T> { try { return p(t); } catch { throw t; } } }", [("constructor", 1, 0), ("v", 2, 0), ("m", 2, 1)]),
        ("function o(a: string): void;\nfunction o(a: number): void;\nfunction o(a: any) { do { a++; } while (a < 3 || a > 9); }", [("o", 3, 1)]),
        ("const o = { run(a: number) { switch (a) { case 1: return 2; default: return 3; } }, key: function () {} };", [("run", 2, 1), ("key", 1, 0)]),
        ("function outer() { const inner = () => { if (1) { while (2) {} } }; return inner; }", [("outer", 1, 0), ("inner", 3, 2)]),
        ("const s = `a${b ? `c${d && e}` : 'f'}g`; const r = /[/]\"/.test(s);", []),
        ("", []),
        (None, []),
    ],
)
def test_functions(text, expected):
    facts = typescript.analyse(text)
    assert [(f["name"], f["cc"], f["nesting"]) for f in facts["functions"]] == expected
    assert facts["problems"] == []


def test_imports_and_lines():
    text = "import a, { b } from './a';\nimport type { C } from \"c\";\nexport * from './d.js';\n// note\n\nconst e = await import('node:fs'), f = await import(x);\nlet g: import('./t').T;\nimport './side';\nexport { h };\n"
    facts = typescript.analyse(text)
    assert [(i["kind"], i["type_only"], i["specifier"]) for i in facts["imports"]] == [("import", False, "./a"), ("import", True, "c"), ("re-export", False, "./d.js"), ("dynamic", False, "node:fs"), ("dynamic", False, None), ("import", True, "./t"), ("import", False, "./side")]
    assert (facts["total_lines"], len(facts["code_lines"]), facts["comment_only"]) == (10, 7, 1)


@pytest.mark.parametrize("text", ["const a = ;", "function f( {", "let s = `x", "}"])
def test_problems(text):
    assert typescript.analyse(text)["problems"]


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("workspaces")

    def put(path, text):
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("one/package.json", '{"name": "one", "workspaces": ["packages/*"]}')
    put("one/tsconfig.json", '{ // mappings\n "compilerOptions": {"paths": {"@lib/*": ["./src/lib/*"], "@gone/*": ["./gone/*"],},}}')
    put("one/src/a.ts", COPY.format(name="first", a="items", b="rate") + "import { second } from './lib/b.js';\nimport u from '@one/util/deep';\nimport x from '@gone/x';\nimport fs from 'node:fs';\nimport z from 'zod/v4';\nimport data from './data.json';\nimport up from '../../../out';\n")
    put("one/src/lib/b.ts", COPY.format(name="second", a="values", b="factor") + "import type { first } from '../a';\nimport { third } from '@lib/c';\n")
    put("one/src/lib/c.ts", "export { second } from './b';\nexport const third = 3;\n")
    put("one/src/data.json", "{}")
    put("one/packages/util/package.json", '{"name": "@one/util", "exports": {".": "./index.ts", "./*": {"import": "./src/*.ts"}}}')
    put("one/packages/util/src/deep.ts", "export default 1;\n")
    put("one/packages/docs/package.json", "not json")
    put("one/packages/docs/run.py", "pass\n")
    put("one/dist/a.ts", "export {};\n")
    put("one/node_modules/m/i.ts", "export {};\n")
    put("one/.cache/i.ts", "export {};\n")
    put("one/src/__tests__/a.ts", "export const t = 1;\n")
    put("two/bad.ts", "export const nope = ;\n")
    put("two/empty.ts", "")
    return audit.audit(spark, {"one": str(root / "one"), "two": str(root / "two")})


def test_discovery(done):
    files = {(r.path, r.source_set, r.package_path) for r in done.files.where("repo = 'one'").collect()}
    assert files == {("src/a.ts", "production", "."), ("src/lib/b.ts", "production", "."), ("src/lib/c.ts", "production", "."), ("src/__tests__/a.ts", "test", "."), ("packages/util/src/deep.ts", "production", "packages/util")}
    status = {r.path: r.status for r in done.entries.where("repo = 'one'").collect()}
    assert (status["dist/a.ts"], status["node_modules"], status[".cache"], status["packages/docs/run.py"]) == ("excluded", "ignored", "ignored", "unsupported")
    assert {(r.repo, r.directory) for r in workspace.unsupported_packages(done.files, done.packages).collect()} == {("one", "packages/docs")}


def test_resolution(done):
    got = {(r.path, r.specifier): (r.status, r.target or r.package_name or r.reason) for r in done.edges.collect()}
    assert got == {
        ("src/a.ts", "./lib/b.js"): ("local", "src/lib/b.ts"),
        ("src/a.ts", "@one/util/deep"): ("local", "packages/util/src/deep.ts"),
        ("src/a.ts", "@gone/x"): ("unresolved", "no-target"),
        ("src/a.ts", "node:fs"): ("external", "node:fs"),
        ("src/a.ts", "zod/v4"): ("external", "zod"),
        ("src/a.ts", "./data.json"): ("out-of-scope", "src/data.json"),
        ("src/a.ts", "../../../out"): ("unresolved", "outside-root"),
        ("src/lib/b.ts", "../a"): ("local", "src/a.ts"),
        ("src/lib/b.ts", "@lib/c"): ("local", "src/lib/c.ts"),
        ("src/lib/c.ts", "./b"): ("local", "src/lib/b.ts"),
    }


def test_metrics_and_score(done):
    m = {(r.repo, r.id): (r.state, r.value) for r in done.metrics.collect()}
    assert len(m) == 2 * 29
    assert m["one", "duplication.groups.production"] == ("complete", 1.0)
    # 16 lines a copy, and the next line: it begins with the same word
    assert m["one", "duplication.duplicated-lines.production"] == ("complete", 34.0)
    assert m["one", "complexity.cc.max.production"] == ("complete", 6.0)
    assert m["one", "complexity.cc.max.test"] == ("not-applicable", None)
    # b and c at run time; the type-only edge back to a closes nothing
    assert m["one", "import-cycle.modules"] == ("incomplete", 2.0)
    assert m["two", "complexity.functions.production"] == ("incomplete", 0.0)
    score = {r.repo: (r.i, r.p) for r in done.score.groupBy("repo").agg(F.max("index").alias("i"), F.bool_or("partial").alias("p")).collect()}
    assert score["two"] == (100, True)
    assert score["one"][1]
    assert {r.kind for r in done.findings.collect()} == {"duplication.clone-group", "graph.unresolved-import", "import-cycle"}
    runs = {r.repo: r for r in audit.run_rows(done).collect()}
    assert runs["two"].completeness == "incomplete" and len(runs["one"].metrics) == 29


def test_identities(spark):
    text = "class A { m() {} n() { const f = () => 1; const f2 = () => 2; } }\nfunction d() {}\nfunction d() {}\nfunction e() { [1].map(() => { function k() {} }); }\n"
    files = spark.createDataFrame([("r", "production", ".", "a.ts", text)], "repo string, source_set string, package_path string, path string, text string")
    got = sorted((r.identity, r.ambiguous) for r in syntax.identities(syntax.functions(syntax.syntax(files))).collect())
    assert got == [("d", True), ("d", True), ("e", False), ("e/(anonymous)", True), ("e/(anonymous)/k", True), ("m", False), ("n", False), ("n/f", False), ("n/f2", False)]
