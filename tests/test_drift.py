from __future__ import annotations

from skarn.operators import drift

CANON = [
    {"path": "a.txt", "matcher": "exact", "content": "x\n"},
    {"path": "b.txt", "matcher": "text", "content": "one\ntwo"},
    {"path": "c.json", "matcher": "json-subset", "content": '{"k": {"a": 1, "b": [1, 2]}, "m": true}'},
    {"path": "d.md", "matcher": "template", "content": "## About <<NAME>>\n## Use\n```\n## no\n```\n"},
]


def test_states(spark):
    files = {
        "good": {"a.txt": "x\n", "b.txt": "\r\none  \r\ntwo\n\n", "c.json": '{"m": true, "k": {"b": [1, 2], "a": 1}}', "d.md": "##  about this \n## USE\n"},
        "more": {"a.txt": "y\n", "b.txt": "one", "c.json": '{"m": true, "k": {"b": [1, 2], "a": 1}, "z": 0}', "d.md": "## About x\n## Use\n## Own\n"},
        "less": {"c.json": '{"m": 1, "k": {"a": 2}}', "d.md": "text"},
        "bad": {"c.json": "{", "a.txt": ""},
        "none": {},
    }
    targets = spark.createDataFrame([(t,) for t in files], "target string")
    rows = spark.createDataFrame([(t, p, c) for t, fs in files.items() for p, c in fs.items()], "target string, path string, content string")
    deltas = spark.createDataFrame([("more", "a.txt", None), ("less", "c.json", ["k"]), ("bad", "c.json", ["k"])], "target string, path string, prefixes array<string>")
    got = {(r.target, r.path): (r.state, [(d.path, d.kind) for d in r.divergences]) for r in drift.drift(CANON, targets, rows, deltas).collect()}
    assert all(got["good", c["path"]] == ("match", []) for c in CANON[:3])
    # a heading that a placeholder stands for is there, and counts as the target's own too
    assert got["good", "d.md"] == ("extra", [("section:about this", "added")])
    assert got["more", "a.txt"] == ("allowed-delta", [("", "changed")])
    assert got["more", "b.txt"] == ("drift", [("", "changed")])
    assert got["more", "c.json"] == ("extra", [("z", "added")])
    assert got["more", "d.md"] == ("extra", [("section:about x", "added"), ("section:own", "added")])
    assert got["less", "c.json"] == ("drift", [("m", "changed")])
    assert got["less", "d.md"] == ("drift", [("section:about <<name>>", "missing"), ("section:use", "missing")])
    assert got["bad", "c.json"] == ("drift", [("", "changed")])
    assert got["bad", "a.txt"][0] == "drift"
    assert all(got["none", c["path"]] == ("missing", []) for c in CANON)
    counts = {r.target: r.asDict() for r in drift.summary(drift.drift(CANON, targets, rows, deltas)).collect()}
    assert counts["none"] == {"target": "none", "match": 0, "allowed-delta": 0, "drift": 0, "missing": 4, "extra": 0}


def test_documents_are_compared_by_nodes():
    canon = {"a": 1, "b": {"c": [1, 2], "d": {"e": None}}, "f": {}}
    assert drift.subset(canon, {"f": {}, "b": {"d": {"e": None}, "c": [1, 2]}, "a": 1}) == []
    assert drift.subset(canon, {"a": "1", "b": {"c": [2, 1], "x": {"y": 1}}, "f": 0}) == [("a", "changed"), ("b.c", "changed"), ("b.d", "missing"), ("b.x", "added"), ("f", "changed")]
    assert drift.subset([1], {"a": 1}) == [("", "changed")]


def test_headings_and_placeholders():
    text = "## One  two \n```sh\n## no\n```\n### Three\n##None\n## F[o]ur*\n```\n## open"
    assert drift.headings(text) == ["one two", "f[o]ur*"]
    assert drift.sections("## F[o]<<x>>*\n## Is <<a>> and <<b>>", text + "\n```\n## is 1 and 2") == [("section:one two", "added"), ("section:f[o]ur*", "added"), ("section:is 1 and 2", "added")]


def test_local_paths(spark):
    from pyspark.sql import functions as F

    from skarn.operators import safeguards

    text = """node ./scripts/a.ts "tools/b.mjs", src/x/ scripts/a.ts https://h/x @s/p $HOME/x A=b/c -f/x ../up/y a/../b lone .github/w.yml 'q/r'; z/"""
    got = spark.range(1).select(safeguards.local_paths(F.lit(text))).first()[0]
    assert got == ["scripts/a.ts", "tools/b.mjs", "src/x", ".github/w.yml", "q/r"]
