"""Workflow steps by the YAML tree, and workflows that can't be read."""

from __future__ import annotations

from skarn.operators import safeguards
from skarn.sources import workspace

GOOD = """on: push
defaults:
  run:
    shell: bash
jobs:
  build:
    steps:
      - uses: actions/checkout@v4  # the code
      - name: "run: not a step"
        run: |
          npm ci

          npm run test
      - {run: "npm run lint", if: always()}
      - run: >-
          tsc
          --noEmit
  call:
    uses: ./.github/workflows/other.yml
"""


def test_steps_and_problems(spark, tmp_path):
    folder = tmp_path / "a" / ".github" / "workflows"
    folder.mkdir(parents=True)
    (folder / "ci.yml").write_text(GOOD)
    (folder / "bad.yaml").write_text("jobs: [: {")
    (folder / "folder.yml").mkdir()
    (folder / "empty.yml").write_text("")
    (folder / "notes.txt").write_text("run: no")
    (tmp_path / "b").mkdir()
    targets = workspace.targets(spark, {k: str(tmp_path / k) for k in "ab"})
    commands = sorted((r.line, r.command) for r in safeguards.workflow_commands(targets).collect())
    assert commands == [(11, "npm ci"), (13, "npm run test"), (14, "npm run lint"), (16, "tsc"), (17, "--noEmit")]
    assert sorted((r.line, r.action) for r in safeguards.workflow_actions(targets).collect()) == [(8, "actions/checkout@v4"), (19, "./.github/workflows/other.yml")]
    problems = {r.workflow: r.problem for r in safeguards.workflow_problems(targets).collect()}
    assert problems == {".github/workflows/bad.yaml": "ParserError", ".github/workflows/folder.yml": "IsADirectoryError"}
