"""Maximal repeats and clone groups against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from skarn.functions import windows
from skarn.operators import clone_groups, keyed


def all_pairs(streams, least):
    """Contents of all maximal pairs, with the places of both sides."""
    groups = {}
    places = [(s, i) for s, x in enumerate(streams) for i in range(len(x))]
    for n, (s, i) in enumerate(places):
        for u, j in places[n + 1 :]:
            a, b = streams[s], streams[u]
            if i and j and a[i - 1] == b[j - 1]:
                continue
            h = 0
            while i + h < len(a) and j + h < len(b) and a[i + h] == b[j + h]:
                h += 1
            if h >= least:
                groups.setdefault(tuple(a[i : i + h]), set()).update([(s, i), (u, j)])
    return groups


def plain_members(files, least, min_lines):
    """Rows of clone_members of one scope; files are (path, kinds, start lines, end lines)."""
    located = []
    for content, places in all_pairs([f[1] for f in files], least).items():
        members = [(files[s][0], files[s][2][i], files[s][3][i + len(content) - 1], i) for s, i in places]
        members = [m for m in members if m[2] - m[1] + 1 >= min_lines]
        if len(members) > 1:
            located.append((len(content), members))
    spans = {(path, i, i + n) for n, members in located for path, _, _, i in members}
    inside = lambda path, a, b: any(p == path and x <= a and b <= y and (x, y) != (a, b) for p, x, y in spans)
    alive = [(n, sorted(m)) for n, m in located if not all(inside(path, i, i + n) for path, _, _, i in m)]
    alive.sort(key=lambda g: (g[1][0][:3], -g[0], -len(g[1]), g[1][0][3]))
    return [(k + 1, path, a, b, n, i) for k, (n, members) in enumerate(alive) for path, a, b, i in members]


def parsed(spark, scopes):
    rows = [(f"r{s}", "production", *f) for s, files in enumerate(scopes) for f in files]
    return spark.createDataFrame(rows, "repo string, source_set string, path string, kinds array<int>, start_lines array<int>, end_lines array<int>").repartition(3)


def some_scopes(rng, number, alphabet, files, length):
    """Files with copied passages, short periods and uneven lines."""
    scopes = []
    for _ in range(number):
        passages = [[rng.randrange(alphabet) for _ in range(rng.randint(3, length))] for _ in range(3)]
        scope = []
        for path in range(rng.randint(0, files)):
            kinds = []
            for _ in range(rng.randint(0, 4)):
                kinds += rng.choice([rng.choice(passages), [rng.randrange(alphabet)] * rng.randint(1, 9), [rng.randrange(alphabet) for _ in range(rng.randint(0, 6))]])
            lines = np.cumsum([rng.choice([0, 0, 1]) for _ in kinds]).tolist()
            scope.append((f"f{path}", kinds, lines, lines))
        scopes.append(scope)
    return scopes


def test_members_equal_brute_force(spark):
    """Many scopes at once, at several least lengths, so that runs span several levels."""
    rng = random.Random(5)
    for least, min_lines, alphabet, number in ((2, 1, 2, 60), (3, 2, 3, 80), (2, 3, 40, 40)):
        scopes = some_scopes(rng, number, alphabet, 5, 30)
        got = {}
        for r in clone_groups.clone_members(parsed(spark, scopes), least, min_lines).collect():
            got.setdefault(r.repo, []).append((r.group_id, r.path, r.start_line, r.end_line, r.token_count, r.start_token))
        want = {f"r{s}": sorted(m) for s, files in enumerate(scopes) if (m := plain_members(files, least, min_lines))}
        assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 10


def test_long_copies_and_hot_passages(spark, monkeypatch):
    """Copies of 700 tokens (five levels), a passage in every file, heavy keys by broadcast, nothing repeated, nothing at all."""
    monkeypatch.setattr(keyed, "HEAVY_ROWS", 10)
    rng = random.Random(9)
    long, common = [rng.randrange(10**6) for _ in range(700)], [rng.randrange(10**6) for _ in range(12)]
    files = []
    for i in range(30):
        kinds = [1000 + i] + common + [rng.randrange(10**6) for _ in range(5)] + (long[: 700 - i] if i < 3 else []) + [7] * (i % 4)
        files.append((f"f{i:02}", kinds, list(range(len(kinds))), list(range(len(kinds)))))
    got = clone_groups.clone_members(parsed(spark, [files]), 4, 1).collect()
    assert sorted(tuple(r)[2:] for r in got) == plain_members(files, 4, 1) and {r.token_count for r in got} >= {12, 698, 699}
    single = [("a", list(range(50)), [1] * 50, [1] * 50)]
    assert clone_groups.clone_members(parsed(spark, [single]), 4, 1).count() == 0
    assert clone_groups.clone_members(parsed(spark, []), 4, 1).count() == 0


def test_window_hashes():
    """Equal windows have equal hashes wherever they stand; others differ."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 3, 4000).astype(np.uint64)
    hashes = windows.PrefixHashes(codes)
    starts = rng.integers(0, 3900, 3000)
    ends = starts + rng.integers(0, 14, 3000)
    g1, g2 = hashes.windows(starts, ends)
    content, found = {}, {}
    for a, b, x, y in zip(starts, ends, g1.tolist(), g2.tolist(), strict=True):
        key = tuple(codes[a:b].tolist())
        assert content.setdefault(key, (x, y)) == (x, y) and found.setdefault((x, y), key) == key
    assert not set(g1.tolist()) & set(hashes.windows(starts, ends, 5)[0].tolist())


def test_numbered(spark):
    """Groups over many ranges, null groups, ties."""
    rows = [(i % 3 or None, i // 4) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, x int").repartition(7)
    got = keyed.numbered(df, ["g"], ["x"], "n").collect()
    for g in (None, 1, 2):
        mine = sorted((r.n, r.x) for r in got if r.g == g)
        assert [n for n, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted(x for h, x in rows if h == g)
    assert keyed.numbered(df.where(F.lit(False)), ["g"], ["x"], "n").count() == 0
