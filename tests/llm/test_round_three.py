"""Sharding, conversation repair and ball clusters against plain versions and odd tables."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from skarn.llm import balls, decontaminate, jaccard, repair, sharding

SCHEMA = "doc_id bigint, text string, shard int, size string, slot string, key string, row string, at string"


def docs(spark, rows):
    """Rows with extra columns whose names clash with those of the operator."""
    return spark.createDataFrame([(i, t, 9, "x", None, "k", "r", "a") for i, t in rows], SCHEMA).repartition(5)


# ---------------------------------------------------------------- sharding


def plain_loads(weights, shards):
    heap = [(0, s) for s in range(shards)]
    dealt = []
    for w in sorted(weights, reverse=True):
        load, s = heapq.heappop(heap)
        dealt.append((w, s))
        heapq.heappush(heap, (load + w, s))
    return sorted(heap), sorted(dealt)


def test_deal_equals_one_by_one():
    r = random.Random(3)
    for _ in range(400):
        shards = r.randint(1, 9)
        weights = sorted((r.choice([16, 17, 20, 90, 1000, 5000]) for _ in range(r.randint(0, 60))), reverse=True)
        heap = [(0, s) for s in range(shards)]
        dealt = []
        for w, same in itertools.groupby(weights):
            for s, n in sharding.deal(heap, w, len(list(same))).items():
                dealt += [(w, s)] * n
        assert (sorted(heap), sorted(dealt)) == plain_loads(weights, shards)
    heap = [(0, s) for s in range(40)]
    assert sum(sharding.deal(heap, 16, 10**12).values()) == 10**12 and max(heap)[0] - min(heap)[0] == 0


def test_sharding(spark, monkeypatch):
    """A text with a third of all rows, nulls, empty and long texts, repeated rows and ids; several buckets a class."""
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 20)
    monkeypatch.setattr(sharding, "HEAVY_ROWS", 50)
    r = random.Random(5)
    rows = [(i, "copied") for i in range(200)] + [(None, None), (1, ""), (1, None), (None, "x"), (7, "long é " * 30000)]
    rows += [(1000 + i, "".join(r.choices("abcé", k=r.choice([3, 3, 8, 40, 400])))) for i in range(400)] + [(5000, "twice")] * 2
    got = sharding.assign_shards(docs(spark, rows), shards=7, keep=["text"]).collect()
    assert sorted((str(x.doc_id), x.row.text or "", x.size) for x in got) == sorted((str(i), t or "", len((t or "").encode()) + 16) for i, t in rows)
    assert all(x.text_crc32 == zlib.crc32((x.row.text or "").encode()) and x.law == "bytes" and x.grown_shard is None for x in got)
    weights, where = {}, {}
    for x in got:
        weights[x.row.text or ""] = weights.get(x.row.text or "", 0) + x.size
        where.setdefault(x.row.text or "", set()).add(x.shard)
    assert all(len(s) == 1 for s in where.values())
    loads, dealt = plain_loads(weights.values(), 7)
    assert sorted((w, min(where[t])) for t, w in weights.items()) == dealt
    assert sorted((sum(x.size for x in got if x.shard == s), s) for s in range(7)) == loads
    for s in range(7):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))
    again = sharding.assign_shards(docs(spark, rows[::-1]).repartition(2), shards=7, keep=["text"]).collect()
    assert sorted((str(x.doc_id), x.shard, x.slot, x.row.text or "") for x in again) == sorted((str(x.doc_id), x.shard, x.slot, x.row.text or "") for x in got)


def test_sharding_of_little(spark, tmp_path):
    assert sharding.assign_shards(docs(spark, [])).count() == 0
    one = sharding.assign_shards(docs(spark, [(3, None)])).collect()
    assert [tuple(x) for x in one] == [(3, 16, 0, "bytes", 0, 0, None)]
    with pytest.raises(ValueError):
        sharding.assign_shards(docs(spark, []), shards=0)
    rows = [(i, f"text {i % 30} " * (i % 7)) for i in range(90)]
    sharding.write_shards(docs(spark, rows), str(tmp_path / "out"), shards=4, file_rows=10)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((x.row.doc_id, x.row.text, x.row.size) for x in back) == sorted((i, t, "x") for i, t in rows) and {x.shard for x in back} == {0, 1, 2, 3}


# ---------------------------------------------------------------- repair

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        found = BLANK.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_edits(turns, marks, limit):
    """(cost, edits, role:text lines) of every way of at most ``limit``, by search over all of them."""
    stack = [(0, "", 0, ())]
    while stack:
        cost, edits, at, lines = stack.pop()
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", "".join(line[0] if line[0] in "sua" and not line.startswith(":") else "x" for line in lines)):
            yield cost, edits, lines
        options = [(3, "I", at, (r + ":",)) for r in ("user", "assistant")]
        if at < len(turns):
            role, text = turns[at][2:]
            options.append((4, "D", at + 1, ()))
            if marks[at] not in ("blank", "duplicate"):
                more = 3 if marks[at] == "truncated" else 0
                options += [(more, "K", at + 1, (f"{role}:{text}",))] + [(3 + more, "R", at + 1, (f"{r}:{text}",)) for r in ("user", "assistant")]
        stack += [(cost + c, edits + e, a, lines + new) for c, e, a, new in options if cost + c <= limit]


def repaired(turns):
    """Cheapest edits of the turns of one conversation, by exhaustion up to the cost of deleting them all."""
    marks = faults(turns)
    best = min(all_edits(turns, marks, min(4 * len(turns), 14)), default=None)
    return best


def plain_repairs(rows):
    turns = {}
    for row in damage(rows):
        turns.setdefault(row[0], []).append(row)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(turns.get(conv, []), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
        marks, best = faults(mine), repaired(mine)
        known = [t for _, t, _, _ in mine if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        out[conv] = (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, *(best and (best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()) or ()))
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, position int, audit string").repartition(4)


def test_repair_equals_search(spark):
    """Every way of editing short conversations: odd roles, nulls, white space, repeated and unnumbered turns."""
    r = random.Random(11)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "sage"]
    texts = ["Yes.", "No!", "Why? ", "cut off", "", " \t\n", None, "Ende…", "a.\x0b", " ", "Yes."]
    rows = []
    for conv in range(500):
        for turn in range(r.randint(1, 4)):
            rows.append((conv, r.choice([turn, turn, turn * 3, None]), r.choice([roles[1 + turn % 2], r.choice(roles)]), r.choice(texts)))
    rows += [(None, t, role, "Hello.") for t, role in enumerate(["user", "assistant"])] + [rows[0]]
    want = plain_repairs(rows)
    table = conversations(spark, rows)
    got = {x.conv_id: tuple(x)[1:] for x in repair.repair_digests(repair.damaged(table), table).collect()}
    assert got.keys() == want.keys()
    checked = 0
    for conv, w in want.items():
        assert got[conv][:5] == w[:5], conv
        if len(w) > 5:
            checked += 1
            assert got[conv][5:] == w[5:], (conv, [x for x in rows if x[0] == conv])
        else:
            assert got[conv][5] > 14
    assert checked > 450


def test_repair_of_long_and_odd(spark):
    """A long conversation that spans batches, one whose turns all go, an empty table."""
    long = [(1, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for t in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    got = repair.repair_digests(conversations(spark, long)).collect()
    lines = "\n".join(f"{x[2]}:{x[3]}" for x in long)
    assert [tuple(x) for x in got] == [(1, 0, 0, 0, 0, 0, 0, "K" * 3000, hashlib.sha256(lines.encode()).hexdigest())]
    turns = repair.repaired_turns(conversations(spark, [*long, (2, 1, "assistant", "Late.")])).collect()
    assert sorted((x.position, x.role, x.text) for x in turns if x.conv_id == 1) == [(t, role, text) for _, t, role, text in long]
    # Cost 3 and the least of "IK" (a user turn before) and others.
    assert sorted((x.position, x.edit, x.role, x.text) for x in turns if x.conv_id == 2) == [(0, "I", "user", ""), (1, "K", "assistant", "Late.")]
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = conversations(spark, [(gone, 0, "user", "Hi.")])
    assert [tuple(x) for x in repair.repair_digests(repair.damaged(table), table).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    none = conversations(spark, [])
    assert repair.repair_digests(repair.damaged(none), none).count() == 0 and repair.repaired_turns(none).count() == 0


def test_trie_shares_prefixes():
    """Answers don't depend on what was walked before, and a sorted walk computes each prefix once."""
    r = random.Random(2)
    signatures = sorted({"".join(r.choices("suaxSUAXd", k=r.randint(0, 9))) for _ in range(3000)})
    walk, layers = repair.Branch(), 0
    for s in signatures:
        layers += len(s) - repair.shared_prefix(walk.signature, s)
        walk.descend(s)
        alone = repair.Branch()
        alone.descend(s)
        assert walk.answer() == alone.answer()
    assert layers == len({s[:n] for s in signatures for n in range(1, len(s) + 1)})


# ---------------------------------------------------------------- ball clusters


def plain_clusters(rows, clusters=balls.CLUSTERS, rounds=balls.ROUNDS):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centroids = [v for _, v in first]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((away(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[k]) for x in zip(*members[k], strict=True)] if k in members else c for k, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, d, k in found if k == j) for j in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia), names[k]) for i, d, k in found), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, cluster int, v string").repartition(4)


def as_float(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_ball_clusters(spark, monkeypatch):
    """Clumps (whole balls), noise, a vector with a third of all rows, ties, and vectors that aren't kept."""
    monkeypatch.setattr(balls, "BLOCK", 150)
    r = random.Random(4)
    clumps = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.02) for x in clumps[i % 12]]) for i in range(500)] + [(1000 + i, [r.gauss(0, 0.3) for _ in range(64)]) for i in range(200)]
    rows += [(2000 + i, clumps[0]) for i in range(400)] + [(3000, clumps[1]), (3000, clumps[1]), (None, clumps[2]), (None, [0.0] * 64)]
    rows += [(4000, None), (4001, []), (4002, clumps[0][:63]), (4003, [None] + clumps[0][1:]), (4004, [float("nan")] + clumps[0][1:]), (4005, [float("-inf")] + clumps[0][1:])]
    rows = as_float(rows)
    got = sorted(map(tuple, balls.cluster_vectors(vectors(spark, rows)).collect()), key=str)
    assert got == plain_clusters(rows)


def test_ball_clusters_of_little(spark):
    few = as_float([(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.25] * 64)])
    assert sorted(map(tuple, balls.cluster_vectors(vectors(spark, few)).collect()), key=str) == plain_clusters(few)
    none = balls.cluster_vectors(vectors(spark, [(1, None)]))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    far = balls.cluster_vectors(vectors(spark, as_float([(1, [1e30] * 64), (2, [-1e30] * 64)])), clusters=1, rounds=0).collect()
    assert {x.distance for x in far} == {0, 64 * (2 * balls.LIMIT) ** 2}


def test_whole_balls_are_exact():
    """Tight clumps go as whole balls, and each vector has its nearest centroid, the smaller number at ties."""
    r = np.random.default_rng(6)
    clumps = r.integers(-60, 60, (8, 16))
    points = (clumps[r.integers(0, 8, 3000)] + r.integers(-1, 2, (3000, 16))).astype(np.int64)
    tree, order = balls.BallTree.built(points)
    assert np.array_equal(tree.vectors, points[order])
    centroids = np.concatenate([clumps, clumps[:2]]).astype(np.int64)
    whole, cluster = 0, np.full(3000, -1)
    for a, b, k, node in tree.assigned(centroids):
        whole += (b - a) * (node >= 0)
        cluster[a:b] = k
        if node >= 0:
            assert np.array_equal(tree.sums[node], tree.vectors[a:b].sum(axis=0))
    exact = ((tree.vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.array_equal(cluster, exact) and whole > 1000
    again = balls.BallTree.read(tree.columns(), 16)
    assert np.array_equal(again.vectors, tree.vectors) and np.array_equal(again.radii, tree.radii)


# --- blocks of items, frequent tokens --------------------------------------------------------


def test_blocks_of_items_give_what_one_block_gives(spark, monkeypatch):
    """Many items of one length (marked) and of lengths of their own, in one block and in blocks of 7."""
    r = random.Random(12)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(20 if i < 30 else i))) for i in range(50)]
    rows = [(i, " ".join([*(f"d{r.randrange(999)}" for _ in range(30)), *(items[i % 50][1].split() if i % 3 else [])])) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    df = spark.createDataFrame(items, "item_id bigint, text string")

    def found():
        pairs = sorted((x.doc_id, x.item_id, x.first_word) for x in decontaminate.find_contamination(docs, df).collect())
        return pairs, sorted(x.doc_id for x in decontaminate.keep_uncontaminated(docs, df).collect())

    whole = found()
    assert whole == ([(i, i % 50, 30) for i in range(90) if i % 3], [i for i in range(90) if i % 3 == 0])
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 7)
    assert found() == whole
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 4096)
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", 900)
    assert found() == whole


def test_tokens_of_every_share_over_the_bound_are_found(spark, monkeypatch):
    shares = [2048, 1500, 1200, 1000, 870, 700]
    rows = [(i, " ".join([f"u{i}v{k}" for k in range(3)] + [f"t{s} x{s} y{s}" for s in shares if i % s == 0])) for i in range(2048 * 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    hashes = jaccard.shingle_hashes(*jaccard.word_hashes(jaccard.pa.array([f"t{s} x{s} y{s}" for s in shares])), 3)[0]
    want = {int(h) >> 10 for h in hashes}
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", 8)
    for held in (1 << 21, 1 << 14):
        monkeypatch.setattr(jaccard, "HELD", held)
        assert want <= set(jaccard.frequent_tokens(df, 3)[0].tolist())
