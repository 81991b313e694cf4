"""Lloyd's rounds in integers, with ball trees that assign whole balls of vectors.

Vectors become integers once.  Each task builds metric trees over blocks of ``BLOCK`` of its own
vectors and writes them down; a node stores its count, its integer sum (so its centre is exact up to one division)
and the radius of its ball.  A round sends only the centroids: by the triangle inequality a centroid whose distance
to a ball's centre exceeds the least such distance by more than twice the radius can't be nearest to
any vector of the ball; where one centroid is left, the ball's count and sum are added whole, else the
walk goes down, and leaves compare exact integers.  Tasks give back one row for each centroid, and
the driver sees ``clusters`` times ``dimensions`` sums.

Bounds in floating point keep a margin far over their rounding error, so a whole ball is only given
away where every vector of it is strictly nearer; ties are decided exactly, for the smaller number.

Defined cases: vectors of another length, or with a null, infinite or undefined component, are not
kept; repeated rows count each; a row without an id is kept, and is hashed as ``1:null``; equal hashes
are ordered by their vectors; fewer vectors than ``clusters`` give as many centroids; a component beyond
``LIMIT`` counts as ``LIMIT`` (squared distances then still fit 64 bits); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.text import checkpointed

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, "1"
BLOCK, LEAF = 4096, 32
LIMIT = 1 << 27
MARGIN = 1e-6


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64)


class BallTree:
    """Nodes over contiguous runs of ``vectors``, parents before children."""

    def __init__(self, vectors: np.ndarray, runs: np.ndarray, sums: np.ndarray, radii: np.ndarray) -> None:
        self.vectors, self.runs, self.sums, self.radii = vectors, runs, sums, radii

    @staticmethod
    def built(vectors: np.ndarray, leaf: int = LEAF) -> tuple[BallTree, np.ndarray]:
        """The tree and the order it puts the vectors in."""
        order = np.arange(len(vectors))
        runs, sums, radii = [[0, len(vectors), -1, -1]], [], []
        at = 0
        while at < len(runs):
            a, b = runs[at][:2]
            these = vectors[order[a:b]]
            total = these.sum(axis=0)
            away = np.sqrt(((these - total / (b - a)) ** 2).sum(axis=1))
            sums.append(total)
            radii.append(away.max())
            if b - a > leaf and radii[-1] > 0:
                # Two far poles; each vector goes to the nearer one, half of them to each.
                one = these[away.argmax()]
                other = these[((these - one) ** 2).sum(axis=1).argmax()]
                side = these @ (other - one)
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(side, half)]
                runs[at][2:] = len(runs), len(runs) + 1
                runs += [[a, a + half, -1, -1], [a + half, b, -1, -1]]
            at += 1
        return BallTree(vectors[order], np.array(runs, np.int32), np.array(sums, np.int64), np.array(radii)), order

    def columns(self) -> list[bytes]:
        return [self.vectors.astype(np.int32).tobytes(), self.runs.tobytes(), self.sums.tobytes(), self.radii.tobytes()]

    @staticmethod
    def read(columns: list[bytes], dimensions: int) -> BallTree:
        vectors, runs, sums, radii = (np.frombuffer(c, t) for c, t in zip(columns, (np.int32, np.int32, np.int64, np.float64), strict=True))
        return BallTree(vectors.reshape(-1, dimensions).astype(np.int64), runs.reshape(-1, 4), sums.reshape(-1, dimensions), radii)

    def assigned(self, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | int, int]]:
        """(first, last, cluster, node): runs of vectors with their cluster; a whole ball has one and its node,
        a leaf an array and -1."""
        centres = self.sums / (self.runs[:, 1] - self.runs[:, 0])[:, None]
        away = np.sqrt(np.stack([((centres - c) ** 2).sum(axis=1) for c in centroids], axis=1))
        least = away.min(axis=1, keepdims=True)
        reach = self.radii[:, None]
        near = away - reach <= least + reach + MARGIN * (1 + least + reach)
        stack = [(0, near[0])]
        while stack:
            node, candidates = stack.pop()
            candidates = candidates & near[node]
            a, b, left, right = self.runs[node].tolist()
            kept = np.flatnonzero(candidates)
            if len(kept) == 1:
                yield a, b, int(kept[0]), node
            elif left >= 0:
                stack += [(right, candidates), (left, candidates)]
            else:
                exact = np.stack([((self.vectors[a:b] - centroids[k]) ** 2).sum(axis=1) for k in kept], axis=1)
                yield a, b, kept[exact.argmin(axis=1)], -1


def kept_vectors(vectors: DataFrame, vec_id: str, embedding: str, dimensions: int) -> DataFrame:
    x = F.col(embedding)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    # A condition on null elements is null, so both are asked for.
    return vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), x.cast("array<double>").alias("v")).where((F.size("v") == dimensions) & F.coalesce(F.forall("v", finite), F.lit(False)))


def first_centroids(kept: DataFrame, clusters: int, seed: str, scale: int) -> np.ndarray:
    """The vectors of the smallest hashes: ``clusters`` rows."""
    name: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = kept.select(name.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return integers(np.array([r.v for r in rows]), scale)


TREES = "ids array<bigint>, vectors binary, runs binary, sums binary, radii binary"


def grown(kept: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """One tree a row, over at most ``BLOCK`` vectors of a task."""
    names = [c.split()[0] for c in TREES.split(", ")]

    def tree(ids: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        made, order = BallTree.built(integers(vectors, scale))
        return pa.RecordBatch.from_arrays([pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), *(pa.array([c], pa.binary()) for c in made.columns())], names)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                size += held[-1].num_rows
                while size >= BLOCK:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    first, rest = whole.slice(0, BLOCK), whole.slice(BLOCK)
                    yield tree(first.column(0).combine_chunks(), _matrix(first.column(1), dimensions))
                    held, size = rest.to_batches(), rest.num_rows
        if size:
            whole = pa.Table.from_batches(held)
            yield tree(whole.column(0).combine_chunks(), _matrix(whole.column(1), dimensions))

    return checkpointed(kept.mapInArrow(grow, TREES))


def _matrix(column: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    return np.concatenate([np.asarray(c.flatten()) for c in column.chunks]).reshape(-1, dimensions)


def _trees(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Array, BallTree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].values, BallTree.read([batch.column(c)[i].as_py() for c in range(1, 5)], dimensions)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids' exact means, rounded down; a centroid without vectors stays."""
    clusters, dimensions = centroids.shape

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(clusters, np.int64), np.zeros((clusters, dimensions), np.int64)
        for _, tree in _trees(batches, dimensions):
            for a, b, cluster, node in tree.assigned(centroids):
                if node >= 0:
                    counts[cluster] += b - a
                    sums[cluster] += tree.sums[node]
                else:
                    np.add.at(counts, cluster, 1)
                    np.add.at(sums, cluster, tree.vectors[a:b])
        yield pa.RecordBatch.from_arrays([pa.array(range(clusters), pa.int32()), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = trees.mapInArrow(tally, "cluster int, n bigint, sums array<bigint>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for r in cells.where("n > 0").collect():
        out[r.cluster, r.d] = r.x // r.n
    return out


def labelled(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dimensions = centroids.shape[1]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, dimensions):
            cluster = np.zeros(len(tree.vectors), np.int32)
            for a, b, which, _ in tree.assigned(centroids):
                cluster[a:b] = which
            distance = ((tree.vectors - centroids[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(label, "vec_id bigint, cluster int, distance bigint")


def cluster_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    kept = kept_vectors(vectors, vec_id, embedding, dimensions)
    trees = grown(kept, dimensions, scale)
    centroids = first_centroids(kept, clusters, seed, scale)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    labels = checkpointed(labelled(trees, centroids))
    inertia = {r.cluster: r.inertia for r in labels.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = [(k, inertia.get(k, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    known = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return labels.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
