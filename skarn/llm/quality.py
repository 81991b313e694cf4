"""Quality score: random Fourier features, ridge, isotonic calibration.

Document statistics (shares of character classes, word lengths, repetition of words, shingles
and lines) are standardised and mapped by ``FEATURES`` random cosines, which approximate a
Gaussian kernel.  Each partition sums its rows' normal equations; the sums, of fixed size, are
added up and solved for ridge weights.  Isotonic regression over ``CALIBRATION_BINS`` bins turns
ridge scores into probabilities.

Fitted on at most ``LABELLED_ROWS`` labelled rows (documented bound); every text is scored whole.

Defined cases: null text is empty; an empty text has all statistics 0 and is scored like any
other; repeated rows get equal scores; without labelled rows of both kinds all scores are 0.5; an
empty table gives an empty result; clashing columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import labelled
from skarn.llm.text import checkpointed, shingle_hashes, slices, word_hashes

THRESHOLD = 0.7
FEATURES = 160
WIDTH = 2.5  # of the Gaussian kernel, in standard deviations of a statistic times sqrt(count)
RIDGE = 3.0
SEED = 20

_CLASSES = np.full(256, 7)
_CLASSES[[*range(97, 123)]] = 0
_CLASSES[[*range(65, 91)]] = 1
_CLASSES[[*range(48, 58)]] = 2
_CLASSES[[32, 9, 11, 12, 13]] = 3
_CLASSES[10] = 4
_CLASSES[[*map(ord, ".,;:?'\"()-")]] = 5
_CLASSES[[*map(ord, "!")]] = 6
_CLASSES[128:] = 8
_CLASSES[ord("|")] = 9
STATISTICS = 20


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` numbers for each text."""
    texts = texts.fill_null("").cast(pa.large_string())
    out = np.zeros((len(texts), STATISTICS))
    for at, part in slices(texts):
        n = len(part)
        rows = out[at : at + n]
        bufs = part.buffers()
        offsets = np.frombuffer(bufs[1], np.int64)[part.offset : part.offset + n + 1]
        data = np.frombuffer(bufs[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        bounds = offsets - offsets[0]
        classes = _CLASSES[data]
        size = np.maximum(np.diff(bounds), 1)
        owner = np.repeat(np.arange(n), np.diff(bounds))
        shares = np.bincount(owner * 10 + classes, minlength=10 * n).reshape(n, 10) / size[:, None]
        rows[:, :10] = np.sqrt(shares)
        words, first = word_hashes(part)
        counts = np.diff(first)
        rows[:, 10] = np.log1p(counts)
        rows[:, 11] = np.log1p((np.diff(bounds) - counts) / np.maximum(counts, 1))
        shingles, rows_of = shingle_hashes(words, first, 3)
        order = np.argsort(rows_of, kind="stable")
        shingles, edges = shingles[order], np.searchsorted(rows_of[order], np.arange(n + 1))
        for i, x in enumerate(part.to_pylist()):
            w = words[first[i] : first[i + 1]]
            if len(w):
                _, c = np.unique(w, return_counts=True)
                rows[i, 12] = len(c) / len(w)
                rows[i, 13] = c.max() / len(w)
                rows[i, 14] = np.log1p(len(c)) / np.log1p(len(w))
                s = shingles[edges[i] : edges[i + 1]]
                rows[i, 15] = 1 - len(np.unique(s)) / max(len(s), 1)
            lines = [y for y in x.split("\n") if y.strip()]
            if lines:
                rows[i, 16] = 1 - len(set(lines)) / len(lines)
                rows[i, 17] = np.log1p(len(x) / len(lines))
                rows[i, 18] = sum(y.rstrip()[-1] in ".!?" for y in lines) / len(lines)
                rows[i, 19] = np.log1p(len(lines))
    return out


@dataclass
class Model:
    mean: np.ndarray = field(default_factory=lambda: np.zeros(STATISTICS))
    spread: np.ndarray = field(default_factory=lambda: np.ones(STATISTICS))
    weights: np.ndarray | None = None
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(STATISTICS, FEATURES)) / (WIDTH * np.sqrt(STATISTICS) / 2)
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), 0.5)
        return labelled.calibrated(self.raw(x), self.ends, self.values)


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), STATISTICS)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = labelled.LABELLED_ROWS) -> Model:
    train = checkpointed(labelled.training_rows(docs, labels, label, rows).mapInArrow(_statistics_of, "label int, x array<double>"))
    model = Model()

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2)
        s, q = np.zeros(STATISTICS), np.zeros(STATISTICS)
        for batch in batches:
            x, y = _matrix(batch.column(1)), np.asarray(batch.column(0))
            n += [len(x), y.sum()]
            s, q = s + x.sum(0), q + (x * x).sum(0)
        yield _sums(np.concatenate([n, s, q]))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = FEATURES + 1
        a = np.zeros((d, d + 1))
        for batch in batches:
            f, y = model.features(_matrix(batch.column(1))), np.asarray(batch.column(0), float)
            a += f.T @ np.hstack([f, y[:, None]])
        yield _sums(a.ravel())

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * labelled.CALIBRATION_BINS)
        for batch in batches:
            y = np.asarray(batch.column(0))
            b = _bin(model.raw(_matrix(batch.column(1))))
            np.add.at(total, 2 * b + 1, y)
            np.add.at(total, 2 * b, 1)
        yield _sums(total)

    m = _added(train, moments)
    if not len(m) or not 0 < m[1] < m[0]:
        return model
    n = m[0]
    model.mean = m[2 : 2 + STATISTICS] / n
    model.spread = np.sqrt(np.maximum(m[2 + STATISTICS :] / n - model.mean**2, 1e-12)) + 1e-6
    a = _added(train, equations).reshape(FEATURES + 1, FEATURES + 2)
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(a[:, :-1] + penalty, a[:, -1])
    c = _added(train, bins).reshape(-1, 2)
    used = c[:, 0] > 0
    model.ends, model.values = labelled.isotonic(_edges()[used], c[used, 0], c[used, 1])
    return model


def _edges() -> np.ndarray:
    return np.linspace(-0.5, 1.5, labelled.CALIBRATION_BINS + 1)[1:]


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(_edges(), raw, side="left"), labelled.CALIBRATION_BINS - 1)


def _sums(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)), pa.int64()), pa.array(x, pa.float64())], ["k", "v"])


def _added(df: DataFrame, partial) -> np.ndarray:
    """Element-wise sum of what ``partial`` yields for each partition; of fixed size."""
    total = df.mapInArrow(partial, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")
    return total.v.to_numpy()


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = model.score(statistics(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
