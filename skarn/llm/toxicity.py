"""Toxicity by maximum-scoring segments.

*Token scores*: log-odds of a token's, or of its stems', document frequency in toxic against clean training
documents, with an informative Dirichlet prior (the pooled frequencies); the lexicon holds the
tokens and stems whose log-odds stand out of their own error by ``LEAST_Z`` and are ``LEAST_ODDS`` or more, and that
``LEAST_SHARE`` of the toxic rows hold (which bounds their number).  Near copies among the training documents count once.
Every other token has the log-odds of a plain token in a toxic passage, which is negative.

*Segments*: the linear-time scan of all maximal scoring segments (Ruzzo and Tompa); a run of
plain tokens is one step of the scan, so whole texts of any length are read.

*Calibration*: ``lambda`` solves ``sum p(s) exp(lambda s) = 1`` over the scores of clean tokens;
``K`` comes from the clean training documents' maxima.  A segment of score S in n tokens has the
extreme-value tail ``1 - exp(-K n exp(-lambda S))`` and is significant at ``SIGNIFICANT`` or less; a document's
evidence is the normalised sum of its significant segments, and isotonic regression over the training documents turns evidence into
a probability.

The classifier is fitted on at most ``LABELLED_ROWS`` labelled rows (documented bound); every text
is scored whole.

Defined cases: null text is empty; an empty text has no evidence and gets the score of that;
repeated rows get equal scores; an id with both labels has none; without toxic and clean labelled
rows all scores are 0, without a lexicon all are the toxic share; an empty table gives
an empty result; clashing columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import labelled

THRESHOLD = 0.3
PRIOR_TOKENS = 200.0
LEAST_Z = 4.0
LEAST_ODDS = 1.2  # weak but certain tokens tell languages and lengths apart, not toxicity
LEAST_SHARE = 0.01  # of the toxic training documents that a lexicon token occurs in
PASSAGE_RATE = 0.15  # share of lexicon tokens expected within a toxic passage
SIGNIFICANT = 0.05
STEMS = (4, 5, 6, 7)
WORDS_KEPT = 200_000

tokens_of = re.compile(rb"[0-9a-z'\x80-\xff]+").findall


@dataclass
class Model:
    scores: dict[bytes, float] = field(default_factory=dict)
    plain: float = -0.15
    scale: float = 1.0
    k: float = 0.1
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: np.ndarray = field(default_factory=lambda: np.array([0.5]))
    known: dict[bytes, float | None] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}


def maximal_segments(hits: list[tuple[int, float]], plain: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of a sequence in which the
    tokens at ``hits`` have positive scores and every other token has ``plain`` < 0.

    Each segment knows the nearest one before it with a lower total before its start (-1: none).  A new
    segment goes from one to the next by these; what lies between has a higher total than the one it left, so
    no step is taken twice and the time is linear."""
    out: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total through, lower one
    total, at = 0.0, 0
    for place, score in hits:
        total += plain * (place - at)
        first, before = place, total
        total += score
        at = place + 1
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= before:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                out.append((first, place, before, total, j))
                break
            first, _, before, _, lower = out[j]
            del out[j:]
            j = lower
    return [(a, b, r - l) for a, b, l, r, _ in out]


def features(word: bytes) -> list[bytes]:
    """A token's own entry and those of its stems (the first STEMS characters, marked by a star)."""
    letters = word.decode("utf-8", "surrogatepass")
    return [word, *(letters[:k].encode("utf-8", "surrogatepass") + b"*" for k in STEMS if len(letters) >= k)]


def token_score(word: bytes, model: Model) -> float | None:
    """The highest log-odds of a token's features in the lexicon; remembered for WORDS_KEPT words."""
    known = model.known
    if word in known:
        return known[word]
    score = max((s for s in map(model.scores.get, features(word)) if s is not None), default=None)
    if len(known) < WORDS_KEPT:
        known[word] = score
    return score


def tokenised(text: str | None) -> list[bytes]:
    return tokens_of((text or "").encode("utf-8", "surrogatepass").lower())


def passages(words: list[bytes], model: Model) -> list[tuple[int, int, float]]:
    hits = [(i, s) for i, s in enumerate([token_score(w, model) for w in words]) if s is not None]
    return maximal_segments(hits, model.plain) if hits else []


def tail(score: float, n: int, model: Model) -> float:
    """Probability of a segment of so high a score somewhere in n clean tokens."""
    return -float(np.expm1(-model.k * max(n, 1) * np.exp(-model.scale * score)))


def significant(segments: list[tuple[int, int, float]], n: int, model: Model) -> list[tuple[int, int, float, float]]:
    """The segments whose tail is ``SIGNIFICANT`` or less, with it."""
    tails = [(a, b, s, tail(s, n, model)) for a, b, s in segments]
    return [x for x in tails if x[3] <= SIGNIFICANT]


def evidence(found: list[tuple[int, int, float, float]], n: int, model: Model) -> float:
    """Normalised sum of the significant segments' scores, less the log of the search space: for one segment
    minus the log of its tail's rate.  -1 without any."""
    total = sum(s for _, _, s, _ in found)
    return max(0.0, float(model.scale * total - np.log(max(model.k * max(n, 1), 1e-12)))) if found else -1.0


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = labelled.LABELLED_ROWS) -> Model:
    train = labelled.training_rows(docs, labels, label, rows, distinct=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        size = [Counter(), Counter()]
        for batch in batches:
            for y, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokenised(x)
                seen[y].update({f for w in set(words) for f in features(w)})
                size[y].update(docs=1, tokens=len(words))
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield out(seen, size)
                seen, size = (Counter(), Counter()), [Counter(), Counter()]
        yield out(seen, size)

    def out(seen, size) -> pa.RecordBatch:
        words = list(seen[0].keys() | seen[1].keys())
        table = [words, [seen[0][w] for w in words], [seen[1][w] for w in words]]
        for kind in ("docs", "tokens"):
            table[0].append(b" " + kind.encode())
            table[1].append(size[0][kind])
            table[2].append(size[1][kind])
        return pa.RecordBatch.from_arrays([pa.array(table[0], pa.binary()), pa.array(table[1], pa.int64()), pa.array(table[2], pa.int64())], ["word", "clean", "toxic"])

    counts = train.mapInArrow(count, "word binary, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    special = counts.where(F.col("word").isin(bytearray(b" docs"), bytearray(b" tokens")))
    plain_words = counts.where(F.substring("word", 1, 1) != F.lit(b" "))
    whole = {bytes(r.word)[1:].decode(): (r.clean, r.toxic) for r in special.collect()}
    n0, n1 = whole.get("docs", (0, 0))
    model = Model(values=np.array([n1 / (n0 + n1) if n0 and n1 else 0.0]))
    if not n0 or not n1:
        return model
    share = (F.col("clean") + F.col("toxic")) / F.lit(float(n0 + n1))
    a = F.lit(PRIOR_TOKENS) * share
    odds = lambda y, n: F.log((y + a) / (F.lit(float(n)) + PRIOR_TOKENS - y - a))
    z = F.col("odds") / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    lexicon = (
        plain_words.where(F.col("toxic") >= max(4, int(LEAST_SHARE * n1)))
        .withColumn("odds", odds(F.col("toxic"), n1) - odds(F.col("clean"), n0))
        .withColumn("z", z)
        .where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS))
        .collect()  # each occurs in LEAST_SHARE of the toxic rows: at most the features of 1 / LEAST_SHARE rows
    )
    if not lexicon:
        return model
    model.scores = {bytes(r.word): float(r.odds) for r in lexicon}
    clean_tokens = max(whole["tokens"][0], 1)
    rates = np.array([(r.clean + 0.5) / clean_tokens for r in lexicon])  # stems and words overlap: an upper bound
    model.plain = float(np.log((1 - PASSAGE_RATE) / (1 - min(rates.sum(), PASSAGE_RATE / 2))))
    scores = np.array([r.odds for r in lexicon])
    low, high = 1e-3, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        if (rates * np.expm1(np.minimum(mid * scores, 700))).sum() + (1 - rates.sum()) * np.expm1(mid * model.plain) < 0:
            low = mid
        else:
            high = mid
    model.scale = low

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for y, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokenised(x)
                found = passages(words, model)
                rows.append((y, len(words), max((s for _, _, s in found), default=0.0), evidence(significant(found, len(words), model), len(words), model)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.float64(), pa.float64()))], ["y", "n", "top", "x"])

    measured = lambda: train.mapInArrow(measure, "y int, n bigint, top double, x double").toPandas()  # noqa: E731  at most ``rows`` rows of four numbers
    clean = measured().query("y == 0")
    model.k = float(min(max((clean.top > 0).sum() / max(np.maximum(clean.n, 1).sum() * np.exp(-model.scale * min(scores)), 1e-9), 1e-6), 10.0))
    got = measured()
    edges = np.unique(np.quantile(got.x, np.linspace(0, 1, labelled.CALIBRATION_BINS + 1)[1:]))
    bins = np.searchsorted(edges, got.x)
    weight, positive = np.bincount(bins, minlength=len(edges)), np.bincount(bins, weights=got.y, minlength=len(edges))
    model.ends, model.values = labelled.isotonic(edges, weight, positive)
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the significant passages as (first word, last word,
    score, p), for every row."""
    schema = "doc_id bigint, score double, passages array<struct<first:int,last:int,score:double,p:double>>"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, found = [], []
            for x in batch.column(1).to_pylist():
                words = tokenised(x)
                segments = significant(passages(words, model), len(words), model)
                xs.append(evidence(segments, len(words), model))
                found.append([{"first": a, "last": b, "score": s, "p": p} for a, b, s, p in segments])
            y = labelled.calibrated(np.array(xs), model.ends, model.values) if xs else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y, pa.float64()), pa.array(found, kind)], ["doc_id", "score", "passages"])

    scored = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns."""
    place, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = []
            for x in batch.column(place).to_pylist():
                words = tokenised(x)
                xs.append(evidence(significant(passages(words, model), len(words), model), len(words), model))
            keep = labelled.calibrated(np.array(xs), model.ends, model.values) < THRESHOLD if xs else np.zeros(0, bool)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
