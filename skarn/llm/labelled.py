"""A bounded, deterministic choice of labelled training rows, and monotone calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.text import _mix, checkpointed, shingle_hashes, slices, word_hashes

LABELLED_ROWS = 20_000  # bound on the labelled rows that a classifier is fitted on
CALIBRATION_BINS = 400
SKETCHES = 3


def held_out(doc_id: Column, folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = LABELLED_ROWS, distinct: bool = False) -> DataFrame:
    """(label, text) of at most ``rows`` labelled documents that aren't held out: the first by a
    hash of the id.  The chosen ids are broadcast: their number is bounded by ``rows``.  An id with
    both labels has none; of several texts with one id the least counts.
    With ``distinct``, a row goes if an earlier one shares a minimum hash with it: copies and near
    copies count once."""
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_other"))
        .where("label = _other")
        .select("_id", "label")
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = checkpointed(texts.join(F.broadcast(chosen), "_id").groupBy("_id", "label").agg(F.min("text").alias("text")))
    if not distinct:
        return held.select("label", "text")
    names = ["_id", "label", *(f"h{i}" for i in range(SKETCHES))]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = minimum_hashes(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(rows[:, i]) for i in range(SKETCHES))], names)

    schema = "_id bigint, label int, " + ", ".join(f"h{i} bigint" for i in range(SKETCHES))
    seen: set = set()
    kept = []
    for r in sorted(tuple(r) for r in held.mapInArrow(sketch, schema).collect()):  # one row for each chosen id
        marks = {(i, h) for i, h in enumerate(r[2:])}
        if not marks & seen:
            kept.append(r[:1])
        seen |= marks
    return held.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "_id bigint")), "_id").select("label", "text")


def minimum_hashes(texts: pa.Array) -> np.ndarray:
    """SKETCHES minimum hashes of each text's three-word shingles."""
    out = np.zeros((len(texts), SKETCHES), np.int64)
    for at, part in slices(texts.fill_null("").cast(pa.large_string())):
        hashes, owners = shingle_hashes(*word_hashes(part), 3)
        for i in range(SKETCHES):
            least = np.full(len(part), np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, owners, _mix(hashes + np.uint64(i + 1)))
            out[at : at + len(part), i] = least.view(np.int64)
    return out


def isotonic(x: np.ndarray, weight: np.ndarray, positive: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins sorted by ``x``: (upper ends, values that never fall).
    Each pool's rate is drawn towards the overall rate by ``prior`` rows."""
    if not len(x) or not weight.sum():
        return np.zeros(0), np.array([0.5])
    base = positive.sum() / weight.sum()
    pools: list[list[float]] = []
    for at, w, p in zip(x, weight, positive, strict=True):
        pools.append([float(at), float(w), float(p)])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            end, w2, p2 = pools.pop()
            pools[-1] = [end, pools[-1][1] + w2, pools[-1][2] + p2]
    values = np.array([(p + prior * base) / (w + prior) for _, w, p in pools])
    return np.array([p[0] for p in pools[:-1]]), np.maximum.accumulate(values)


def calibrated(score: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    return values[np.searchsorted(ends, score, side="left")]
