"""Shared text primitives of the training-data operators.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z (only these 26
letters).  ``bytes.lower``/``bytes.split`` on UTF-8 implement exactly this, as no byte of a
multi-byte character is an ASCII letter or ASCII white space.

:func:`word_hashes` hashes all words of an Arrow string array without a Python loop: a
polynomial hash over the bytes (each byte mapped through a table of 64-bit constants),
finished by a 64-bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.session import checkpointed  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 3 << 19

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))[_FOLD]
_BYTE[_SPACES] = 0
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 65536)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0], _powers[1]


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_column(text: Column) -> Column:
    """The words of a text as an array, native."""
    return F.filter(F.split(lower_ascii(text), SPACE_CLASS), lambda w: w != "")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Cuts an Arrow string array into runs of rows of about ``limit`` bytes (one row at least)."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    block = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)] if len(texts) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield a, texts.slice(a, b - a)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, in order, and the offset of each row's first word (one more at the end)."""
    texts = texts.fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    n, bufs = len(texts), texts.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[texts.offset : texts.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if last == first:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[first:last]
    bounds = offsets - first
    inside = ~_SPACES[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    row_first = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), row_first
    powers, inverses = _power_tables(len(data))
    sums = np.add.reduceat(_BYTE[data] * powers[: len(data)], starts)
    return _mix(sums * inverses[starts]), row_first


def shingle_hashes(words: np.ndarray, row_first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles with the row of each; a row of 1 to k-1 words has one
    shingle, its whole sequence; a row without words has none."""
    counts = np.diff(row_first)
    rows = np.repeat(np.arange(len(counts)), counts)
    n = len(words)
    if not n:
        return words, rows
    whole = max(n - k + 1, 0)
    out = np.zeros(whole, np.uint64)
    for j in range(k):
        out = _mix(out + words[j : j + whole]) if j else _mix(words[:whole])
    ok = rows[:whole] == rows[k - 1 :] if whole else np.zeros(0, bool)
    hashes, owners = out[ok], rows[:whole][ok]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        at, size = np.asarray(row_first)[short], counts[short]
        extra = _mix(words[at])
        for j in range(1, k - 1):
            more = np.flatnonzero(size > j)
            extra[more] = _mix(extra[more] + words[at[more] + j])
        extra = _mix(extra + size.astype(np.uint64))
        hashes, owners = np.concatenate([hashes, extra]), np.concatenate([owners, short])
    return hashes, owners


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
