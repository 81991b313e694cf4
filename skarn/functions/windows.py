"""Hashes of token windows of any length, by prefix sums.

A text's tokens are 64-bit codes.  With ``S[i] = sum of mix(code[j]) * B**j over j < i`` (modulo 2**64) the
window of ``n`` codes from ``i`` has the value ``(S[i + n] - S[i]) * B**-i``, wherever it stands: two look-ups and
a product.  Two bases and salts give 128 bits.  As for every polynomial modulo 2**64, texts built for the purpose
(Thue-Morse words of over a thousand tokens) can collide; others do with a probability of about 2**-100 a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PART_TOKENS = 1 << 20
_BASES = [(0x9E3779B97F4A7C15, 0x1F83D9ABFB41BD6B), (0xD1342543DE82EF95, 0x5BE0CD19137E2179)]
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of a number reaches each bit of the result."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    if not _tables or len(_tables[0][0]) < n:
        tables = []
        for base, _ in _BASES:
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                t = np.full(max(n, PART_TOKENS + 65536), b, np.uint64)
                t[0] = 1
                pair.append(np.multiply.accumulate(t))
            tables.append(tuple(pair))
        _tables[:] = tables
    return _tables


class PrefixHashes:
    """Windows of ``codes`` (unsigned)."""

    def __init__(self, codes: np.ndarray) -> None:
        self.tables = _powers(len(codes) + 1)
        self.sums = []
        for (powers, _), (_, salt) in zip(self.tables, _BASES, strict=True):
            s = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(mixed(codes ^ np.uint64(salt)) * powers[: len(codes)], out=s[1:])
            self.sums.append(s)

    def windows(self, starts: np.ndarray, ends: np.ndarray, salts: np.ndarray | int = 0) -> list[np.ndarray]:
        """Two hashes of each window; windows of different salts or lengths differ."""
        extra = (ends - starts).astype(np.uint64) ^ np.asarray(salts).astype(np.uint64)
        return [mixed((s[ends] - s[starts]) * inverse[starts] + mixed(extra)).view(np.int64) for s, (_, inverse) in zip(self.sums, self.tables, strict=True)]


def sides(code: np.ndarray, offsets: np.ndarray, doc: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Codes of the tokens on either side; at a file's edge one that no other place has."""
    edge = mixed(doc.astype(np.uint64)[row] * np.uint64(2) + np.uint64(0x5851F42D4C957F2D))
    padded = np.concatenate((code, [0])).astype(np.uint64)
    before = np.where(starts > offsets[row], padded[starts - 1], edge)
    after = np.where(ends < offsets[row + 1], padded[ends], mixed(edge + np.uint64(1)))
    return [before.view(np.int64), after.view(np.int64)]


def codes(words: Column) -> Column:
    """Array of 64-bit codes of an array of tokens."""
    return F.transform(words, lambda w: F.xxhash64(w))


def parts(column: pa.Array, limit: int = PART_TOKENS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, offsets, codes) of runs of rows of about ``limit`` codes, one row at least."""
    sizes = np.asarray(pc.list_value_length(column).fill_null(0), dtype=np.int64)
    block = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(column)] if len(column) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        flat = np.asarray(column.slice(a, b - a).flatten()).view(np.uint64)
        yield a, b - a, np.concatenate(([0], np.cumsum(sizes[a:b]))), flat
