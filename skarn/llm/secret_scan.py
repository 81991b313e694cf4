"""Secret scan: fixed patterns plus a randomness test battery.

Patterns give the kinds ``assign``, ``access`` and ``hex``.  The battery adds the kind
``random``: for each run of 20 or more key characters an encoding is inferred (hex, base32,
base62, base64, base64url), then three tests are made over that alphabet,

* chi-squared uniformity of the characters,
* the runs test above and below the alphabet's middle,
* the lag-1 serial correlation,

and joined by Fisher's method.  A run that uniform randomness explains (``p >= alpha``) is
kept if ordinary text doesn't: ``p_text`` is the chance that text of this length looks as
uniform (non-central chi-squared; the non-centrality grows with the length), and
Benjamini-Hochberg over all candidates of the corpus with the same encoding and length class
holds the false-discovery rate at ``q``.  Its thresholds come from a histogram that all
partitions fill (a fixed number of bins), so nothing unbounded reaches the driver.

Defined cases: null text counts as empty and has no spans; whole texts of any length are
scanned; repeated rows are scanned alike and all kept; an empty table gives an empty result;
columns of the input that clash with the outputs are replaced.  Offsets are code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

ALPHA = 0.001
FALSE_DISCOVERY_RATE = 0.01
TEXT_COINCIDENCE = 0.0667  # chance that two letters of English text are equal
HEX_COINCIDENCE = 0.15  # the same for text that only has 0-9 and a-f
BINS, BINS_PER_DECADE = 241, 4

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
_ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "base32": _UPPER + "234567",
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_INDEX = {k: {c: i for i, c in enumerate(a)} for k, a in _ALPHABETS.items()}


def infer_encoding(run: str) -> str | None:
    """The smallest alphabet whose signs of use the run shows; None for what looks like words or numbers."""
    digit, lower, upper = (any(a <= c <= z for c in run) for a, z in ("09", "az", "AZ"))
    if digit and (lower != upper) and all(c in _INDEX["hex"] for c in run.lower()):
        return "hex"
    if digit and upper and not lower and all(c in _INDEX["base32"] for c in run):
        return "base32"
    if not (digit and lower and upper):
        return None
    plus, dash = any(c in "+/" for c in run), any(c in "-_" for c in run)
    return None if plus and dash else "base64" if plus else "base64url" if dash else "base62"


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_tail(x: float, k: float) -> float:
    """Wilson-Hilferty."""
    return _normal_tail(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def battery(run: str, encoding: str) -> tuple[float, float]:
    """(p under uniform randomness, p under text) of a run."""
    index, size, n = _INDEX[encoding], len(_ALPHABETS[encoding]), len(run)
    at = [index[c] for c in (run.lower() if encoding == "hex" else run)]
    expected = n / size
    chi2 = sum((c - expected) ** 2 for c in Counter(at).values()) / expected + (size - len(set(at))) * expected
    p = [_chi2_tail(chi2, size - 1)]
    high = [a >= size / 2 for a in at]
    n1, n0 = sum(high), n - sum(high)
    if n1 and n0:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        mean = 1 + 2 * n1 * n0 / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p.append(2 * _normal_tail(abs(runs - mean) / math.sqrt(var)))
    else:
        p.append(2.0 ** (1 - n))
    m = sum(at) / n
    spread = sum((a - m) ** 2 for a in at)
    serial = sum((a - m) * (b - m) for a, b in zip(at, at[1:], strict=False)) / spread if spread else 1.0
    p.append(2 * _normal_tail(abs(serial) * math.sqrt(n)))
    uniform = _chi2_tail(-2 * sum(math.log(max(x, 1e-300)) for x in p), 2 * len(p))
    shift = n * max(size * (HEX_COINCIDENCE if encoding == "hex" else TEXT_COINCIDENCE) - 1, 0)
    text = _normal_tail((size - 1 + shift - chi2) / math.sqrt(2 * (size - 1 + 2 * shift)))
    return uniform, text


def length_class(n: int) -> int:
    return n.bit_length()


def _bin(p: float) -> int:
    return min(int(-math.log10(max(p, 1e-300)) * BINS_PER_DECADE), BINS - 1)


def candidates(text: str) -> Iterator[tuple[int, int, str, int, int]]:
    """(start, end, encoding, length class, bin of p_text) of the runs that randomness explains."""
    for m in RUN.finditer(text):
        run = m.group().rstrip("=")
        encoding = infer_encoding(run)
        if encoding:
            uniform, other = battery(run, encoding)
            if uniform >= ALPHA:
                yield m.start(), m.end(), encoding, length_class(len(run)), _bin(other)
            else:
                yield m.start(), m.end(), encoding, length_class(len(run)), -1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the fixed patterns, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def fit_thresholds(docs: DataFrame, text: str = "text", q: float = FALSE_DISCOVERY_RATE) -> dict[tuple[str, int], int]:
    """Smallest accepted bin of p_text by (encoding, length class): Benjamini-Hochberg on the
    histogram of all candidates of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                for _, _, encoding, n, b in candidates(x or ""):
                    seen[encoding, n, b] += 1
        rows = [(*k, v) for k, v in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["encoding", "length", "bin", "n"])

    found = docs.select(F.col(text).cast("string")).mapInArrow(count, "encoding string, length int, bin int, n bigint")
    cells: dict[tuple[str, int], Counter] = {}
    for r in found.groupBy("encoding", "length", "bin").agg(F.sum("n").alias("n")).collect():
        cells.setdefault((r.encoding, r.length), Counter())[r.bin] += r.n
    out = {}
    for key, by_bin in cells.items():
        total, above, least = sum(by_bin.values()), 0, BINS
        for b in range(BINS - 1, -1, -1):
            above += by_bin[b]
            if above and 10 ** (-b / BINS_PER_DECADE) * total / above <= q:
                least = b
        out[key] = least
    return out


def all_spans(text: str, base: list[tuple[int, int, int]], least: dict[tuple[str, int], int]) -> list[tuple[int, int, int]]:
    """The base spans and those of the battery that no base span overlaps."""
    more = []
    for start, end, encoding, n, b in candidates(text):
        if b >= least.get((encoding, n), BINS) and not any(s < end and start < e for s, _, e in base):
            more.append((start, 3, end))
    return sorted(base + more) if more else base


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


OUTPUTS = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, redacted string"


def scan_secrets(docs: DataFrame, text: str = "text", thresholds: dict[tuple[str, int], int] | None = None, mask: str | None = None) -> DataFrame:
    """The rows of ``docs`` with the spans of every text; ``redacted`` has each span replaced by
    ``mask`` (null if no mask is given)."""
    least = fit_thresholds(docs, text) if thresholds is None else thresholds
    names = [x.split()[0] for x in OUTPUTS.split(", ")]
    kept = docs.drop(*(n for n in names if n != text))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), OUTPUTS])
    columns = kept.columns
    place = columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(place).to_pylist():
                x = x or ""
                base = base_spans(x)
                spans = all_spans(x, base, least)
                per = Counter(k for _, k, _ in base)
                clean = None
                if mask is not None:
                    parts, at = [], 0
                    for s, _, e in spans:
                        if s >= at:
                            parts += [x[at:s], mask]
                        at = max(at, e)
                    clean = "".join([*parts, x[at:]])
                rows.append((per[0], per[1], per[2], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), clean))
            types = [pa.int64()] * 3 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], [*columns, *names])

    return kept.mapInArrow(scan, schema)
