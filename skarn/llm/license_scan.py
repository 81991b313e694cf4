"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from ancestor directories.

*Statements*: each line of a text is a sparse TF-IDF vector over its words and is compared with
the licence templates by cosine; inverse document frequencies of the templates' words (a fixed,
small vocabulary) are counted over all texts, any other word counts as unseen.  Windows of
each template's length slide over all words, across line breaks and within long lines, and
are compared the same way; templates are also full licence texts, their titles with a date and usual notices (a
text shorter than one is compared whole).  Lines are compared with headings.  An SPDX tag states its licence.  What
is of ``SIMILARITY`` or more counts: the best full text, title or tag, else the best statement or notice, else the
first heading is the document's own licence.  A document whose words are mostly licence
statements, or whose name says so, is a *licence file* of its directory.

*Inheritance*: a document without a statement takes the licence of the nearest ancestor
directory (its own first) that has a licence file.  The distinct directories are found first, each
is exploded into its ancestors and joined with the licence files' directories by path, and
the result joins back by directory, so no join sees a row for each pair of documents.

Defined cases: null text is empty and has no statement; a null path is the root; ties go to the
higher cosine, then the first template by name, then the first line; of several licence files in a
directory the best cosine, then the smallest path wins; repeated rows are reported each; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.text import checkpointed

# Short forms of public licence statements.
TEMPLATES = {
    "AGPL-3.0": "licensed under the GNU Affero General Public License version 3",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-2-Clause": "licensed under the BSD 2-Clause License",
    "BSD-3-Clause": "licensed under the BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0 Creative Commons Attribution",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "released under CC0 1.0 public domain dedication",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Released under the ISC License",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "subject to the terms of the Mozilla Public License version 2.0",
}
FULL_TEXTS = Path(__file__).parent / "licences"
_FSF = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
TITLES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
]
NOTICES = [
    ("AGPL-3.0", _FSF.format("Affero General Public License", "3")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-2.0", _FSF.format("General Public License", "2")),
    ("GPL-3.0", _FSF.format("General Public License", "3")),
    ("LGPL-2.1", _FSF.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", _FSF.format("Lesser General Public License", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
# A heading without a version names the family.
HEADINGS = [
    ("AGPL", "GNU Affero General Public License"),
    ("Apache-2.0", "Apache License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("GPL", "GNU General Public License"),
    ("ISC", "ISC License"),
    ("LGPL", "GNU Lesser General Public License"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MPL", "Mozilla Public License"),
]
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*\(?([\w.+-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[\w.+-]+)*)", re.A)
SIMILARITY = 0.75
HOT_PARTS = 1000
FILE_SHARE = 0.5  # of the words, in statements: the document is a licence file
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"

terms_of = re.compile(r"[^\W_](?:[\w.+-]*\w)?").findall


def terms(text: str) -> list[str]:
    return terms_of(text.lower())


class Templates:
    """Unit TF-IDF vectors of the templates."""

    def __init__(self, templates: dict[str, str], frequency: dict[str, int], documents: int) -> None:
        self.unseen = self.idf_of(0, documents)
        self.idf = {t: self.idf_of(frequency.get(t, 0), documents) for x in templates.values() for t in terms(x)}
        self.weights: dict[str, list[tuple[str, float]]] = {}
        for name, text in sorted(templates.items()):
            v = {t: n * self.idf[t] for t, n in Counter(terms(text)).items()}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
            for t, x in v.items():
                self.weights.setdefault(t, []).append((name, x / norm))

    @staticmethod
    def idf_of(frequency: int, documents: int) -> float:
        return math.log((documents + 1) / (frequency + 1)) + 1

    def best(self, line: list[str]) -> tuple[float, str | None]:
        counts = Counter(line)
        dots: dict[str, float] = {}
        total = 0.0
        for t, n in counts.items():
            x = n * self.idf.get(t, self.unseen)
            total += x * x
            for name, w in self.weights.get(t, ()):
                dots[name] = dots.get(name, 0.0) + x * w
        if not dots:
            return 0.0, None
        name = min(dots, key=lambda k: (-dots[k], k))
        return dots[name] / math.sqrt(total), name


class Windows:
    """Long templates and statements, for windows over the words of a text."""

    def __init__(self, templates: list[tuple[str, int, str]], frequency: dict[str, int], documents: int) -> None:
        counts = [Counter(terms(x)) for *_, x in templates]
        self.names, self.ranks = [n for n, *_ in templates], [r for _, r, _ in templates]
        self.sizes = [sum(c.values()) for c in counts]
        self.code = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        # the last place is for all other words
        self.idf = np.array([Templates.idf_of(frequency.get(t, 0), documents) for t in self.code] + [Templates.idf_of(0, documents)])
        self.unit = np.zeros((len(counts), len(self.idf)))
        for row, c in zip(self.unit, counts, strict=True):
            for t, n in c.items():
                row[self.code[t]] = n * self.idf[self.code[t]]
            row /= np.sqrt((row**2).sum()) or 1.0
        self.squares = self.unit.T**2

    def found(self, words: list[str]) -> Iterator[tuple[int, float, int, int]]:
        """(template, cosine, first word, words) of all windows of SIMILARITY.  No window has a larger cosine
        than its share of the template's squared weights allows, nor than with all its words different."""
        other = len(self.code)
        present = self.code.keys() & set(words)
        if not present:
            return
        near = np.flatnonzero(self.squares[[self.code[t] for t in present]].sum(0) >= SIMILARITY**2)
        if not len(near):
            return
        ids: dict[str, int] = {}
        mine = [ids.setdefault(w, len(ids)) for w in words]
        codes = np.array([self.code.get(w, other) for w in words])
        idf = self.idf[codes]
        weight = (idf**2).tolist()
        length = np.concatenate(([0.0], np.cumsum(idf**2)))
        for k in near.tolist():
            n = min(self.sizes[k], len(words))
            dots = np.concatenate(([0.0], np.cumsum(self.unit[k][codes] * idf)))
            dot = dots[n:] - dots[:-n]
            at = np.flatnonzero(dot >= (SIMILARITY - 1e-9) * np.sqrt(length[n:] - length[:-n]))
            last, held, total = -2, Counter(), 0.0
            for p in at.tolist():
                if p != last + 1:
                    held = Counter(mine[p : p + n])
                    seen = dict(zip(mine[p : p + n], weight[p : p + n], strict=True))
                    total = sum(c * c * seen[w] for w, c in held.items())
                else:
                    gone, new = mine[p - 1], mine[p + n - 1]
                    total -= (2 * held[gone] - 1) * weight[p - 1]
                    held[gone] -= 1
                    total += (2 * held[new] + 1) * weight[p + n - 1]
                    held[new] += 1
                last = p
                score = min(float(dot[p] / math.sqrt(total)), 1.0)
                if score >= SIMILARITY:
                    yield k, score, p, n


def fit_templates(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES) -> Templates:
    """Counts the documents that hold each template word, over all texts."""
    full = [(p.stem, p.read_text()) for p in sorted(FULL_TEXTS.glob("*.txt"))]
    windows = [(n, 2, x) for n, x in [*full, *TITLES]] + [(n, 1, x) for n, x in [*sorted(templates.items()), *NOTICES]]
    vocabulary = frozenset(t for x in [*(x for *_, x in windows), *(x for _, x in HEADINGS)] for t in terms(x))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(terms(x or "")))
                seen[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    documents = found.pop("", 0)
    model = Templates(templates, found, documents)
    model.windows = Windows(windows, found, documents)
    model.headings = {tuple(sorted(terms(x))): n for n, x in HEADINGS}
    return model


def spdx_name(expression: str) -> str:
    """Without what says whether later versions hold."""
    return " ".join(re.sub(r"(-only|-or-later|\+)$", "", x) for x in expression.split())


def statement(text: str, model: Templates) -> tuple[str | None, float, int | None, float]:
    """(licence, cosine, line from 1, share of the words in statements) of one text."""
    best: tuple = (-1, 0.0, None, None)  # rank, cosine, licence, line
    words: list[str] = []
    firsts: list[int] = []
    spans: list[tuple[int, int]] = []
    for number, line in enumerate(text.split("\n"), 1):
        ts = terms(line)
        firsts.append(len(words))
        found = []
        if ts and sum(t in model.weights for t in ts) >= 0.3 * len(ts):
            score, name = model.best(ts)
            if score >= SIMILARITY:
                found.append((1, score, name))
        if ts and "spdx-license-identifier" in ts and (tag := SPDX.search(line)):
            found.append((2, 1.0, spdx_name(tag[1])))
        if ts and len(ts) <= 6 and (name := model.headings.get(tuple(sorted(ts)))):
            found.append((0, 1.0, name))
        for rank, score, name in found:
            spans.append((len(words), len(words) + len(ts)))
            if (rank, score) > best[:2]:
                best = (rank, score, name, number)
        words += ts
    taken = np.zeros(len(words), bool)
    for k, score, at, n in sorted(model.windows.found(words), key=lambda x: (-model.windows.ranks[x[0]], -x[1], x[2], x[0])):
        # of windows that overlap the best counts
        if not taken[at : at + n].any():
            taken[at : at + n] = True
        rank = model.windows.ranks[k]
        if (rank, score) > best[:2]:
            best = (rank, score, model.windows.names[k], bisect_right(firsts, at))
    for a, b in spans:
        taken[a:b] = True
    return best[2], best[1], best[3], int(taken.sum()) / len(words) if words else 0.0


def scan_licenses(docs: DataFrame, path: str = "path", doc_id: str = "doc_id", text: str = "text", model: Templates | None = None) -> DataFrame:
    """doc_id, path, license, cosine, line, origin (statement, file, inherited, none), and the
    directory it is inherited from."""
    model = model or fit_templates(docs, text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statement(x or "", model) for x in batch.column(2).to_pylist()]
            types = (pa.string(), pa.float64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["doc_id", "path", "license", "cosine", "line", "share"])

    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).cast("string").alias("text"))
    own = slim.mapInArrow(scan, "doc_id bigint, path string, license string, cosine double, line int, share double")
    own = own.withColumns({
        "directory": F.regexp_extract("path", r"^(.*)/[^/]*$", 1),
        "is_file": F.col("license").isNotNull() & ((F.col("share") >= FILE_SHARE) | F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAMES)),
    })
    own = checkpointed(own)
    files = own.where("is_file").groupBy("directory").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("f")).select(F.col("directory").alias("ancestor"), F.col("f.license").alias("file_license"))
    parts = F.split("directory", "/")
    sizes = own.groupBy("directory").agg(F.count("*").alias("n"))
    ancestors = sizes.select("directory").withColumn("ancestor", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    nearest = ancestors.join(files, "ancestor").groupBy("directory").agg(F.max(F.struct(F.length("ancestor").alias("n"), "ancestor", "file_license")).alias("a")).select("directory", F.col("a.ancestor").alias("from_directory"), F.col("a.file_license").alias("file_license"))
    inherits = F.col("license").isNull() & F.col("file_license").isNotNull()
    # a directory with more than 1 / HOT_PARTS of all rows would fill one task: there are fewer than HOT_PARTS
    # of them, so they are broadcast, and only the other rows are dealt by directory
    hot = F.broadcast(checkpointed(sizes.where(F.col("n") * HOT_PARTS > own.count()).select("directory").join(nearest, "directory", "left")))
    others = own.join(hot.select("directory"), "directory", "left_anti").join(nearest, "directory", "left")
    return own.join(hot, "directory").unionByName(others).select(
        "doc_id",
        "path",
        F.coalesce("license", "file_license").alias("license"),
        F.when(F.col("license").isNotNull(), F.col("cosine")).alias("cosine"),
        "line",
        F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "statement").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(inherits, F.col("from_directory")).alias("from_directory"),
    )
