"""Sequence packing by minimum bin slack.

Each task tokenises its own rows and packs them in blocks of about ``BLOCK_TOKENS`` ids, so
nothing is shuffled, memory is bounded, and a lost task is simply redone (its rows, and with
them its sequence ids, are the same).  Within a block a document of over ``capacity`` ids
gives whole windows first; the remainders are packed by minimum bin slack: the longest
remainder opens a window, a subset-sum dynamic programme over the bits of one integer finds
the fill closest to capacity that the multiset of remaining lengths reaches, and backtracking
gives the count of each length.  Equal lengths are one entry with a count, so copies cost
nothing.  A fill that misses the capacity is closed by the first ids of one more remainder, whose rest goes
on as a shorter one; as any that fits would be in the best fill, one cut always does.  So however few documents a
task has, the programme chooses every window.  The last ids of a block, less than a window, are cut into
power-of-two sequences, which take no padding either.

Sequence ids: partition id * 2**36 + running number.

Defined cases: null or empty text is its end id alone; texts of any length are packed whole;
repeated rows are packed once each; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from operator import neg

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
END_ID = 2
BLOCK_TOKENS = 1 << 22
CACHE_WORDS = 600_000

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class WordIds:
    """Ids of whole texts, through bounded tables of the ids of chunks and of their pieces.

    The tokenizer drops white space and never joins over it, so a text's ids are the ids of
    its white-space separated chunks one after another.  A chunk of printable Latin-1
    characters needs no Unicode normalisation: it is lower-cased, cut by the tokenizer's own
    pre-tokenising pattern, and each piece goes through the tokenizer's model alone.  Every
    other chunk goes through the whole tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        stages = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"]
        self.cut = regex.compile(stages[0]["pattern"]["Regex"]).findall
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x100)}
        self.plain = re.compile(r"[!-~\xa1-\xff]+").fullmatch
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.misses = 0

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            text = piece if piece.isascii() else piece.translate(self.bytes)
            ids = array("I", [t.id for t in self.tokenize(text)]).tobytes()
            if len(self.pieces) < CACHE_WORDS:
                self.pieces[piece] = ids
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if self.plain(text) and "<|" not in text:
            return b"".join(map(self._piece, self.cut(text.lower())))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _age(self) -> None:
        """Full tables keep what they have; after many misses they start anew."""
        self.misses += 1
        if self.misses > 8 * CACHE_WORDS:
            self.known, self.pieces, self.misses = {}, {}, 0

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        chunks = text.split()
        out = list(map(self.known.get, chunks))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    ids = self.known.get(chunks[i])
                    if ids is None:
                        ids = self._chunk(chunks[i])
                        if len(self.known) < CACHE_WORDS:
                            self.known[chunks[i]] = ids
                        else:
                            self._age()
                    out[i] = ids
        return b"".join(out)


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table for each worker process and tokenizer."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def fill(lengths: list[int], counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int]], int]:
    """The (length, count) choice closest to ``capacity``, with the longest length in it, and
    its sum.  ``lengths`` are those with a count, longest first."""
    first = lengths[0]
    room = capacity - first
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for n in lengths:
        left = counts[n] - (n == first)
        if n > room or left < 1:
            continue
        left = min(left, room // n)
        k = 1
        while left:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            left -= k
            k *= 2
        if reach >> room:
            break
    best = reach.bit_length() - 1
    taken = {first: 1}
    at = best
    for n, k, before in reversed(steps):
        if not (before >> at) & 1:
            taken[n] = taken.get(n, 0) + k
            at -= n * k
    return sorted(taken.items(), reverse=True), first + best


def minimum_slack(remaining: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[list[int], int, int]]:
    """(lengths, length of the remainder that closes the window or 0, ids of it that are taken) of full windows.  Takes from
    ``remaining`` (length -> count) what they hold and leaves less than a window there."""
    left = sum(n * c for n, c in remaining.items())
    lengths = sorted((n for n, c in remaining.items() if c), reverse=True)
    while left >= capacity:
        choice, total = fill(lengths, remaining, capacity)
        window = []
        for n, c in choice:
            remaining[n] -= c
            window += [n] * c
        gap, closing = capacity - total, 0
        if gap:
            closing = next(n for n in lengths if remaining[n])
            remaining[closing] -= 1
            rest = closing - gap
            remaining[rest] = remaining.get(rest, 0) + 1
            if remaining[rest] == 1:
                at = bisect_left(lengths, -rest, key=neg)
                if at == len(lengths) or lengths[at] != rest:
                    lengths.insert(at, rest)
        left -= capacity
        lengths = [n for n in lengths if remaining[n]]
        yield window, closing, gap


class Block:
    """Documents gathered by one task until they are packed."""

    def __init__(self, capacity: int, number: int) -> None:
        self.capacity, self.number, self.docs, self.tokens = capacity, number, [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, ids))
        self.tokens += len(ids) // 4

    def pack(self) -> Iterator[tuple]:
        cap, remaining, holders = self.capacity, {}, {}

        def piece(d: int, start: int, length: int, offset: int) -> tuple:
            doc_id, ids = self.docs[d]
            return doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, self.number, offset

        for d, (_, ids) in enumerate(self.docs):
            n = len(ids) // 4
            for start in range(0, n - cap + 1, cap):
                yield piece(d, start, cap, 0)
                self.number += 1
            if n % cap:
                remaining[n % cap] = remaining.get(n % cap, 0) + 1
                holders.setdefault(n % cap, []).append((d, n - n % cap))
        for window, closing, gap in minimum_slack(remaining, cap):
            offset = 0
            for n in window:
                d, start = holders[n].pop()
                yield piece(d, start, n, offset)
                offset += n
            if closing:
                d, start = holders[closing].pop()
                yield piece(d, start, gap, offset)
                holders.setdefault(closing - gap, []).append((d, start + gap))
            self.number += 1
        rest = [(d, start, n) for n in sorted(holders, reverse=True) for d, start in holders[n]]
        left = sum(n for _, _, n in rest)
        size = offset = 0
        for d, start, n in rest:
            while n:
                if not size:
                    size = cap if left >= cap else 1 << (left.bit_length() - 1)
                take = min(n, size - offset)
                yield piece(d, start, take, offset)
                start, n, offset, left = start + take, n - take, offset + take, left - take
                if offset == size:
                    self.number, size, offset = self.number + 1, 0, 0
        self.docs, self.tokens = [], 0


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place in the sequences.  ``tokenizer`` is the path of a
    ``tokenizers`` file whose pre-tokeniser drops white space; it is there on all executors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer)
        context = TaskContext.get()
        block = Block(capacity, (context.partitionId() if context else 0) << 36)
        end = np.array([END_ID], "<u4").tobytes()

        def out() -> pa.RecordBatch:
            rows = list(block.pack())
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                part = [(x or "").encode() for x in texts.slice(at, 256).to_pylist()]
                for i, x in zip(ids[at : at + 256], part, strict=True):
                    block.add(i, known.ids(x) + end)
                    if block.tokens >= BLOCK_TOKENS:
                        yield out()
        if block.docs:
            yield out()

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(pack, SCHEMA)
