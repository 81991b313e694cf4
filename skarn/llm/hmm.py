"""Language-model scores from a hidden Markov model.

*Counts*: every word of every training text is counted; the table of counts grows with the corpus
and stays distributed.  A bounded number of the most frequent words (``LOOKUP``) is sent to the
executors; the other words of a text meet their counts in a join by word.

*Model*: states emit symbols; a symbol is one of the ``OWN`` most frequent words, the end, or a class
of words (by their last letters, ``CLASSES`` of them), and a class emits a word with
``(c + 1) / (N_class + V_class + 1)``.  So the parameters have a fixed size while every word keeps
its own count.  Baum-Welch: each partition computes the expected counts of its share of the training
texts, the sums over all partitions give the next model.  Texts are whole sequences; long ones are
worked on in pieces, with the exact state before and the exact likelihood after each piece.  The first
guess and all rounds see all texts, and none depends on how the rows are dealt.

*Score*: the scaled forward recursion gives the exact log10 likelihood of each whole text, its end
included; ``base_score`` is the add-one unigram score.

Defined cases: null text is empty, which is one end token; a null id is a training row; without
training rows all counts are 0 and the model is uniform; repeated rows are counted and scored each;
texts of any length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.labelled import held_out
from skarn.llm.text import checkpointed, slices

FOLDS = 7
LOOKUP = 100_000
OWN = 2_000
CLASSES = 1_024
STATES = 8
ROUNDS = 20  # at most; what ends the training is GAIN
GAIN = 1e-3  # a round that improves the log likelihood of the training texts by a smaller part is the last
GUESSES = 2
PIECE = 1024  # symbols of a text that are worked on at once; what is before and after is carried exactly
GROUP = 1024  # pieces that are worked on at once
BLOCK = 1 << 20
END = b"\n"  # no word holds white space
FLUSH_WORDS = 2_000_000
SLICE = 1 << 22  # bytes of text whose words are looked up at once


def word_class(word: bytes) -> int:
    return OWN + 1 + zlib.crc32(word[-3:]) % CLASSES


SYMBOLS = OWN + 1 + CLASSES


@dataclass
class Lexicon:
    words: pa.Array  # that are looked up
    symbol: np.ndarray
    log_count: np.ndarray  # log10(c + 1)
    tokens: int
    types: int
    class_log: np.ndarray  # by symbol: log10(N_class + V_class + 1); 0 for a symbol of its own
    ends: int

    def symbols(self, words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols of texts of ``sizes`` words, an end after each; each word's symbol; its place in the lookup or -1)."""
        at = np.asarray(pc.index_in(words, value_set=self.words).fill_null(-1), dtype=np.int64)
        each = self.symbol[at] if len(self.symbol) else np.zeros(len(at), np.int16)
        gone = np.flatnonzero(at < 0)
        each[gone] = [word_class(w) for w in words.take(pa.array(gone)).to_pylist()]
        out = np.full(len(at) + len(sizes), OWN, np.int16)
        out[np.arange(len(at)) + np.repeat(np.arange(len(sizes)), sizes)] = each
        return out, each, at


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (as ``words_of`` gives them), and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, sizes = lists.flatten().cast(pa.binary()), np.asarray(pc.list_value_length(lists), dtype=np.int64)
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    if full.all():
        return words, sizes
    return words.filter(pa.array(full)), np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full], minlength=len(sizes))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) of all training texts; END has the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[pa.Array], texts: int) -> pa.RecordBatch:
            seen = pa.chunked_array(parts, pa.binary()).value_counts()
            words = pa.concat_arrays([seen.field("values"), pa.array([END], pa.binary())])
            return pa.RecordBatch.from_arrays([words, pa.concat_arrays([seen.field("counts"), pa.array([texts], pa.int64())])], ["word", "n"])

        parts, texts, size = [], 0, 0
        for batch in batches:
            for _, part in slices(batch.column(0), SLICE):
                parts.append(words_in(part)[0])
                texts += len(part)
                size += len(parts[-1])
                if size > FLUSH_WORDS:
                    yield out(parts, texts)
                    parts, texts, size = [], 0, 0
        yield out(parts, texts)

    return train.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(counts: DataFrame) -> Lexicon:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    steps = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("b")).count().collect()
    least, kept = None, 0
    for b, k in sorted(((r[0], r[1]) for r in steps), reverse=True):
        if kept + k > LOOKUP:
            break
        least, kept = b, kept + k
    rows = counts.where(F.floor(F.log2("n") * 8) >= least).collect() if least is not None else []
    rows = sorted(((bytes(r.word), r.n) for r in rows), key=lambda r: (-r[1], r[0]))
    ends = next((n for w, n in rows if w == END), 0) or counts.where(F.col("word") == F.lit(bytearray(END))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = [r for r in rows if r[0] != END]
    own = frozenset(w for w, _ in rows[:OWN])

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w not in own and w != END:
                    k = word_class(w)
                    n[k] += c
                    v[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SYMBOLS)), pa.array(n), pa.array(v)], ["k", "n", "v"])

    sums = counts.mapInArrow(classes, "k bigint, n bigint, v bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    class_log = np.zeros(SYMBOLS)
    for r in sums:
        if r.k > OWN:
            class_log[r.k] = math.log10(r.n + r.v + 1)
    symbol = np.array([i if i < OWN else word_class(w) for i, (w, _) in enumerate(rows)], np.int16)
    log_count = np.log10(np.array([n for _, n in rows], float) + 1)
    return Lexicon(pa.array([w for w, _ in rows], pa.binary()), symbol, log_count, total[0], total[1], class_log, ends)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol, state


@dataclass
class Pieces:
    """Texts cut into pieces of at most PIECE symbols, with what the rest of its text says to each piece, so that
    all pieces can be worked on at once and the result is that of whole texts."""

    text: np.ndarray  # number of each piece's text
    first: np.ndarray  # place of its first symbol
    length: np.ndarray
    prior: np.ndarray  # of its first state, given all symbols before
    before: np.ndarray  # state before its first symbol, given all symbols before; 0 in a text's first piece
    after: np.ndarray  # likelihood of all symbols after it by its last state, up to a factor


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """GROUP places at a time, by falling length."""
    order = np.argsort(-lengths, kind="stable")
    for i in range(0, len(order), GROUP):
        yield order[i : i + GROUP]


def _lasting(lengths: np.ndarray) -> list[int]:
    """Of falling lengths, the number of those that still last at each step."""
    return np.searchsorted(-lengths, -np.arange(lengths[0]), side="left").tolist()


def transfers(model: Model, symbols: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each piece (by falling length) the matrix that carries the prior of its first state to its last
    state, up to a factor."""
    states = len(model.start)
    x = np.zeros((len(lengths), states, states))
    ones = np.ones(states * states)
    for t, n in enumerate(_lasting(lengths)):
        e = model.emit[symbols[firsts[:n] + t]]
        y = (x[:n].reshape(-1, states) @ model.move).reshape(n, states, states) * e[:, None, :] if t else e[:, :, None] * np.eye(states)
        x[:n] = y / (y.reshape(n, -1) @ ones)[:, None, None]
    return x


def pieces_of(model: Model, symbols: np.ndarray, lengths: np.ndarray, both_ways: bool = True) -> Pieces:
    """The pieces of texts of ``lengths`` symbols; ``after`` is only filled if ``both_ways``."""
    states = len(model.start)
    counts = -(-lengths // PIECE)
    text = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = Pieces(
        text,
        np.repeat(np.cumsum(lengths) - lengths, counts) + number * PIECE,
        np.minimum(PIECE, np.repeat(lengths, counts) - number * PIECE),
        np.tile(model.start, (len(text), 1)),
        np.zeros((len(text), states)),
        np.ones((len(text), states)),
    )
    several = np.flatnonzero(counts[text] > 1)
    if not len(several):
        return out
    matrix = np.empty((len(several), states, states))
    for part in _groups(out.length[several]):
        matrix[part] = transfers(model, symbols, out.first[several[part]], out.length[several[part]])
    place = np.full(len(text), -1)
    place[several] = np.arange(len(several))
    tops = counts[counts > 1]
    ends = np.cumsum(counts)[counts > 1]
    by = np.argsort(-tops, kind="stable")
    tops, ends = tops[by], ends[by]
    for k in range(1, int(tops[0])):
        n = int(np.searchsorted(-tops, -k, side="left"))  # texts of more than k pieces
        now = ends[:n] - tops[:n] + k
        v = np.einsum("nk,nkl->nl", out.prior[now - 1], matrix[place[now - 1]])
        out.before[now] = v / v.sum(1, keepdims=True)
        out.prior[now] = out.before[now] @ model.move
        if both_ways:
            now = ends[:n] - 1 - k
            v = np.einsum("nkl,nl->nk", matrix[place[now + 1]], out.after[now + 1]) @ model.move.T
            out.after[now] = v / v.sum(1, keepdims=True)
    return out


def forward(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 likelihood of each text of symbols."""
    pieces = pieces_of(model, symbols, lengths, both_ways=False)
    onward, emits = np.ascontiguousarray(model.move.T), np.ascontiguousarray(model.emit.T)  # a row for each state, as in ``expectation``
    logs = np.zeros(len(pieces.text))
    for part in _groups(pieces.length):
        at, lasting = pieces.first[part], _lasting(pieces.length[part])
        mine = np.zeros(len(part))
        alpha = np.ascontiguousarray(pieces.prior[part].T)
        for t, n in enumerate(lasting):
            alpha = (onward @ alpha[:, :n] if t else alpha) * emits.take(symbols[at[:n] + t], axis=1)
            scale = alpha.sum(0)
            alpha /= scale
            mine[:n] += np.log10(scale)
        logs[part] = mine
    return np.bincount(pieces.text, weights=logs, minlength=len(lengths))


def expected(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (start, move, emit) of whole texts of symbols."""
    return expectation(model, symbols, lengths)[:3]


def expectation(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The expected counts, forward, then backward; and the log10 likelihood of the texts."""
    pieces = pieces_of(model, symbols, lengths)
    states = len(model.start)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((SYMBOLS, states))
    # A row for each state: numpy then works along the pieces, not along the few states.
    onward, back, emits = np.ascontiguousarray(model.move.T), np.ascontiguousarray(model.move), np.ascontiguousarray(model.emit.T)
    log = 0.0
    for part in _groups(pieces.length):
        at, lasting = pieces.first[part], _lasting(pieces.length[part])
        prior, before, after = (np.ascontiguousarray(x[part].T) for x in (pieces.prior, pieces.before, pieces.after))
        ends = np.cumsum(lasting)
        seen = symbols[np.concatenate([at[:n] + t for t, n in enumerate(lasting)])]  # step by step
        scaled, alphas, scales = emits.take(seen, axis=1), np.empty((states, len(seen))), np.empty(len(seen))
        steps = [slice(end - n, end) for end, n in zip(ends.tolist(), lasting, strict=True)]
        for t, (n, now) in enumerate(zip(lasting, steps, strict=True)):
            a, e, c = alphas[:, now], scaled[:, now], scales[now]
            np.multiply(onward @ last[:, :n] if t else prior, e, out=a)
            a.sum(0, out=c)
            by = 1 / c
            a *= by
            e *= by
            last = a
        log += float(np.log10(scales).sum())
        beta = after[:, :0]
        for t in range(len(lasting) - 1, -1, -1):
            n, a = beta.shape[1], alphas[:, steps[t]]
            ending = after[:, n : lasting[t]]
            if ending.shape[1]:
                ending = ending / (a[:, n:] * ending).sum(0)
            if n:
                ahead = scaled[:, steps[t + 1]] * beta
                move += a[:, :n] @ ahead.T
                beta = back @ ahead
                beta = np.concatenate([beta, ending], axis=1) if ending.shape[1] else beta
            else:
                beta = ending
            a *= beta  # now the probability of each state
        move += before @ (scaled[:, steps[0]] * beta).T
        start += alphas[:, steps[0]][:, ~before.any(0)].sum(1)
        emit += np.stack([np.bincount(seen, weights=alphas[k], minlength=SYMBOLS) for k in range(states)], 1)
    return start, move * model.move, emit, log


def training_texts(train: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Blocks of whole texts: (lengths, symbols) as packed numbers of 32 and 16 bits."""
    held = train.sparkSession.sparkContext.broadcast(lexicon)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def out() -> pa.RecordBatch:
            lengths, symbols = (np.concatenate(x).astype(kind).tobytes() for x, kind in zip(zip(*parts, strict=True), ("<i4", "<i2"), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([lengths], pa.binary()), pa.array([symbols], pa.binary())], ["lengths", "symbols"])

        for batch in batches:
            for _, part in slices(batch.column(0), SLICE):
                words, sizes = words_in(part)
                symbols, lengths = held.value.symbols(words, sizes)[0], sizes + 1
                ends = np.cumsum(lengths)
                cuts = [0, *(np.flatnonzero(np.diff(ends // BLOCK)) + 1).tolist(), len(ends)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    parts.append((lengths[a:b], symbols[ends[a] - lengths[a] : ends[b - 1]]))
                    size += len(parts[-1][1])
                    if size >= BLOCK:
                        yield out()
                        parts, size = [], 0
        if parts:
            yield out()

    return train.select("text").mapInArrow(blocks, "lengths binary, symbols binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        yield np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(b, "<i2")


def first_guess(texts: DataFrame, overall: np.ndarray, states: int) -> Model:
    """Each piece of a text starts in one state: by the greatest of fixed random projections of its
    symbol counts (centred, in units of their root), then ``GUESSES`` times by the nearest of the
    states' own means.  All counts are of all texts and whole numbers, so the guess does not depend
    on how the rows are dealt."""
    root = np.sqrt(overall)
    directions = np.random.default_rng(0).standard_normal((SYMBOLS, states))
    emit = np.tile(overall[:, None], (1, states))
    for _ in range(1 + GUESSES):
        weight, centre = directions / root[:, None], directions.T @ root

        def deal(batches: Iterator[pa.RecordBatch], weight=weight, centre=centre) -> Iterator[pa.RecordBatch]:
            total = np.zeros((states, SYMBOLS))
            for batch in batches:
                for lengths, symbols in _unpacked(batch):
                    counts = -(-lengths // PIECE)
                    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    firsts = np.repeat(np.cumsum(lengths) - lengths, counts) + number * PIECE
                    sizes = np.diff(np.append(firsts, len(symbols)))
                    for i in range(0, len(firsts), GROUP):
                        a, n = firsts[i : i + GROUP], sizes[i : i + GROUP]
                        mine = symbols[a[0] : a[-1] + n[-1]]
                        own = (np.add.reduceat(weight[mine], a - a[0]) - n[:, None] * centre).round(6).argmax(1)
                        total += np.bincount(np.repeat(own, n) * SYMBOLS + mine, minlength=states * SYMBOLS).reshape(states, SYMBOLS)
            yield _sums(total.ravel())

        found = _added(texts, deal, states * SYMBOLS).reshape(states, SYMBOLS).T
        sizes = found.sum(0)
        emit = 0.5 * overall[:, None] + 0.5 * np.where(sizes > 0, found / np.maximum(sizes, 1), overall[:, None])
        directions = np.where(sizes > 0, (found / np.maximum(sizes, 1) - overall[:, None]) / root[:, None], directions)
        directions = directions / (np.linalg.norm(directions, axis=0) + 1e-12)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def fit(texts: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> Model:
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SYMBOLS)
        for batch in batches:
            for _, symbols in _unpacked(batch):
                n += np.bincount(symbols, minlength=SYMBOLS)
        yield _sums(n)

    overall = _added(texts, totals, SYMBOLS) + 0.5
    overall /= overall.sum()
    model = first_guess(texts, overall, states)
    size = states + states * states + SYMBOLS * states
    log = -math.inf
    for _ in range(rounds):

        def share(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + 1)
            for batch in batches:
                for lengths, symbols in _unpacked(batch):
                    total += np.concatenate([np.ravel(x) for x in expectation(model, symbols, lengths)])
            yield _sums(total)

        *c, now = _added(texts, share, size + 1)
        c = np.array(c)
        start = c[:states] + 1
        move = c[states : states + states * states].reshape(states, states) + 1
        emit = c[states + states * states :].reshape(SYMBOLS, states) + 50 * overall[:, None]
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        # The likelihood is that of the model before this round.
        if now - log < GAIN * abs(now):
            break
        log = now
    return model


def _sums(x: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(x)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(x[at], pa.float64())], ["k", "v"])


def _added(df: DataFrame, partial, size: int) -> np.ndarray:
    got = df.mapInArrow(partial, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[got.k.to_numpy(dtype=np.int64)] = got.v.to_numpy(dtype=float)
    return out


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    train = slim.where(~held_out(F.col("doc_id"), FOLDS))
    counts = checkpointed(word_counts(train))
    lexicon = build_lexicon(counts)
    model = fit(checkpointed(training_texts(train, lexicon)), states, rounds)
    held = docs.sparkSession.sparkContext.broadcast((lexicon, model))
    base_log = math.log10(lexicon.tokens + lexicon.types + 1)
    end_log, end_known = math.log10(lexicon.ends + 1), int(lexicon.ends > 0)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with a word that no text has, and one for each of its words that
        isn't in the lookup."""
        lexicon, model = held.value
        context = TaskContext.get()
        key = (context.partitionId() if context else 0) << 33
        pending: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            docs, *facts, symbols, places, words, times = zip(*pending, strict=True)
            lengths, known, base, own = (np.concatenate(x) for x in facts)
            own = own + forward(model, np.concatenate(symbols).astype(np.int64), lengths)
            keys, others = key + np.arange(len(lengths)), np.concatenate(places)
            none = lambda kind: pa.nulls(len(others), kind)
            facts = [pa.concat_arrays([pa.array(x), none(pa.array(x).type)]) for x in (lengths, known, base, own)]
            return pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([keys, keys[others]])),
                pa.concat_arrays([*docs, none(pa.int64())]),
                *facts,
                pa.concat_arrays([pa.array([END + b"%d" % k for k in keys.tolist()], pa.binary()), *words]),
                pa.array(np.concatenate([np.zeros(len(keys), np.int64), *times])),
            ], ["key", "doc_id", "n_tokens", "known", "base", "own", "word", "times"])

        seen = 0
        for batch in batches:
            for first, part in slices(batch.column(1), SLICE):
                words, sizes = words_in(part)
                symbols, each, at = lexicon.symbols(words, sizes)
                texts, lengths = len(sizes), sizes + 1
                owner, end = np.repeat(np.arange(texts), sizes), np.repeat(np.arange(texts), lengths)
                found = at >= 0
                total = lambda of, values: np.bincount(of, weights=values, minlength=texts)  # noqa: B023, E731
                logs = np.where(found, lexicon.log_count[at], 0.0) if len(lexicon.log_count) else np.zeros(len(at))
                base = total(owner, logs) + end_log - lengths * base_log
                own = total(owner, np.where(each >= OWN, logs, 0.0)) - total(end, lexicon.class_log[symbols])
                known = np.bincount(owner[found], minlength=texts) + end_known
                # Each other word of a text once, with how often it occurs there.
                coded = words.filter(pa.array(~found)).dictionary_encode()
                kinds = max(len(coded.dictionary), 1)
                pairs, times = np.unique(owner[~found] * kinds + np.asarray(coded.indices, dtype=np.int64), return_counts=True)
                pending.append((batch.column(0).slice(first, texts), lengths, known, base, own, symbols, pairs // kinds + seen, coded.dictionary.take(pa.array(pairs % kinds)), times))
                seen += texts
                size += len(symbols)
                if size >= 2 * BLOCK:
                    yield out()
                    key += seen
                    pending, seen, size = [], 0, 0
        if pending:
            yield out()

    schema = "key bigint, doc_id bigint, n_tokens bigint, known bigint, base double, own double, word binary, times bigint"
    met = slim.mapInArrow(parts, schema).join(counts, "word", "left")
    rest = F.coalesce(F.col("times") * F.log10(F.col("n") + 1), F.lit(0.0))
    whole = met.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0))).alias("n_known"),
        (F.max("base") + F.sum(rest)).alias("base_score"),
        (F.max("own") + F.sum(rest)).alias("score"),
    )
    return whole.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "n_tokens", "n_known", F.lit(lexicon.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
