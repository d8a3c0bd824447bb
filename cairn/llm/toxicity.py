"""Toxicity by a convolutional text classifier, trained on all labelled rows in parallel.

A word's vector is the hashed embedding of the word and that of its first ``PREFIX`` bytes, side by
side. Filters of several widths run over the word vectors (zeros behind the last word), the
maximum over the text is taken after a rectifier, and a logistic layer scores the text. The first
coordinate of both embeddings starts from the smoothed log-odds of its bucket among the training
texts, the rest from small random numbers of a fixed seed; embeddings, filters and output layer are
then trained together. Scoring runs over every word of every text.

All labelled rows outside the held-out fold train the model. They are dealt to parts by a hash of the
id, as many as have ``PART_ROWS`` rows or ``PART_BYTES`` of text each. In a round every part goes over its
rows from the common model by itself, and the parts' changes are averaged: those of a word's vector by
how often a part changed it, the others by rows. Sums are of whole numbers, so no order of tasks shows
in them. The first log-odds are counted over all rows.

Each language has the threshold with the fewest errors, in steps of ``1 / BINS``, which gives the column
``flagged``. All labelled rows count for it, each with the score of a model that didn't see it: beside
the model of all rows, one is trained in the same rounds on either half, and scores the other half.
Neither language nor labels, source or id take part in a score. Where a doc_id has several rows, the
one with the least text stands for it.

Defined results: a null or empty text scores like a text without words; a doc_id with several labels
is toxic if one of them says so; unlabelled and null ids take no part in training; equal texts get
equal scores; repeated rows are repeated in the result; an empty table gives an empty result. Very
long texts are scored in pieces, whose maxima are the text's. Of several columns of a table only
doc_id, text and lang are read, so others may have any name. Without labels of both classes every
score is 0.5 less a hair, so nothing is predicted toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.llm import textbytes as tb
from cairn.runtime import give_back, lean, materialize, release, ship

#: Most rows and, about, bytes of text of a part.
PART_ROWS, PART_BYTES = 8_192, 32_000_000
#: Labelled ids that are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Changes are summed as whole numbers of this size.
UNIT = 2.0**-30
#: Steps of the thresholds.
BINS = 1000
#: Words that a training step takes at once; a longer text is gone through in slices.
SLICE_WORDS = 200_000
FOLDS = 5
BITS = 17
PREFIX = 6
WIDTH = 6
#: Filters of each width in words.
FILTERS = {1: 6, 2: 3, 3: 2}
EPOCHS = 3
#: Texts' worth of prior in a bucket's log-odds, shared out by class size, so that a rare word counts for little.
SMOOTH = 5.0
#: Small samples are gone over more often, up to this many steps.
LEAST_STEPS = 300
BATCH = 64
#: Text that is scored at once.
SCORE_BYTES = 400_000
#: Words whose buckets a task keeps.
KEPT_WORDS = 50_000
SEED = 7


class Buckets(dict):
    """Bucket of a word, and above ``BITS`` bits that of its prefix."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        got = self[word] = crc32(word) >> (32 - BITS) | crc32(word[:PREFIX], 1) >> (32 - BITS) << BITS
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def split_ids(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their prefixes."""
    return codes & ((1 << BITS) - 1), codes >> BITS


@dataclass
class Segments:
    """Texts, or pieces of texts: their words' codes, where each begins, its text, and whether the text goes on."""

    codes: np.ndarray
    first: np.ndarray
    text_of: np.ndarray
    goes_on: np.ndarray


def segments(column: pa.Array, buckets: Buckets, limit: int | None = None) -> Iterator[Segments]:
    """All texts of a column; a piece begins with the last words of the one before it, as many as a filter can reach over."""
    limit = limit or SCORE_BYTES
    reach = max(FILTERS) - 1
    held: list[tuple[np.ndarray, int, bool]] = []
    size = 0

    def drain() -> Segments:
        codes, of, on = zip(*held)
        held.clear()
        return Segments(np.concatenate(codes), np.cumsum([0, *map(len, codes)]), np.array(of), np.array(on))

    for i, text in enumerate(tb.texts(column)):
        before, waiting = np.zeros(0, np.int64), None
        for words in tb.folded_words(text, limit):
            if waiting is not None:
                held.append((waiting, i, True))
                before = waiting[-reach:]
                if size >= limit:
                    yield drain()
                    size = 0
            waiting = np.concatenate([before, buckets.of(words)])
            size += 8 * len(words)
        held.append((waiting, i, False))
        if size >= limit:
            yield drain()
            size = 0
    if held:
        yield drain()


def _slide(steps: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Sum of each word's first step, the next word's second, and so on; zeros behind a text's end."""
    if len(steps) == 1:
        return steps[0]
    y = steps[0].copy()
    for j, step in enumerate(steps[1:], 1):
        add = step[j:].copy()
        for back in range(1, j + 1):  # the last j words of a text have no word j places on
            last = first[1:] - back
            last = last[(last >= first[:-1]) & (last < len(add))]
            add[last] = 0
        y[: len(add)] += add
    return y


@dataclass
class Model:
    words: np.ndarray
    heads: np.ndarray
    filters: dict[int, np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = 0.5
    projected: tuple | None = None

    def vectors(self, word: np.ndarray, head: np.ndarray) -> np.ndarray:
        return np.concatenate([self.words[word], self.heads[head]], axis=1)

    def convolve(self, x: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Filter outputs at each word, one array for each width."""
        return [_slide([x @ step for step in own], first) for own in self.filters.values()]

    def projections(self) -> tuple[np.ndarray, np.ndarray, list[list[slice]]]:
        """Filter outputs of each bucket by itself, so that scoring a word is a look-up and an addition."""
        columns = np.concatenate([step for own in self.filters.values() for step in own], axis=1)
        at, where = 0, []
        for width, own in self.filters.items():
            where.append([slice(at + j * own.shape[2], at + (j + 1) * own.shape[2]) for j in range(width)])
            at += width * own.shape[2]
        return self.words @ columns[:WIDTH], self.heads @ columns[WIDTH:], where

    def pool(self, part: Segments) -> np.ndarray:
        """Largest rectified filter outputs of each segment; windows that a later piece has whole are left to it."""
        word, head = split_ids(part.codes)
        first = part.first
        pooled = np.zeros((len(part.text_of), len(self.weights)), np.float32)
        full = np.flatnonzero(np.diff(first))
        if not len(full):
            return pooled
        if self.projected is None:
            self.projected = self.projections()
        of_word, of_head, where = self.projected
        seen = of_word[word]
        seen += of_head[head]
        at = 0
        cut, begin = first[1:][part.goes_on], first[:-1][part.goes_on]
        for steps in where:
            y = _slide([seen[:, columns] for columns in steps], first)
            for back in range(1, len(steps)):
                y[(cut - back)[cut - back >= begin]] = 0
            pooled[full, at : at + y.shape[1]] = np.maximum(np.maximum.reduceat(y, first[full], axis=0), 0)
            at += y.shape[1]
        return pooled

    def score(self, column: pa.Array, limit: int | None = None) -> np.ndarray:
        pooled = np.zeros((len(column), len(self.weights)), np.float32)
        buckets = Buckets()
        for part in segments(column, buckets, limit):
            np.maximum.at(pooled, part.text_of, self.pool(part))
        # summed column by column, so that a score doesn't hang on how many rows a batch has
        margin = np.full(len(column), self.bias)
        for k, w in enumerate(self.weights):
            margin += pooled[:, k].astype(np.float64) * w
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _blank() -> Model:
    shape = (1 << BITS, WIDTH)
    return Model(np.zeros(shape, np.float32), np.zeros(shape, np.float32), {w: np.zeros((w, 2 * WIDTH, n), np.float32) for w, n in FILTERS.items()}, np.zeros(sum(FILTERS.values())), -1e-9)


def _log_odds(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of each bucket's presence in toxic against other texts, from texts by class (rows) and bucket."""
    size = sizes.reshape(2, 1).astype(float)
    share = (counts + SMOOTH * size / size.sum()) / (size * (1 + SMOOTH / size.sum()))
    return np.log(share[1] / share[0])


@dataclass
class Training:
    """A model as it stands between rounds: summed squares of each bucket's slopes, class weights, the half it learns from (none: both)."""

    model: Model
    grown: np.ndarray
    weigh: np.ndarray
    half: int | None

    def dense(self) -> np.ndarray:
        """All parameters but the buckets', in rows of ``WIDTH``."""
        flat = np.concatenate([*(f.ravel() for f in self.model.filters.values()), self.model.weights, [self.model.bias]])
        return np.pad(flat, (0, -len(flat) % WIDTH)).reshape(-1, WIDTH)

    def add_dense(self, change: np.ndarray) -> None:
        at, flat = 0, change.ravel()
        for value in (*self.model.filters.values(), self.model.weights):
            value += flat[at : at + value.size].reshape(value.shape)
            at += value.size
        self.model.bias += float(flat[at])


def start(counts: np.ndarray, sizes: np.ndarray, half: int | None, seed: int = SEED) -> Training:
    """The model before its first step, from texts by class and bucket (words, then prefixes) and texts by class."""
    rng = np.random.default_rng(seed)
    model = _blank()
    for table, own in ((model.words, counts[:, : 1 << BITS]), (model.heads, counts[:, 1 << BITS :])):
        table[:] = rng.normal(0, 0.05, table.shape)
        table[:, 0] = _log_odds(own, sizes) / 4
    for own in model.filters.values():
        own[:] = rng.normal(0, 0.1, own.shape)
        own[:, 0] += 0.5
        own[:, WIDTH] += 0.5
    model.weights[:] = 0.5
    model.bias = -1.0
    # Half way (in the exponent) between the rows' mix and classes of equal weight.
    return Training(model, np.full(2 << BITS, 1e-3, np.float32), (sizes.sum() / (2 * sizes)) ** 0.5, half)


def _peaks(model: Model, word: np.ndarray, head: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each width, where its filters are largest in each text, and how large."""
    if first[-1] <= SLICE_WORDS:
        outs = model.convolve(model.vectors(word, head), first)
        spots = [np.stack([out[a:b].argmax(axis=0) + a for a, b in zip(first, first[1:])]) for out in outs]
        return spots, [np.take_along_axis(out, spot, axis=0) for out, spot in zip(outs, spots)]
    spots = [np.zeros((len(first) - 1, n), np.int64) for n in FILTERS.values()]
    tops = [np.full(s.shape, -np.inf, np.float32) for s in spots]
    for i, (low, high) in enumerate(zip(first.tolist(), first[1:].tolist())):
        for begin in range(low, high, SLICE_WORDS):
            end = min(begin + SLICE_WORDS, high)
            reach = min(end + max(FILTERS) - 1, high)  # a window that begins in the slice is seen whole
            for spot, top, out in zip(spots, tops, model.convolve(model.vectors(word[begin:reach], head[begin:reach]), np.array([0, reach - begin]))):
                at = out[: end - begin].argmax(axis=0)
                own = out[at, np.arange(out.shape[1])]
                better = own > top[i]
                top[i][better], spot[i][better] = own[better], at[better] + begin
    return spots, tops


def train(state: Training, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, seed: int = SEED) -> np.ndarray:
    """Go over (word buckets, prefix buckets, label) of whole texts; changes ``state``, returns how often each bucket changed."""
    model, touched = state.model, np.zeros(2 << BITS, np.int64)
    rng = np.random.default_rng(seed)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in {"out": model.weights, **model.filters}.items()}
    bias_moment, step = [0.0, 0.0], 0

    def adam(key, value: np.ndarray, slope: np.ndarray, rate: float) -> None:
        m, v = moments[key]
        m += 0.1 * (slope - m)
        v += 0.01 * (slope * slope - v)
        value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

    rows = [r for r in rows if len(r[0])]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), BATCH):
            step += 1
            own = [rows[i] for i in order[begin : begin + BATCH]]
            first = np.cumsum([0, *(len(r[0]) for r in own)])
            word, head = np.concatenate([r[0] for r in own]), np.concatenate([r[1] for r in own])
            label = np.array([r[2] for r in own])
            spots, tops = _peaks(model, word, head, first)
            pooled = np.maximum(np.concatenate(tops, axis=1), 0)
            chance = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.bias, -30, 30)))
            gap = state.weigh[label] * (chance - label) / len(label)
            back = gap[:, None] * model.weights[None, :] * (pooled > 0)
            slope = pooled.T @ gap + 1e-4 * model.weights
            at, moves = 0, []
            for (width, filters), spot in zip(model.filters.items(), spots):
                g = back[:, at : at + filters.shape[2]]
                at += filters.shape[2]
                change = np.zeros_like(filters)
                for j in range(width):
                    where = spot + j
                    inside = where < first[1:, None]
                    where = np.minimum(where, len(word) - 1)
                    gj = (g * inside).astype(np.float32)
                    change[j] = np.einsum("bf,bfd->df", gj, model.vectors(word[where].ravel(), head[where].ravel()).reshape(*where.shape, -1))
                    to_x = gj[:, :, None] * filters[j].T[None, :, :]
                    hit = gj.ravel() != 0
                    moves += [(ids[where].ravel()[hit], side.reshape(-1, WIDTH)[hit], table, shift) for table, ids, side, shift in ((model.words, word, to_x[:, :, :WIDTH], 0), (model.heads, head, to_x[:, :, WIDTH:], 1 << BITS))]
                adam(width, filters, change + 1e-5 * filters, 0.01)
            for bucket, slope_x, table, shift in moves:
                np.add.at(state.grown, bucket + shift, (slope_x * slope_x).sum(axis=1))
                np.add.at(table, bucket, -0.05 * slope_x / np.sqrt(state.grown[bucket + shift])[:, None])
                np.add.at(touched, bucket + shift, 1)
            adam("out", model.weights, slope, 0.02)
            bias_moment[0] += 0.1 * (gap.sum() - bias_moment[0])
            bias_moment[1] += 0.01 * (gap.sum() ** 2 - bias_moment[1])
            model.bias -= 0.02 * (bias_moment[0] / (1 - 0.9**step)) / (np.sqrt(bias_moment[1] / (1 - 0.99**step)) + 1e-6)
    return touched


def best_threshold(score: np.ndarray, label: np.ndarray, count: np.ndarray | None = None) -> float:
    """The cut with the fewest errors, nearest to a half among equals; ``count``: how many rows each score and label stand for."""
    count = np.ones(len(score), np.int64) if count is None else count
    order = np.argsort(score, kind="stable")
    score, toxic, clean = score[order], (count * label)[order], (count * ~label)[order]
    cuts = np.unique(np.concatenate([[0.5], (score[1:] + score[:-1]) / 2]))
    cuts = cuts[(cuts >= 0.2) & (cuts <= 0.8)]
    below = np.searchsorted(score, cuts, "left")
    errors = np.concatenate([[0], np.cumsum(toxic)])[below] + clean.sum() - np.concatenate([[0], np.cumsum(clean)])[below]
    least = cuts[errors == errors.min()]
    return float(least[np.argmin(np.abs(least - 0.5))])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, row of text and lang) of all rows that may be learned from; an id may still come twice."""
    named = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    named = named.where(~held_out(F.col("doc_id")))
    if named.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang")).alias("row"))
    return own.join(named, "doc_id")


def _one_row(rows: DataFrame, *also: str) -> DataFrame:
    return rows.groupBy(*also, "doc_id", "toxic").agg(F.min("row").alias("row")).select(*also, "doc_id", "toxic", "row.lang", "row.text")


def sampled(docs: DataFrame, labels: DataFrame, size: int | None = None) -> DataFrame:
    """(doc_id, toxic, lang, text) of the labelled rows: all, or for a trial those with ``size`` bytes of text together. No query asks for fewer than all."""
    held = _one_row(_labelled(docs, labels))
    if size is None:
        return held
    order = Window.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id")
    return held.withColumn("_bytes", F.sum(F.octet_length("text")).over(order)).where(F.col("_bytes") <= size).drop("_bytes")


def dealt(docs: DataFrame, labels: DataFrame, rows: int = PART_ROWS, size: int = PART_BYTES) -> tuple[DataFrame, int, int]:
    """(part, half, doc_id, toxic, lang, text) of all labelled rows, part by part in the shared folder; how many parts, and rows."""
    own = _labelled(docs, labels)
    n, total = own.agg(F.count("*"), F.sum(F.octet_length("row.text").cast("long"))).first()
    parts = max(1, -(-n // rows), -(-(total or 0) // size))
    own = own.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(parts)).cast("int")).repartition(4 * parts, "part")
    half = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(2)).cast("int")
    own = _one_row(own, "part").select("part", half.alias("half"), "doc_id", "toxic", "lang", "text").sortWithinPartitions("part", "doc_id")
    return materialize(own, "training"), parts, n


def _parsed(batch: pa.RecordBatch, buckets: Buckets) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Part, half, label, and buckets of words and of prefixes of each row."""
    part, half, toxic = (batch.column(k).to_pylist() for k in (0, 1, 3))
    for p, h, t, text in zip(part, half, toxic, tb.texts(batch.column(5))):
        word, head = split_ids(np.concatenate([buckets.of(w) for w in tb.folded_words(text)]))
        yield p, h, t, word.astype(np.int32), head.astype(np.int32)


def presence(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts by half, class and bucket (words, then prefixes), and texts by half and class, of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, counts = Buckets(), np.zeros((4, 2 << BITS), np.int64)
        for batch in batches:
            for _, half, toxic, word, head in _parsed(batch, buckets):
                own = counts[2 * half + toxic]
                own[np.unique(word)] += 1
                own[np.unique(head) + (1 << BITS)] += 1
        place = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), *map(pa.array, counts[:, place])], ["place", "c0", "c1", "c2", "c3"])

    summed = parts.mapInArrow(lean(run), "place int, c0 long, c1 long, c2 long, c3 long").groupBy("place").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(4)))
    got = summed.toArrow()  # at most a row for each bucket
    counts, sizes = np.zeros((4, 2 << BITS), np.int64), np.zeros(4, np.int64)
    counts[:, got.column("place").to_numpy()] = [got.column(f"c{k}").to_numpy() for k in range(4)]
    for r in parts.groupBy("half", "toxic").count().collect():
        sizes[2 * r["half"] + r["toxic"]] = r["count"]
    return counts.reshape(2, 2, -1), sizes.reshape(2, 2)


MOVES = "model int, place int, n long, grown long, " + ", ".join(f"d{k} long" for k in range(WIDTH))


def _moves(number: int, before: Training, rows: list[tuple], epochs: int, seed: int) -> pa.RecordBatch:
    """What a part's rows change in a model, each place times its weight, as whole numbers of ``UNIT``."""
    after = deepcopy(before)
    touched = train(after, rows, epochs, seed)
    place = np.flatnonzero(touched)
    tables = lambda s: np.concatenate([s.model.words, s.model.heads])[place].astype(float)
    dense = after.dense() - before.dense()
    weight = np.concatenate([touched[place], np.full(len(dense), len(rows))])
    change = np.concatenate([tables(after) - tables(before), dense])
    grown = np.concatenate([after.grown[place].astype(float) - before.grown[place], np.zeros(len(dense))])
    place = np.concatenate([place, (2 << BITS) + np.arange(len(dense))])
    whole = lambda x: pa.array(np.rint(x * weight / UNIT).astype(np.int64))
    columns = [pa.array(np.full(len(place), number, np.int32)), pa.array(place.astype(np.int32)), pa.array(weight), whole(grown), *map(whole, change.T)]
    return pa.RecordBatch.from_arrays(columns, ["model", "place", "n", "grown", *(f"d{k}" for k in range(WIDTH))])


def train_round(parts: DataFrame, states: list[Training], epochs: int, seed: int) -> None:
    """All parts go over their rows from the same models; ``states`` become the averages."""
    shared = parts.sparkSession.sparkContext.broadcast(states)  # its size is fixed by BITS and FILTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        rows = (row for batch in batches for row in _parsed(batch, buckets))
        for part, group in groupby(rows, lambda r: r[0]):
            held = list(group)
            for number, state in enumerate(shared.value):
                own = [(r[3], r[4], r[2]) for r in held if state.half in (None, r[1])]
                if own:
                    yield _moves(number, state, own, epochs, seed + part)

    summed = parts.mapInArrow(lean(run), MOVES).groupBy("model", "place").agg(*(F.sum(c).alias(c) for c in ("n", "grown", *(f"d{k}" for k in range(WIDTH)))))
    got = summed.toArrow()  # at most a row for each place of each model
    shared.destroy()
    model, place, n, grown = (got.column(c).to_numpy() for c in ("model", "place", "n", "grown"))
    change = np.stack([got.column(f"d{k}").to_numpy() for k in range(WIDTH)], axis=1) * UNIT / n[:, None]
    for number, state in enumerate(states):
        for table, low in ((state.model.words, 0), (state.model.heads, 1 << BITS)):
            own = (model == number) & (place >= low) & (place < low + (1 << BITS))
            table[place[own] - low] += change[own]
            state.grown[place[own]] += grown[own] * UNIT / n[own]
        own = (model == number) & (place >= 2 << BITS)
        dense = np.zeros_like(state.dense())
        dense[place[own] - (2 << BITS)] = change[own]
        state.add_dense(dense)


def _set_thresholds(parts: DataFrame, model: Model, halves: list[Model]) -> None:
    """Thresholds of ``model`` from the scores that all rows have from the model of the other half."""
    shared = parts.sparkSession.sparkContext.broadcast(halves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column(1).to_numpy()
            score = np.zeros(len(half))
            for h in (0, 1):
                score[half == h] = shared.value[1 - h].score(batch.column(5).filter(pa.array(half == h)))
            yield pa.RecordBatch.from_arrays([batch.column(4).fill_null(""), batch.column(3), pa.array(np.minimum(score * BINS, BINS - 1).astype(np.int32))], ["lang", "toxic", "bin"])

    def best(table: pa.Table) -> float:
        return best_threshold((table.column("bin").to_numpy() + 0.5) / BINS, table.column("toxic").to_numpy() == 1, table.column("n").to_numpy())

    def own_cut(table: pa.Table) -> pa.Table:
        return pa.table({"lang": table.column("lang").slice(0, 1), "cut": pa.array([best(table)])})

    counts = materialize(parts.mapInArrow(lean(run), "lang string, toxic int, bin int").groupBy("lang", "toxic", "bin").agg(F.count("*").alias("n")), "scores")
    model.default = best(counts.groupBy("toxic", "bin").agg(F.sum("n").alias("n")).toArrow())  # at most 2 * BINS rows
    enough = counts.groupBy("lang").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("c")).where("t >= 20 and c >= 20")
    cuts = counts.join(enough.select("lang"), "lang").groupBy("lang").applyInArrow(own_cut, "lang string, cut double").collect()  # a row for each language
    model.thresholds = {r["lang"]: r["cut"] for r in cuts}
    shared.destroy()
    release(counts)


def fit(docs: DataFrame, labels: DataFrame, rows: int = PART_ROWS) -> Model:
    """Train on all labelled rows outside the held-out fold, dealt to parts of at most about ``rows``."""
    ship(docs.sparkSession)
    parts, n_parts, n = dealt(docs, labels, rows)
    counts, sizes = presence(parts)
    if not sizes.sum(axis=0).all():
        release(parts)
        return _blank()
    states = [start(counts.sum(axis=0), sizes.sum(axis=0), None)]
    if sizes.all():
        states += [start(counts[h], sizes[h], h) for h in (0, 1)]
    del counts
    # Few rows are gone over more often; a single part needs no averages in between.
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH * n_parts // max(1, n)))
    for turn in range(epochs if n_parts > 1 else 1):
        train_round(parts, states, epochs if n_parts == 1 else 1, SEED + turn * n_parts)
    model = states[0].model
    if len(states) == 3:
        _set_thresholds(parts, model, [s.model for s in states[1:]])
    release(parts)
    del states
    give_back()  # of the driver's Python: what the rounds sent
    return model


def score_ids(model: Model, rows: list[tuple]) -> np.ndarray:
    out = np.zeros(len(rows))
    for i, (word, head, _) in enumerate(rows):
        pooled = np.zeros(len(model.weights))
        if len(word):
            pooled = np.concatenate([np.maximum(y.max(axis=0), 0) for y in model.convolve(model.vectors(word, head), np.array([0, len(word)]))])
        out[i] = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.bias, -30, 30)))
    return out


def _thresholds(model: Model, langs: pa.Array) -> np.ndarray:
    return np.array([model.thresholds.get(x or "", model.default) for x in langs.to_pylist()])


def assess(docs: DataFrame, labels: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (a half as the cut), flagged (the language's cut)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))  # its size is fixed by BITS and FILTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score = model.score(batch.column(3))
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(score >= _thresholds(model, batch.column(2)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "flagged"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lean(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, flagged boolean")


def keep_clean(docs: DataFrame, labels: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """The rows of ``docs``, all their columns as they were, that their language's cut doesn't flag."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))
    text, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            cut = _thresholds(model, batch.column(lang)) if lang is not None else np.full(len(batch), model.default)
            yield batch.filter(pa.array(model.score(batch.column(text)) < cut))

    return docs.mapInArrow(lean(run), docs.schema)
