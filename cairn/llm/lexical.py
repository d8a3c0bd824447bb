"""Ranked lexical search: exact top-k over posting lists with blocks of chosen, variable length.

The index is a table of shards, one row each: the documents of a shard in the order they are read,
and for each term its postings (document, impact). An impact is a posting's part of a score but for
the term's weight, which depends on the query's collection alone. The documents of a shard stand in
steps of ``STEP``; a posting list is cut into blocks at some of these steps, so that the blocks'
maxima exceed the impacts by as little as possible: dynamic programming over all boundaries minimises
the summed excess plus ``BLOCK_COST`` maxima a block. Only ends and maxima of blocks are kept.

Shards are small, and each is a row group of its own in the stored index: tasks hold about one at a
time, however many a file has.

A search adds up the weighted maxima of an item's terms over the steps of a shard, reads postings of
the most promising steps, and then only those of steps whose bound reaches the kth score found so
far. What is left out can't be in the shard's top k, ties included. The best k of each shard are
ranked over all shards. Shards are searched in parallel, and no posting is shuffled.

Defined results: a null or empty text has no terms, doesn't count as a document and is never found;
repeated rows are ranked each, so a doc_id may come twice; equal scores by ascending doc_id, null
ids last; rows of ``items`` that share an item_id are one item with all their terms, a null item_id
is one as well; an item without terms, or with terms of no document, has no rows; empty tables give
an empty result. Very long texts are read in pieces; the distinct terms of one text are held. Only the
columns doc_id and text, item_id and text are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cairn.llm import textbytes as tb
from cairn.runtime import materialize, ship

TOP = 10
#: Fixed parts of the score.
SATURATION, LENGTH_PERCENT, UNIT, WEIGHT_UNIT = 8, 90, 1_000_000_000, 1000
#: Documents of a step, most steps and most bytes of text of a shard.
STEP, STEPS, SHARD_BYTES = 64, 64, 6_000_000
#: A block costs as much as this many times a list's mean impact of excess.
BLOCK_COST = 2.0
#: Lists up to this length get a block for each step that holds a posting, so their bounds are exact.
SHORT = 8
#: Lists whose boundaries are worked out together.
LISTS = 2048
#: Postings whose impacts are worked out together.
POSTINGS = 1 << 16
#: Bytes of item texts that are broadcast at once; more items are searched in several rounds.
ITEM_BYTES = 4_000_000

#: Numbers of a shard are packed, terms stand between spaces: a shard is a few values, whatever its size.
SHARD = "ids array<long>, terms binary, starts binary, docs binary, impacts binary, block_starts binary, block_ends binary, block_tops binary"
KINDS = {"starts": "<i4", "docs": "<u2", "impacts": "<i4", "block_starts": "<i4", "block_ends": "<u2", "block_tops": "<i4"}


def collection(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for text in tb.texts(batch.column(0)):
                own = sum(map(len, tb.folded_words(text)))
                n, total = n + (own > 0), total + own
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    row = docs.select(F.col("text").cast("string")).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """(UNIT * tf) div (1000 * tf + 8 * m), where m is 10 plus 90 times the document's share of the mean length, rounded down."""
    m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * length * n_docs) // total
    return (UNIT * tf) // (1000 * tf + SATURATION * m)


def cut(tops: np.ndarray, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For lists (rows) over steps (columns): where blocks end, by dynamic programming.

    A block over steps i to j-1 costs (its postings) * (its maximum) - (its sum) + a block's cost. Costs of
    the best cut of the first j steps follow from those of fewer steps. Returns a boolean matrix of ends.
    """
    lists, steps = tops.shape
    count, total = (np.concatenate([np.zeros((lists, 1)), np.cumsum(x, axis=1)], axis=1) for x in (sizes, sums))
    price = BLOCK_COST * total[:, -1] / np.maximum(count[:, -1], 1)
    best = np.full((lists, steps + 1), np.inf)
    best[:, 0] = 0
    start = np.zeros((lists, steps + 1), np.int32)
    for j in range(1, steps + 1):
        top = np.maximum.accumulate(tops[:, j - 1 :: -1], axis=1)[:, ::-1] if j > 1 else tops[:, :1]
        cost = best[:, :j] + (count[:, j : j + 1] - count[:, :j]) * top - (total[:, j : j + 1] - total[:, :j])
        start[:, j] = cost.argmin(axis=1)
        best[:, j] = np.take_along_axis(cost, start[:, j : j + 1], axis=1)[:, 0] + price
    ends = np.zeros((lists, steps), bool)
    at, rows = np.full(lists, steps), np.arange(lists)
    while (at > 0).any():
        live = at > 0
        ends[rows[live], at[live] - 1] = True
        at[live] = start[rows[live], at[live]]
    return ends


def blocks(starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first block of each list, step behind each block, maximum of each block); each list's blocks cover all steps."""
    n = np.diff(starts)
    counts, ends, tops = np.zeros(len(n), np.int64), [], []
    for at in range(0, len(n), LISTS):
        own = slice(int(starts[at]), int(starts[min(at + LISTS, len(n))]))
        lists = len(n[at : at + LISTS])
        cell = np.repeat(np.arange(lists), n[at : at + LISTS]) * steps + docs[own] // STEP
        top = np.zeros(lists * steps, np.int64)
        np.maximum.at(top, cell, impacts[own])
        top = top.reshape(lists, steps)
        size = np.bincount(cell, minlength=lists * steps).reshape(lists, steps)
        end = np.ones((lists, steps), bool)
        end[:, :-1] = (size[:, :-1] > 0) | (size[:, 1:] > 0)  # a short list's blocks: steps with a posting, and the gaps between
        long = np.flatnonzero(n[at : at + LISTS] > SHORT)
        if len(long):
            total = np.bincount(cell, impacts[own], minlength=lists * steps).reshape(lists, steps)
            end[long] = cut(top[long], total[long], size[long])
        flat = np.flatnonzero(end.ravel())
        first = np.concatenate([[0], flat[:-1] + 1])
        tops.append(np.maximum.reduceat(top.ravel(), first))
        ends.append(flat % steps + 1)
        counts[at : at + LISTS] = end.sum(axis=1)
    return np.concatenate([[0], np.cumsum(counts)]), *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ends, tops))


class Shard:
    """Documents gathered in a task until the shard is full."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.number: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        own: Counter = Counter()
        for words in tb.folded_words(text):
            own.update(words)
        if own:
            number = self.number
            self.terms.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int32, len(own)))
            self.tfs.append(np.fromiter(own.values(), np.int32, len(own)))
            self.ids.append(doc_id)
            self.lengths.append(own.total())
            self.size += len(text)

    def full(self) -> bool:
        return len(self.ids) >= STEP * STEPS or self.size >= SHARD_BYTES

    def row(self, n_docs: int, total: int) -> pa.RecordBatch:
        names = sorted(self.number)
        place = np.zeros(len(names), np.int32)
        place[np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
        terms = b" ".join(names)
        self.number = {}  # what isn't needed any more goes early, so that two such tasks stay small beside their executor
        doc = np.repeat(np.arange(len(self.ids), dtype=np.uint16), [len(x) for x in self.terms])
        term = place[np.concatenate(self.terms)]
        self.terms = []
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))])
        order = np.argsort(term, kind="stable")
        del term
        doc, tf = doc[order], np.concatenate(self.tfs)[order]
        self.tfs = []
        del order
        own, lengths = np.zeros(len(doc), np.int32), np.array(self.lengths)
        for at in range(0, len(doc), POSTINGS):
            some = slice(at, at + POSTINGS)
            own[some] = impact(tf[some].astype(np.int64), lengths[doc[some]], n_docs, total)
        del tf
        first, ends, tops = blocks(starts, doc, own, -(-len(self.ids) // STEP))
        ids = pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), pa.array(self.ids, pa.int64()))
        packed = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip((starts, doc, own, first, ends, tops), KINDS.values())]
        return pa.RecordBatch.from_arrays([ids, pa.array([terms], pa.binary()), *packed], ["ids", "terms", *KINDS])


def build_index(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The shards as a table of the shared folder, the number of documents with a term, and their terms."""
    ship(docs.sparkSession)
    n_docs, total = collection(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), tb.texts(batch.column(1))):
                shard.add(doc_id, text)
                if shard.full():
                    yield shard.row(n_docs, total)
                    shard = Shard()
        if shard.ids:
            yield shard.row(n_docs, total)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialize(own.mapInArrow(run, SHARD), "lexical-index", row_group=1), n_docs, total


class Postings:
    """The lists of a shard that some item asks for."""

    def __init__(self, batch: pa.RecordBatch, row: int, wanted: dict[bytes, int]):
        got = {f: batch.column(k)[row] for k, f in enumerate(batch.schema.names)}
        self.ids = got["ids"].values
        numbers = lambda f: np.frombuffer(got[f].as_buffer(), KINDS[f])
        asked = [(k, wanted[w]) for k, w in enumerate(got["terms"].as_py().split()) if w in wanted]
        self.steps = -(-len(self.ids) // STEP)
        self.of = {t: x for x, (_, t) in enumerate(asked)}
        starts, docs, impacts, first, ends, tops = map(numbers, ("starts", "docs", "impacts", "block_starts", "block_ends", "block_tops"))
        self.lists = [(docs[starts[k] : starts[k + 1]].astype(np.int64), impacts[starts[k] : starts[k + 1]].astype(np.int64)) for k, _ in asked]
        self.bounds = np.zeros((len(asked), self.steps), np.int64)
        for x, (k, _) in enumerate(asked):
            own = slice(first[k], first[k + 1])
            self.bounds[x] = np.repeat(tops[own], np.diff(ends[own].astype(np.int64), prepend=0))
        self.cuts = [np.searchsorted(d, np.arange(self.steps + 1) * STEP) for d, _ in self.lists]

    def scores(self, rows: list[int], weights: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of these steps and their scores; postings of other steps aren't read."""
        seat = np.full(self.steps, -1)
        seat[steps] = np.arange(len(steps))
        out = np.zeros(len(steps) * STEP, np.int64)
        for x, w in zip(rows, weights):
            docs, impacts = self.lists[x]
            if len(steps) < self.steps:
                at = self.cuts[x]
                low, n = at[steps], at[steps + 1] - at[steps]
                take = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                docs, impacts = docs[take], impacts[take]
            out[seat[docs // STEP] * STEP + docs % STEP] += w * impacts  # a document stands once in a list
        hit = np.flatnonzero(out)
        return steps[hit // STEP] * STEP + hit % STEP, out[hit]

    def top(self, rows: list[int], weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """All documents whose score reaches the kth, their scores, and how many steps were read."""
        bounds = weights @ self.bounds[rows]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        docs, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, n = 0, 1
        while at < len(order):
            floor = np.partition(found, -k)[-k] if len(found) >= k else 1
            live = order[at : at + n]
            live = live[bounds[live] >= floor]
            if not len(live):
                break
            more = self.scores(rows, weights, np.sort(live))
            docs, found = np.concatenate([docs, more[0]]), np.concatenate([found, more[1]])
            at, n = at + len(live), n * 2
        if len(found) > k:
            keep = found >= np.partition(found, -k)[-k]
            docs, found = docs[keep], found[keep]
        return docs, found, at


def _number(x: int | None) -> tuple[bool, int]:
    return x is None, x or 0


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents."""
    spark = index.sparkSession
    own = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, -(-size // item_bytes))
    found = []
    for turn in range(rounds):
        part = own.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == turn) if rounds > 1 else own
        said: dict[int | None, set[bytes]] = {}
        for r in part.collect():  # about item_bytes
            said.setdefault(r[0], set()).update(w for words in tb.folded_words((r[1] or "").encode()) for w in words)
        terms = {w: t for t, w in enumerate(sorted(set().union(*said.values())))}
        asked = spark.sparkContext.broadcast((terms, {i: sorted(terms[w] for w in words) for i, words in said.items()}))
        found.append(_search_round(index, n_docs, asked, k))
    best = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_round(index: DataFrame, n_docs: int, asked, k: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = asked.value[0]
        df: Counter = Counter()
        for batch in batches:
            for row in range(batch.num_rows):
                names, starts = (batch.column(c)[row].as_py() for c in range(2))
                for w, n in zip(names.split(), np.diff(np.frombuffer(starts, KINDS["starts"])).tolist()):
                    if w in terms:
                        df[terms[w]] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int32()), pa.array(list(df.values()), pa.int64())], ["term", "df"])

    df = {r["term"]: r["df"] for r in index.select("terms", "starts").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # terms of one round's items
    weight = {t: math.floor(WEIGHT_UNIT * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, items = asked.value
        for batch in batches:
            for row in range(batch.num_rows):
                own = Postings(batch, row, terms)
                out: list[tuple] = []
                for item, words in items.items():
                    held = [t for t in words if t in own.of and weight[t] > 0]
                    if held:
                        docs, scores, _ = own.top([own.of[t] for t in held], np.array([weight[t] for t in held], np.int64), k)
                        ranked = sorted(zip((-scores).tolist(), (own.ids[int(d)].as_py() for d in docs)), key=lambda x: (x[0], _number(x[1])))
                        out += [(item, i, -s) for s, i in ranked[:k]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    index, n_docs, _ = build_index(docs)
    return search(index, n_docs, items, k)
