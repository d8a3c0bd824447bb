"""Divergence of the sources of each language: how far apart their word shares lie, and by which words.

Words are counted by (lang, source) in the task that reads them. A language keeps the words that
stand in at least ``MIN_DOCUMENTS`` of its documents; a group's share of a kept word is a whole
number of billionths, smoothed by ``PRIOR`` occurrences a word. All sums are exact.

Pairs of sources are worked out in two dimensions: groups of a language are dealt to blocks of about
``BLOCK``, and each pair of blocks is a tile that gets the packed count vectors of both, cut into
vocabulary chunks of about ``CHUNK`` words. A tile's rows come sorted by chunk; a task holds one
chunk of one tile, adds its absolute differences to the tile's submatrix and goes on to the next. So
memory depends on neither the vocabulary nor the number of sources, and a hot source is one vector
like any other.

Defined results: null texts, languages and sources count as empty strings; a text without words still
makes its group occur; repeated rows (and ids, which aren't read) count each; equal values are ranked
by the item's UTF-8 bytes; a language without kept words gives its pairs the value 0 and no words; a
language with one source has no pairs; an empty table gives an empty result. Very long texts are
counted in pieces; the distinct words of one text are held. Only the columns text, lang and source are
read, so others may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cairn.llm import textbytes as tb
from cairn.runtime import materialize, ship

MIN_DOCUMENTS = 30
PRIOR = 5
SHARE = 1_000_000_000
TOP_TERMS = 50
BLOCK, CHUNK = 64, 8192
#: Counts that a task holds before it sends them on.
HELD_COUNTS = 400_000

_NON_LETTER = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: ASCII letters in lower case and all bytes beyond ASCII stay; the rest separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents); each group also has a row with a null term and zeros."""

    def sent(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            terms = [None, *n]
            langs, sources = (pa.array([x] * len(terms), pa.string()) for x in (lang, source))
            words = pa.array(terms, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs, sources, words, *(pa.array([0, *map(c.__getitem__, n)], pa.int64()) for c in (n, df))], ["lang", "source", "term", "n", "df"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for text, group in zip(tb.texts(batch.column(0)), zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                n, df = held.setdefault(group, (Counter(), Counter()))
                before, own = len(n), set()
                for piece in tb.pieces(text, separator=_NON_LETTER):
                    words = piece.translate(_FOLD).split()
                    n.update(words)
                    own.update(words)
                df.update(own)
                size += len(n) - before
                if size > HELD_COUNTS:
                    yield from sent(held)
                    size = 0
        yield from sent(held)

    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(told("text"), told("lang"), told("source")).mapInArrow(run, "lang string, source string, term string, n long, df long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count, total, terms):
    """1 + floor(SHARE * (count + PRIOR) / (total + PRIOR * terms)) of columns, in decimals."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(count + PRIOR) * F.lit(SHARE), wide(total + PRIOR * terms)) + 1


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same for an array of counts; the quotient is made a thousand at a time, so no product leaves 64 bits."""
    rest, out = counts + PRIOR, np.zeros(len(counts), np.int64)
    bottom = total + PRIOR * terms
    for _ in range(3):
        top = rest * 1000
        out = out * 1000 + top // bottom
        rest = top % bottom
    return out + 1


class Vocabulary:
    """Kept words with chunk and place in it, the groups with their totals, and the groups' counts of kept words."""

    def __init__(self, docs: DataFrame, min_documents: int, chunk: int):
        counts = materialize(word_counts(docs), "word-counts")
        known = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("lang_df"))
        known = materialize(known.where(F.col("lang_df") >= min_documents).select("lang", "term", "lang_n"), "kept-words")
        sizes = known.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
        groups = counts.where("term is null").select("lang", "source")
        langs = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(sizes, "lang", "left").na.fill(0, ["terms", "lang_total"])
        self.langs = materialize(langs.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("terms") / chunk)).cast("int")), "languages")
        place = Window.partitionBy("lang", "chunk").orderBy("term")
        placed = known.join(self.langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
        self.words = materialize(placed.select("lang", "term", "lang_n", "chunk", (F.row_number().over(place) - 1).alias("slot")), "placed-words")
        self.chunks = self.words.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("width"))
        self.counts = materialize(counts.where("term is not null").drop("df").join(self.words, ["lang", "term"]), "kept-counts")
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        self.groups = materialize(groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(self.langs, "lang"), "groups")


def tiles(own: Vocabulary, block: int) -> DataFrame:
    """Packed vectors by chunk, a copy for each tile that a group's block takes part in."""
    packed = own.counts.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), "n")).alias("cells"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("groups") / block)).cast("int")
    seated = own.groups.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    rows = seated.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.join(own.chunks, ["lang", "chunk"], "left").join(packed, ["lang", "source", "chunk"], "left")
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select(
        "lang", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "chunk", "mine", "source", "total", "terms", F.coalesce("width", F.lit(0)).alias("width"),
        F.coalesce(F.col("cells.slot"), F.array().cast("array<int>")).alias("slots"), F.coalesce(F.col("cells.n"), F.array().cast("array<bigint>")).alias("ns"),
    )


class Tile:
    """The submatrix of one pair of blocks, added to chunk by chunk."""

    def __init__(self, lang: str, low: int, high: int):
        self.lang, self.low, self.high = lang, low, high
        self.left: list[str] = []
        self.right: list[str] = []
        self.sums = None

    def add(self, rows: list[dict]) -> None:
        """The rows of one chunk: every group of both blocks."""
        rows.sort(key=lambda r: r["source"])
        sides = [[r for r in rows if r["mine"] == b] for b in (self.low, self.high)]
        dense = []
        for side in sides:
            own = np.zeros((len(side), side[0]["width"] if side else 0), np.int64)
            for k, r in enumerate(side):
                own[k, r["slots"]] = r["ns"]
                own[k] = shares(own[k], r["total"], r["terms"]) if r["terms"] else 0
            dense.append(own)
        if self.sums is None:
            self.left, self.right = ([r["source"] for r in side] for side in sides)
            self.sums = np.zeros((len(self.left), len(self.right)), np.int64)
        if self.left and self.right:
            for k, own in enumerate(dense[0]):
                self.sums[k] += np.abs(dense[1] - own).sum(axis=1)

    def result(self) -> Iterator[pa.RecordBatch]:
        ways = [(self.left, self.right, self.sums)] + ([(self.right, self.left, self.sums.T)] if self.low != self.high else [])
        for left, right, sums in ways:
            for k, source in enumerate(left):
                other = [j for j in range(len(right)) if right[j] != source]
                if other:
                    items = pa.array([right[j] for j in other], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(other)), pa.array([source] * len(other)), items, pa.array(sums[k, other])], ["lang", "source", "item", "value"])


def pair_sums(rows: DataFrame) -> DataFrame:
    """lang, source, item and value of every ordered pair, from the rows of :func:`tiles`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, at, held = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["lang"], r["low"], r["high"])
                if (key, r["chunk"]) != at:
                    if held:
                        tile.add(held)
                    if tile is None or at[0] != key:
                        if tile is not None:
                            yield from tile.result()
                        tile = Tile(*key)
                    at, held = (key, r["chunk"]), []
                held.append(r)
        if tile is not None:
            tile.add(held)
            yield from tile.result()

    tile = ["lang", "low", "high"]
    return rows.repartition(*tile).sortWithinPartitions(*tile, "chunk").mapInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """lang, source, part, item, value and rank: all other sources (``pair``) and the ``top`` most favoured words (``term``)."""
    ship(docs.sparkSession)
    own = Vocabulary(docs, min_documents, chunk)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(tiles(own, block)).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    used = own.counts.where("n > 0").join(own.groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    gap = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    favoured = used.select("lang", "source", F.col("term").alias("item"), gap.alias("value")).where("value > 0")
    favoured = favoured.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(favoured.select(*columns))
