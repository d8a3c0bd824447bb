"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood ratio.

The n-grams are runs of ``NGRAM`` bytes, hashed into ``BUCKETS``. Raw counts cover all bytes of all
texts, target counts all texts whose id has only labels that mark it as good and not toxic. A text's score is the
mean over its n-grams of log(target share / raw share) with add-one smoothing. A text is kept if it
passes the base rules and its score is at least the threshold: the ``LOST`` quantile of the scores
of all trusted texts (to one ``BIN``), less ``SLACK`` of the distance down to the mean ratio of
buckets that the target lacks. Every text is judged by this one number.

Ratios are whole multiples of 1 / ``UNIT``, so a text's sum is a whole number and its score the same
wherever the text stands and however the table is partitioned. Words, 3-word windows and lines are
compared as bytes, never by a hash.

Defined results: a null or empty text has no words and fails the base rules; repeated rows are
repeated in the result and, if trusted, counted each; equal texts get equal scores, so ties fall on
one side; a null doc_id stays null and is never trusted; labels for unknown or null ids are ignored;
an empty table gives an empty result. Very long texts are read in pieces: beside the text, 8 bytes a
word are held, and some 40 a word while windows are sorted. Only the columns doc_id and text are
read, so others may have any name. Without trusted rows the threshold is minus infinity, so the base
rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm import textbytes as tb
from cairn.runtime import lean, ship

NGRAM = 4
BUCKETS = 1 << 14
UNIT = 1 << 20
#: Share of trusted rows that the threshold may lose, and the width of the bins it is found with.
LOST = 0.002
BIN = 1 / 4096
SLACK = 0.1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
#: Trusted ids up to which they are broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Bytes whose n-grams, and texts whose windows, are worked on at once.
SEGMENT = 400_000


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram inside a segment, and how many each segment has."""
    n = np.maximum(np.diff(offsets) - NGRAM + 1, 0)
    if len(data) < NGRAM:
        return np.zeros(0, np.uint16), n
    last = len(data) - NGRAM + 1
    code = data[:last].astype(np.uint32)
    for k in range(1, NGRAM):
        code <<= np.uint32(8)
        code |= data[k : last + k]
    code *= np.uint32(2654435761)
    code >>= np.uint32(18)
    keep = np.ones(last, bool)
    for k in range(1, NGRAM):
        at = offsets[1:-1] - k
        keep[at[(at >= 0) & (at < last)]] = False
    return code.astype(np.uint16)[keep], n


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all n-grams of the column ``text``; a task sends one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for data, offsets, _ in tb.byte_segments(batch.column(0), SEGMENT, NGRAM - 1):
                total += np.bincount(gram_buckets(data, offsets)[0], minlength=BUCKETS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


@dataclass
class Model:
    """``ratio`` in units of 1 / ``UNIT``."""

    ratio: np.ndarray
    threshold: float


def scores(column: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """Mean ratio of each text's n-grams; 0 where a text has none."""
    sums, grams = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for data, offsets, text_of in tb.byte_segments(column, SEGMENT, NGRAM - 1):
        bucket, n = gram_buckets(data, offsets)
        running = np.zeros(len(bucket) + 1, np.int64)
        np.cumsum(ratio[bucket], out=running[1:])
        stops = np.cumsum(n)
        np.add.at(sums, text_of, running[stops] - running[stops - n])
        np.add.at(grams, text_of, n)
    return sums / (np.maximum(grams, 1) * float(UNIT))


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of all rows whose id has labels that all say good, and none that says toxic or leaves either open."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_good"))
    sure = (F.col("quality") == 1) & (F.col("toxic") == 0)
    good = known.agg(F.min(F.coalesce(sure, F.lit(False))).alias("sure")).where("sure").select("_good")
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    return own.join(F.broadcast(good) if few else good, F.col("_id") == F.col("_good"), "left_semi").select("text")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts over all of ``docs``; target and threshold from all trusted rows in them."""
    ship(docs.sparkSession)
    trusted = trusted_texts(docs, labels)
    target = gram_counts(trusted)
    if not target.sum():
        return Model(np.zeros(BUCKETS, np.int64), -np.inf)
    raw = gram_counts(docs.select(F.col("text").cast("string")))
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    whole = np.rint(ratio * UNIT).astype(np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, n = np.unique(np.floor(scores(batch.column(0), whole) / BIN).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n)], ["bin", "n"])

    seen = sorted((r["bin"], r["n"]) for r in trusted.mapInArrow(lean(score), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect())  # a row for each bin of scores
    below, wanted = 0, LOST * sum(n for _, n in seen)
    for at, n in seen:
        below += n
        if below > wanted:
            break
    low = at * BIN
    lacking = (target == 0) & (raw > 0)
    return Model(whole, low - SLACK * max(0.0, low - float(ratio[lacking].mean())) if lacking.any() else low)


def repeat_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and of those in 3-word windows found twice or more in it."""
    seen: dict[bytes, int] = {}
    numbers, sizes, new = [], [], count()
    for text in texts:
        n = 0
        for words in tb.spaced_words(text):
            numbers.append(np.fromiter((seen.setdefault(w, k) for w, k in zip(words, new)), np.int64, len(words)))
            n += len(words)
        sizes.append(n)
    n_words = np.array(sizes, np.int64)
    number = np.unique(np.concatenate(numbers), return_inverse=True)[1] if numbers else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(texts)), n_words)
    if len(number) < 3:
        return n_words, np.zeros(len(texts), np.int64)
    # Pairs, then pairs and their next word, then those and their text are numbered: whole numbers below 2**63 throughout.
    m = int(number.max()) + 1
    pair = np.unique(number[:-1] * m + number[1:], return_inverse=True)[1]
    at = np.flatnonzero(of[2:] == of[:-2])
    window = np.unique(pair[at] * m + number[at + 2], return_inverse=True)[1]
    if len(texts) > 1:
        window = np.unique(window * len(texts) + of[at], return_inverse=True)[1]
    covered = np.zeros(len(number), bool)
    if len(window):
        twice = at[np.bincount(window)[window] > 1]
        for k in range(3):
            covered[twice + k] = True
    return n_words, np.bincount(of[covered], minlength=len(texts))


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    dup = start = 0
    while start <= len(text):
        end = text.find(b"\n", start)
        end = len(text) if end < 0 else end
        line = text[start:end]
        if line and not line.isspace():
            if line in seen:
                dup += 1
            else:
                seen.add(line)
        start = end + 1
    return dup


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[bytes] = []
    size, chars, symbols, dups = 0, [], [], []
    for text in tb.texts(column):
        if held and size + len(text) > SEGMENT:
            parts.append(repeat_words(held))
            held, size = [], 0
        held.append(text)
        size += len(text)
        chars.append(len(text.translate(None, tb.SPACES + tb.CONTINUATION)))
        symbols.append(len(text) - len(text.translate(None, SYMBOLS)))
        dups.append(dup_lines(text))
    if held:
        parts.append(repeat_words(held))
    n_words, n_repeat = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(2))
    return {"n_words": n_words, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(dups, np.int64), "n_repeat_words": n_repeat}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def judge(column: pa.Array, model: Model) -> list[pa.Array]:
    own = base_counts(column)
    failed = (own["n_words"] < MIN_WORDS) | (100 * own["n_repeat_words"] > MAX_REPEAT_PERCENT * own["n_words"])
    llr = scores(column, model.ratio)
    return [*(pa.array(own[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(~failed & (llr >= model.threshold)), pa.array(llr)]


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the score ``llr`` of every text."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *judge(batch.column(1), model)], ["doc_id", *(x.split()[0] for x in RESULT.split(", "))])

    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lean(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns as they were, whose text is kept."""
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(judge(batch.column(at), model)[6])

    return docs.mapInArrow(lean(run), docs.schema)
