"""Best-fit packing of token sequences, planned over a histogram of lengths.

Only the counts of pieces by length (as many rows as the longest sequence has tokens) come to the
driver. Best-fit decreasing runs over those counts: sequences with the same room left are one
class, and a run of equal pieces fills whole classes at once. The plan says which ranks of a length
go to which sequences; pieces take their slots by joining on rank within length. The plan's size
depends on the sequence length alone, not on the number of documents.

A piece's rank is its number within length in the task that wrote it, plus the numbers of the tasks
before. So ranks need no shuffle of pieces, however many share a length, are equal, or lack an id.

Defined results: a null or empty text gives one piece, its end id; repeated rows are packed each by
itself; a null doc_id stays null; which of equal pieces gets which slot is not defined; an empty table
gives an empty result. Very long texts are read in pieces, of which the ids are kept (4 bytes a token).
Only the columns doc_id and text are read, so others may have any name.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share out the cores
from tokenizers import Tokenizer  # noqa: E402

from cairn.llm import textbytes as tb  # noqa: E402
from cairn.runtime import lean, materialize, ship  # noqa: E402

SEQUENCE = 4096
END_ID = 1
#: Bytes of words and their ids that a Python worker keeps; when they are exceeded, all are dropped.
CACHE_BYTES = 64_000_000
#: What an entry takes beside its bytes.
ENTRY_BYTES = 220
#: Rows of a table that is broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 200_000

#: Normalizers, and the pre-tokenizer, under which ids of a text are those of its runs between white space (fixed values of the files' format).
_BY_CHARACTER = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})
_NO_SPACES = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


#: The same pattern for text up to U+024F, where Python's classes and the format's agree (numbers named one by one).
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|(?:[^\\w\\s]|_)+")
#: Text with other characters, or with what might be a special string, is taken run by run; such runs go to the library.
_PLAIN = re.compile("[\\x00-\\x1b -\u012f\u0131-\u024f]*\\Z")


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary (a fixed rule)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def splits_at_spaces(rules: dict) -> bool:
    """Whether a tokenizer file's rules treat each run between ASCII white space by itself."""
    normal, cut = rules.get("normalizer"), rules.get("pre_tokenizer") or {}
    steps = (normal or {}).get("normalizers", [normal] if normal else [])
    first = cut.get("pretokenizers", [cut])[0]
    plain = all(not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["content"].split() != [x["content"]]) for x in rules.get("added_tokens", []))
    return plain and first == _NO_SPACES and all(x in _BY_CHARACTER for x in steps) and not rules.get("post_processor") and not rules.get("truncation")


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> tuple[Tokenizer, bool]:
    with open(path, encoding="utf-8") as lines:
        return Tokenizer.from_file(path), splits_at_spaces(json.load(lines))


class Words(dict):
    """Ids of words, made when they are first asked for; all are dropped when they exceed ``keep`` bytes."""

    def __init__(self, make, keep: int = CACHE_BYTES):
        super().__init__()
        self.make, self.keep, self.held = make, keep, 0

    def __missing__(self, key: str) -> bytes:
        if self.held > self.keep:
            self.clear()
            self.held = 0
        ids = self[key] = self.make(key)
        self.held += len(key) + len(ids) + ENTRY_BYTES
        return ids


class Encoder:
    """Token ids of whole texts. Where the file's rules allow it, words are encoded once and kept."""

    def __init__(self, path: str, keep: int = CACHE_BYTES):
        self.tokenizer, self.by_run = _tokenizer(path)
        self.packed = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.alphabet, self.tokenize = _byte_alphabet(), self.tokenizer.model.tokenize
        self.words, self.runs = Words(self._word, keep), Words(self._library, keep // 8)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([self.packed[t.id] for t in self.tokenize(spelled)])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _WORDS.findall(text.lower())))

    def _piece(self, text: str) -> bytes:
        odd = lambda t: "<|" in t or not _PLAIN.match(t)
        if not odd(text):
            return self._plain(text)
        out, held = [], []
        for run in text.encode().split():
            own = run.decode()
            if not odd(own):
                held.append(own)
                continue
            out += [self._plain(" ".join(held)), self.runs[own]]
            held = []
        return b"".join([*out, self._plain(" ".join(held))])

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_run:
            return self._library(text.decode())
        return b"".join([self._piece(piece.decode()) for piece in tb.pieces(text)])


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder, kept from task to task."""
    return Encoder(path)


def token_pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with its task and place within length there."""
    ship(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_of(path), TaskContext.get().partitionId()
        seen: dict[int, count] = {}
        for batch in batches:
            of, rows = [], []
            for i, text in enumerate(tb.texts(batch.column(1))):
                ids = encoder.encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    length = len(own) // 4
                    of.append(i)
                    rows.append((piece, at // 4, length, zlib.crc32(own), task, next(seen.setdefault(length, count()))))
            columns = zip(*rows) if rows else ((),) * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lean(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, place long")


@dataclass
class Placement:
    """Ranks first..first+n-1 of a length: ``each`` to a sequence, from ``sequence`` on, beginning at ``offset``."""

    length: int
    first: int
    n: int
    each: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> tuple[list[Placement], int]:
    """Best-fit decreasing over counts. Returns the placements and the number of sequences.

    ``open_at`` maps room left to runs (first sequence, number of sequences) with that room.
    """
    open_at: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    out: list[Placement] = []
    sequences = 0

    def put_back(room: int, run: tuple[int, int]) -> None:
        if room and run[1]:
            if room not in open_at:
                open_at[room] = []
                insort(rooms, room)
            open_at[room].append(run)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop(k)
            else:
                room, first, n = size, sequences, -(-left // (size // length))
                sequences += n
            each = room // length
            full = min(n, left // each)
            if full:
                out.append(Placement(length, rank, full * each, each, first, size - room))
                put_back(room - each * length, (first, full))
                rank, left = rank + full * each, left - full * each
            rest = (first + full, n - full)
            if rest[1] and left and left < each:  # the last sequence of the run takes what is left
                out.append(Placement(length, rank, left, left, rest[0], size - room))
                put_back(room - left * length, (rest[0], 1))
                rest, left = (rest[0] + 1, rest[1] - 1), 0
            put_back(room, rest)
    return out, sequences


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces with sequence_id and offset; sequences are gapless from 0."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, path, size, end_id), "pieces")
    written = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "written")
    counts = {r["length"]: r["n"] for r in written.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    placements, _ = plan(counts, size)
    before = written.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    few = written.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ranked = pieces.join(F.broadcast(before) if few else before, ["length", "task"]).withColumn("rank", F.col("place") + F.col("before"))
    columns = {"length": "length", "first": "first", "n": "n", "each": "each", "sequence": "sequence", "at": "offset"}
    slots = spark.createDataFrame(pa.table({c: pa.array([getattr(p, k) for p in placements], pa.int64()) for c, k in columns.items()}))
    slots = F.broadcast(slots) if len(placements) <= BROADCAST_ROWS else slots
    own = F.col("rank") - F.col("first")
    placed = ranked.join(slots, (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    return placed.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("sequence") + (own / F.col("each")).cast("long")).alias("sequence_id"), (F.col("at") + own % F.col("each") * ranked["length"]).alias("offset"))
