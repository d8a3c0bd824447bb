"""Byte-level BPE of whole texts: overlapping chunks, stitched where boundaries resynchronise.

Every text is cut into windows of ``CHUNK`` characters and ``OVERLAP`` more. Windows are split by the
pattern, each from its own first character. Two splits of one text that share a boundary agree from
there on, so a window takes over from its predecessor at the first boundary that both have inside the
overlap. The pieces between are then encoded, each by itself. Where an overlap has no shared boundary
(one run of letters longer than the overlap, say) the windows on both sides are joined into one and
split again, so the result is exact for any text.

Texts of up to ``LOCAL`` windows are cut, split, stitched and encoded in the task that reads them; the
windows of longer ones are dealt to many tasks. Both run the same steps on the same windows.

A window's last pre-tokens may be cut off by its end, so boundaries near it are not trusted.

Defined results: a null or empty text has no tokens; repeated rows are repeated in the result; a null
doc_id stays null; an empty table gives an empty result. Of a very long text a task holds some windows,
and where its digest is made, its ids. Only the columns doc_id and text are read, so others may have
any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, takewhile

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from cairn.runtime import materialize, ship

#: Characters of a chunk, and how far its window goes beyond it.
CHUNK = 4096
OVERLAP = 256
#: Windows of a text that one task works on; the windows of longer texts are dealt to many.
LOCAL = 128
#: Boundaries so near to a window's end may hang on text behind it.
MARGIN = 8


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, regex.Pattern]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), regex.compile(pattern)


class Codec:
    """Ranks of one vocabulary: encodes text between two boundaries, decodes ids."""

    def __init__(self, path: str, pattern: str):
        self.encoding, self.pattern = _encoder(path, pattern)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The raw bytes of the ids, one after another."""
        return self.encoding.decode_bytes(memoryview(ids).cast("I").tolist())


def digest(codec: Codec, parts: Iterator[bytes]) -> tuple[int, str, str]:
    """n_tokens, ids_sha256 and decoded_sha256 of ids given in parts; the ids are decoded again."""
    ids, raw, n = hashlib.sha256(), hashlib.sha256(), 0
    for part in parts:
        ids.update(part)
        raw.update(codec.decode(part))
        n += len(part) // 4
    return n, ids.hexdigest(), raw.hexdigest()


def windows(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(first character, window) of each chunk of a text."""
    for start in range(0, max(1, len(text)), chunk):
        yield start, text[start : start + chunk + overlap]


def trusted(codec: Codec, window: str, last: bool) -> list[int]:
    """Boundaries of a window's split, from 0, that text behind the window can't move."""
    ends = [0, *accumulate(map(len, codec.pattern.findall(window)))] if not codec.pattern.groups else [0]
    if ends[-1] != len(window):  # a pattern with groups, or one that leaves text out
        ends = [0, *(m.end() for m in codec.pattern.finditer(window))]
    return ends if last else [x for x in ends[:-2] if x <= len(window) - MARGIN]


def first_ends(codec: Codec, window: str, overlap: int) -> list[int]:
    """Boundaries of a window's split up to the overlap's end, from 0."""
    return [0, *takewhile(lambda x: x < overlap, (m.end() for m in codec.pattern.finditer(window)))]


def meeting(before: list[int], after: list[int], start: int, overlap: int) -> int | None:
    """First boundary that a window beginning at ``start`` shares with its predecessor inside the overlap.

    ``before`` are the predecessor's boundaries in the text, ``after`` the window's own from its start.
    """
    tail = {x for x in before[::-1][: overlap + MARGIN] if x > start}
    return next((start + x for x in after if 0 < x < overlap and start + x in tail), None)


def stitched(codec: Codec, text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int]]:
    """The pieces (from, to) of a text between boundaries at which its windows agree."""
    begin = held_start = grown = 0
    held: list[int] | None = None
    for start, window in windows(text, chunk, overlap):
        stop, last = start + len(window), start + chunk >= len(text)
        if stop < grown and not last:
            continue
        at = None
        if held is None or not grown:
            # of a last window only the overlap matters, and of one without a neighbour nothing does
            own = trusted(codec, window, False) if not last else first_ends(codec, window, overlap) if start else []
            at = meeting(held, own, start, overlap) if held is not None else 0
        if at is not None:
            if held is not None:
                yield begin, at
            begin, held_start = at, start
            held = [x + start for x in own]
        elif grown:  # split from where the window before the gap began
            held, grown = [x + held_start for x in trusted(codec, text[held_start:stop], last)], 0
        else:  # join windows until there is twice as much text
            grown = held_start + 2 * (stop - held_start)
            if last:
                break
        if last:
            break
    yield begin, len(text)


def encode_text(codec: Codec, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[bytes]:
    """Ids of a text, piece by piece."""
    return (codec.encode(text[a:b]) for a, b in stitched(codec, text, chunk, overlap))


def _cut(long_docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, idx, start, last, window) of distinct texts given as (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                key, text = key.as_py(), text.as_py()
                held: list[tuple] = []
                for idx, (start, window) in enumerate(windows(text, chunk, overlap)):
                    held.append((key, idx, start, start + chunk >= len(text), window))
                    if len(held) == 256 or held[-1][3]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string()))], ["key", "idx", "start", "last", "window"])
                        held.clear()

    # copies of a text have the same key: one of them is kept, whichever it is
    return long_docs.mapInArrow(run, "key string, idx int, start long, last boolean, window string").groupBy("key", "idx", "start", "last").agg(F.first("window").alias("window"))


def _ends(chunks: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Boundaries of each window in the overlaps with its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            head, tail = [], []
            for start, last, window in zip(*(batch.column(c).to_pylist() for c in ("start", "last", "window"))):
                ends = trusted(codec, window, last)
                head.append([start + x for x in ends if 0 < x < overlap] if start else [])
                tail.append([start + x for x in ends if x > chunk])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("idx"), batch.column("start"), pa.array(head, kind), pa.array(tail, kind)], ["key", "idx", "start", "head", "tail"])

    return chunks.mapInArrow(run, "key string, idx int, start long, head array<long>, tail array<long>")


def encode_long(long_docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of distinct texts given as (key, text)."""
    chunks = materialize(_cut(long_docs, chunk, overlap), "chunks")
    order = Window.partitionBy("key").orderBy("idx")
    met = _ends(chunks, path, pattern, chunk, overlap).withColumn("at", F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    # a text in which some window doesn't meet its predecessor is put together again and stitched in one task
    begin = F.when(F.col("idx") == 0, F.lit(0)).otherwise(F.col("at"))
    broken = F.max(begin.isNull()).over(Window.partitionBy("key"))
    ranges = met.select("key", "idx", begin.alias("begin"), F.lead(begin).over(order).alias("end"), broken.alias("broken"))
    whole = lambda c, otherwise: F.when(F.col("broken"), F.lit(otherwise).cast("long")).otherwise(F.col(c).cast("long"))
    ranges = materialize(ranges.select("key", "idx", whole("idx", 0).alias("run"), whole("begin", 0).alias("begin"), whole("end", None).alias("end")), "stitches")

    def encode(table: pa.Table) -> pa.Table:
        codec = Codec(path, pattern)
        table = table.sort_by("idx")
        first, begin, end = (table.column(c)[0].as_py() for c in ("start", "begin", "end"))
        *ahead, final = table.column("window").to_pylist()
        text = "".join([w[:chunk] for w in ahead] + [final])
        ids = b"".join(encode_text(codec, text[begin - first : None if end is None else end - first], chunk, overlap))
        return pa.table({"key": table.column("key")[:1], "run": table.column("run")[:1], "ids": pa.array([ids], pa.binary())})

    def join_up(table: pa.Table) -> pa.Table:
        n, ids, raw = digest(Codec(path, pattern), (x.as_py() for x in table.sort_by("run").column("ids")))
        return pa.table({"key": table.column("key")[:1], "n_tokens": [n], "ids_sha256": [ids], "decoded_sha256": [raw]})

    pieces = chunks.join(ranges, ["key", "idx"]).groupBy("key", "run").applyInArrow(encode, "key string, run long, ids binary")
    return pieces.groupBy("key").applyInArrow(join_up, f"key string, {RESULT}")


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, local: int = LOCAL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            found = [digest(codec, encode_text(codec, text.as_py(), chunk, overlap)) for text in batch.column(1)]
            n, ids, raw = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    short = own.where(F.char_length("text") <= chunk * local).mapInArrow(run, f"doc_id {kind}, {RESULT}")
    long_docs = own.where(F.char_length("text") > chunk * local).withColumn("key", F.sha2("text", 256))
    if not long_docs.limit(1).count():
        return short
    long_docs = materialize(long_docs, "long")
    found = encode_long(long_docs.select("key", "text"), path, pattern, chunk, overlap)
    return short.unionByName(long_docs.select("doc_id", "key").join(found, "key").drop("key"))
