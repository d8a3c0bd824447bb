"""Words of the texts of an Arrow column, by the C routines of Python's ``bytes``.

A text is taken in pieces of about ``PIECE_BYTES`` that end behind a separator, so only one piece's
words exist at a time, however long the text is. Words are compared as bytes (through dictionaries),
never by a hash of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 500_000

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_NON_ALNUM = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: ASCII letters in lower case, ASCII digits and all bytes beyond ASCII stay; the rest separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
SPACES = bytes([32, *range(9, 14)])
CONTINUATION = bytes(range(128, 192))


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; a null text counts as empty."""
    for x in column:
        own = x.as_buffer()
        yield b"" if own is None else own.to_pybytes()


def pieces(text: bytes, limit: int = PIECE_BYTES, separator: re.Pattern = _SPACE) -> Iterator[bytes]:
    """The text in order, cut behind separators; one word longer than the limit makes its piece longer."""
    start = 0
    while len(text) - start > limit:
        found = separator.search(text, start + limit)
        if found is None:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:] if start else text


def spaced_words(text: bytes, limit: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """Runs without white space, piece by piece."""
    return (piece.split() for piece in pieces(text, limit))


def folded_words(text: bytes, limit: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """Runs of ASCII letters (in lower case), ASCII digits and other characters, piece by piece."""
    return (piece.translate(_FOLD).split() for piece in pieces(text, limit, _NON_ALNUM))


def byte_segments(column: pa.Array, limit: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, text of each segment) of whole texts that together stay near ``limit`` bytes.

    A longer text is cut into segments that share ``overlap`` bytes with the next one, so each run of
    ``overlap + 1`` bytes lies in exactly one segment. A null text is a segment without bytes.
    """
    if not len(column):
        return
    column = column.fill_null("").cast(pa.large_string())
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        if end <= start:  # one long text
            low, high = int(offsets[start]), int(offsets[start + 1])
            for at in range(low, high, limit):
                own = data[at : min(at + limit + overlap, high)]
                yield own, np.array([0, len(own)]), np.array([start])
            end = start + 1
        else:
            end = min(end, len(column))
            yield data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start], np.arange(start, end)
        start = end
