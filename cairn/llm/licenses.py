"""License scans: phrases, and an exact set-similarity join of text blocks with license notices.

A text block is any run of ``SPREAD`` times as many words as a template has, across lines. It matches
the template if it holds at least ``CONTAINMENT`` of the template's distinct words. Words of all
templates are ordered by how often the corpus has them, rarest first, counted over every word of every
text. A block with the needed overlap m of a template with n words must hold one of its first
n - m + 1 words (prefix filter); a text with fewer than m words known to the template has no such block
(length filter); and a block lies within reach of a prefix word, with enough of the template's words on
either side of it (position filter). What passes is counted word by word with a sliding window, so the
result is exact.

Templates are an argument whose size is checked (``TEMPLATE_WORDS``); they travel to the tasks.

Defined results: a null or empty text has no words and no labels; repeated rows are repeated in the
result; a null doc_id stays null; of several blocks of one text the highest containment is its score
(1 where a base phrase stands); an empty table gives an empty result. Very long texts are read in
pieces, of which only the places of known words are kept. Only the columns doc_id and text are read,
so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm import textbytes as tb
from cairn.runtime import ship

#: At this share, short notices must stand whole, and one with the words of another license isn't taken for this one.
CONTAINMENT = 0.9
#: Length of a block, as a multiple of the template's.
SPREAD = 1.25
#: Bound on the words of all templates and phrases together.
TEMPLATE_WORDS = 100_000

#: Phrases and their labels, as the task states them (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices looked for by containment: label and words (public standard headers, and short forms of them).
TEMPLATES = (
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


class Vocabulary:
    """Numbers of the words of templates and phrases."""

    def __init__(self, texts: list[str]):
        self.words = sorted({w for t in texts for w in t.split()})
        if len(self.words) > TEMPLATE_WORDS:
            raise ValueError(f"{len(self.words)} template words; at most {TEMPLATE_WORDS} can be sent to every task")
        self.number = {w.encode(): k for k, w in enumerate(self.words)}

    def of(self, phrase: str) -> list[int]:
        return [self.number[w.encode()] for w in phrase.split()]

    def find(self, text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """Places (words from 0) of known words in a text, which they are, and how many words it has."""
        at, word, n = [], [], 0
        for own in tb.folded_words(text):
            number = np.fromiter(map(self.number.get, own, repeat(-1)), np.int32, len(own))
            known = np.flatnonzero(number >= 0)
            at.append(known + n)
            word.append(number[known])
            n += len(own)
        return np.concatenate(at), np.concatenate(word), n


def word_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each known word stands in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            for text in tb.texts(batch.column(0)):
                total += np.bincount(vocabulary.find(text)[1], minlength=len(total))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["word", "n"])

    out = np.zeros(len(vocabulary.words), np.int64)
    sums = docs.select(F.col("text").cast("string")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # a row for each template word
        out[r["word"]] = r["n"]
    return out


def span_of(template: str) -> int:
    """Words of a block that is compared with a template."""
    return math.ceil(SPREAD * len(template.split()))


class Join:
    """The filters and the verification of one text, for templates whose words are ordered by ``frequency``."""

    def __init__(self, templates, vocabulary: Vocabulary, frequency: np.ndarray, containment: float):
        self.rows, heads = [], np.zeros((len(templates), len(vocabulary.words)), bool)
        for k, (label, template) in enumerate(templates):
            tokens = sorted(set(vocabulary.of(template)), key=lambda t: (frequency[t], t))
            need = math.ceil(containment * len(tokens) - 1e-9)
            heads[k, tokens[: len(tokens) - need + 1]] = True
            own = np.zeros(len(vocabulary.words), bool)
            own[tokens] = True
            self.rows.append((label, own, need, span_of(template), len(tokens)))
        self.heads, self.any_head = heads, heads.any(axis=0)

    def matches(self, at: np.ndarray, word: np.ndarray) -> dict[str, float]:
        """{label: highest containment} of the templates that a block of the text meets."""
        found: dict[str, float] = {}
        led = self.any_head[word]
        if not led.any():
            return found
        spots, own_heads = at[led], self.heads[:, word[led]]
        for k in np.flatnonzero(own_heads.any(axis=1)):
            label, tokens, need, span, n = self.rows[k]
            mine = tokens[word]
            if np.count_nonzero(mine) < need:
                continue
            places, kinds, prefix = at[mine], word[mine], spots[own_heads[k]]
            # words of the template within reach of the next prefix word on either side
            after = np.searchsorted(prefix, places)
            gap = np.minimum(np.where(after < len(prefix), prefix[np.minimum(after, len(prefix) - 1)] - places, span), np.where(after > 0, places - prefix[after - 1], span))
            near = np.flatnonzero(gap < span)
            places, kinds = places[near], kinds[near]
            # a block that begins at a word has at most as many of the template's words as stand in its span
            stop = np.searchsorted(places, places + span)
            if (stop - np.arange(len(places))).max(initial=0) < need:
                continue
            best = self._densest(places.tolist(), kinds.tolist(), span)
            if best >= need:
                found[label] = max(best / n, found.get(label, 0.0))
        return found

    @staticmethod
    def _densest(places: list[int], kinds: list[int], span: int) -> int:
        """Most different words in any block of ``span`` words."""
        inside: dict[int, int] = {}
        best = first = 0
        for place, kind in zip(places, kinds):
            inside[kind] = inside.get(kind, 0) + 1
            while places[first] <= place - span:
                left = kinds[first]
                inside[left] -= 1
                if not inside[left]:
                    del inside[left]
                first += 1
            best = max(best, len(inside))
        return best


def phrase_places(at: np.ndarray, word: np.ndarray, numbers: list[int]) -> np.ndarray:
    """Places at which the phrase's words stand one after another."""
    starts = np.flatnonzero(word[: max(0, len(word) - len(numbers) + 1)] == numbers[0])
    for j, number in enumerate(numbers[1:], 1):
        starts = starts[(word[starts + j] == number) & (at[starts + j] == at[starts] + j)]
    return at[starts]


def scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every text."""
    ship(docs.sparkSession)
    vocabulary = Vocabulary([*(t for _, t in templates), *phrases])
    join = Join(templates, vocabulary, word_frequencies(docs, vocabulary), containment)
    spelled = [(vocabulary.of(p), label) for p, label in phrases.items()]

    def judge(text: bytes) -> tuple:
        at, word, n_words = vocabulary.find(text)
        places = [(phrase_places(at, word, numbers), label) for numbers, label in spelled]
        every = np.concatenate([p for p, _ in places]) if places else np.zeros(0, np.int64)
        base = sorted({label for p, label in places if len(p)})
        more = join.matches(at, word)
        low, high = (int(every.min()), int(every.max())) if len(every) else (None, None)
        return n_words, len(every), low, high, ",".join(base), ",".join(sorted({*base, *more})), 1.0 if base else max(more.values(), default=0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        for batch in batches:
            rows = list(zip(*map(judge, tb.texts(batch.column(1))))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
