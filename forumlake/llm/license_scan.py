"""License scan: an exact join of text blocks with templates on the share of a template's words.

Words are runs of ASCII digits and letters, lower-cased, and of characters beyond
ASCII. A block is a longest run of lines that hold a word each. A block meets a
template if it holds CONTAINED hundredths of the template's distinct words.

The join is a prefix join. All words of templates are ordered by the number of
blocks of the whole corpus that hold them, rarest first. A block that meets a
template of t words, of which it needs o, holds one of its t - o + 1 rarest, so
only those words lead from a block to a template (prefix filter); a block with
fewer words of templates than o is left (length filter), and so is one in which
the words from the first common one on, on either side, are fewer than o
(position filter). The pairs left are counted in full. No block is dropped on
any other ground, so that the join is exact. Templates are a table of a checked
size, which goes to every task: blocks stay where they are, and a frequent word
moves no rows. What is shuffled are counts of the templates' words.

A pair that meets the threshold then has to meet it in WINDOW times the
template's length in words at one place, so that a long block doesn't match by
scattered words. Phrases are found apart from blocks, as words in a row.

Defined results: null and empty texts and texts without words have no places, no
matches and no words; repeated rows and rows with a null doc_id are returned
each; an empty table gives no rows; other columns are ignored. Words are compared
by 64-bit hashes and lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import _WORD, slices, spans

#: Hundredths of a template's words that a block holds; words of a window for each word of the template; words of all templates at most.
CONTAINED, WINDOW, VOCABULARY = 90, 2, 20_000

#: Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Usual wordings of license notices and their labels.
TEMPLATES = (
    ("agpl", "GNU Affero General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike"),
    ("cc0", "waived all copyright and related or neighboring rights"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)


def template_words(text: str) -> list[str]:
    """The words of a template or a phrase, in order."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    _, lowered, offsets = next(slices(pa.array([text]), latin=False))
    starts, ends, _ = spans(lowered, offsets, _WORD) if len(data) else ([], [], [])
    return [bytes(lowered[a:b]).decode() for a, b in zip(starts, ends)]


@dataclass(frozen=True)
class Vocabulary:
    """The words of templates and phrases by hash, each with its length and number."""

    words: list[str]
    hashes: np.ndarray
    sizes: np.ndarray
    numbers: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Vocabulary:
        found = []
        for k, word in enumerate(words):
            _, lowered, offsets = next(slices(pa.array([word]), latin=False))
            found.append((int(spans(lowered, offsets, _WORD)[2][0]), len(lowered), k))
        found.sort()
        return cls(words, np.array([x[0] for x in found], dtype=np.uint64), np.array([x[1] for x in found]), np.array([x[2] for x in found]))

    def look_up(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where((self.hashes[at] == hashes) & (self.sizes[at] == sizes), self.numbers[at], -1)


@dataclass(frozen=True)
class Words:
    """The words of a slice: rows, places in them, numbers in the vocabulary and blocks; first is the row that the slice begins with."""

    first: int
    counts: np.ndarray
    rows: np.ndarray
    places: np.ndarray
    numbers: np.ndarray
    blocks: np.ndarray


def _words(column: pa.Array, known: Vocabulary) -> Iterator[Words]:
    for first, text, offsets in slices(column, latin=False):
        starts, ends, hashes = spans(text, offsets, _WORD)
        rows = np.searchsorted(offsets, starts, side="right") - 1
        counts = np.bincount(rows, minlength=len(offsets) - 1)
        places = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
        # A block ends with its row, or where a line without words follows.
        lines = np.searchsorted(np.flatnonzero(text == 10), starts)
        cut = np.ones(len(starts), dtype=bool)
        cut[1:] = (rows[1:] != rows[:-1]) | (lines[1:] > lines[:-1] + 1)
        yield Words(first, counts, rows, places, known.look_up(hashes, ends - starts), np.cumsum(cut) - 1)


def _distinct(blocks: np.ndarray, numbers: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a block and a word of the vocabulary, in this order."""
    pairs = np.unique(blocks * width + numbers)
    return pairs // width, pairs % width


def frequencies(docs: DataFrame, words: list[str]) -> list[int]:
    """The number of blocks of all docs that hold each word. Counts of the vocabulary, VOCABULARY at most, are collected."""
    known = Vocabulary.of(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            for w in _words(batch.column("text"), known):
                held = w.numbers >= 0
                found += np.bincount(_distinct(w.blocks[held], w.numbers[held], len(words))[1], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int32()), pa.array(found)], ["word", "n"])

    summed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r.word: r.n for r in summed.collect()}
    return [counts.get(k, 0) for k in range(len(words))]


class Join:
    """The templates, their words ordered by frequency, and the ways from rare words to templates."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], words: list[str]):
        """words: those of templates and phrases, rarest first."""
        self.known = Vocabulary.of(words)
        number = {w: k for k, w in enumerate(words)}
        self.labels = [label for label, _ in templates]
        self.phrases = [(label, [number[w] for w in template_words(text)]) for text, label in phrases]
        in_order = [[number[w] for w in template_words(text)] for _, text in templates]
        self.windows = [WINDOW * len(x) for x in in_order]
        sets = [sorted(set(x)) for x in in_order]
        self.sizes = np.array([len(x) for x in sets], dtype=np.int64)
        self.needed = (CONTAINED * self.sizes + 99) // 100
        self.members = np.zeros((len(sets), len(words)), dtype=bool)
        ways = []
        for t, x in enumerate(sets):
            self.members[t, x] = True
            ways += [(word, t, i) for i, word in enumerate(x[: len(x) - int(self.needed[t]) + 1])]
        ways.sort()
        self.way_word, self.way_template, self.way_place = (np.array([x[k] for x in ways], dtype=np.int64) for k in range(3))

    def candidates(self, blocks: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a block and a template that no filter leaves out, from the distinct words of blocks in their order."""
        n = len(self.labels)
        of, first, size = np.unique(blocks, return_index=True, return_counts=True)
        block = np.searchsorted(of, blocks)
        left, right = np.searchsorted(self.way_word, words), np.searchsorted(self.way_word, words, side="right")
        many = right - left
        at = np.repeat(np.arange(len(words)), many)
        way = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + left[at]
        # The first common word of a block and a template in the order of words.
        _, once = np.unique(blocks[at] * n + self.way_template[way], return_index=True)
        at, way = at[once], way[once]
        template, all_ = self.way_template[way], size[block[at]]
        needed = self.needed[template]
        rest = np.minimum(self.sizes[template] - self.way_place[way], all_ - (at - first[block[at]]))
        kept = (all_ >= needed) & (rest >= needed)
        return blocks[at[kept]], template[kept]

    def best_window(self, template: int, places: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
        """The most distinct words of a template that stand in one window, and the window's first and last."""
        own = self.members[template][words]
        places, words = places[own].tolist(), words[own].tolist()
        held: dict[int, int] = {}
        best, left = (0, 0, 0), 0
        for right, word in enumerate(words):
            held[word] = held.get(word, 0) + 1
            while places[left] <= places[right] - self.windows[template]:
                if held[words[left]] == 1:
                    del held[words[left]]
                else:
                    held[words[left]] -= 1
                left += 1
            if len(held) > best[0]:
                best = (len(held), places[left], places[right])
        return best

    def matches(self, w: Words) -> Iterator[tuple[int, dict]]:
        """(row, match) of the blocks that meet a template, in order."""
        held = np.flatnonzero(w.numbers >= 0)
        if not len(held):
            return
        blocks, words = _distinct(w.blocks[held], w.numbers[held], len(self.known.words))
        own = w.blocks[held]
        for block, t in zip(*(x.tolist() for x in self.candidates(blocks, words))):
            a, b = np.searchsorted(blocks, [block, block + 1])
            if self.members[t][words[a:b]].sum() >= self.needed[t]:
                some = held[slice(*np.searchsorted(own, [block, block + 1]))]
                most, first, last = self.best_window(t, w.places[some], w.numbers[some])
                if most >= self.needed[t]:
                    yield int(w.rows[some[0]]), {"label": self.labels[t], "first": first, "last": last, "share": most / int(self.sizes[t])}

    def places(self, w: Words) -> Iterator[tuple[int, dict]]:
        """(row, place) of the phrases, in order for each phrase."""
        for label, words in self.phrases:
            n = len(w.numbers) - len(words) + 1
            if n > 0:
                found = w.rows[:n] == w.rows[len(words) - 1 :]
                for k, word in enumerate(words):
                    found &= w.numbers[k : k + n] == word
                for i in np.flatnonzero(found).tolist():
                    yield int(w.rows[i]), {"label": label, "first": int(w.places[i])}


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))
_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """(doc_id, n_words, places, matches) of every row: places (label, first) of phrases, matches (label, first, last, share) of templates, by words from 0.

    templates: (label, text); phrases: (text, label). One pass counts the words of both, the next one joins."""
    templates, phrases = [x for x in templates if template_words(x[1])], [x for x in phrases if template_words(x[0])]
    words = sorted({w for text in [x[1] for x in templates] + [x[0] for x in phrases] for w in template_words(text)})
    if not words or len(words) > VOCABULARY:
        raise ValueError(f"templates and phrases have {len(words)} words; from 1 to {VOCABULARY} are taken")
    order = sorted(range(len(words)), key=lambda k, n=frequencies(docs, words): (n[k], k))
    join = Join(templates, phrases, [words[k] for k in order])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in _words(batch.column("text"), join.known):
                found: tuple[list, list] = ([[] for _ in w.counts], [[] for _ in w.counts])
                for kind, of in zip(found, (join.places, join.matches)):
                    for row, x in of(w):
                        kind[row].append(x)
                ids = batch.column("doc_id").slice(w.first, len(w.counts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(w.counts, pa.int64()), pa.array(found[0], _PLACES), pa.array(found[1], _MATCHES)], ["doc_id", "n_words", "places", "matches"])

    kind = "doc_id long, n_words long, places array<struct<label:string,first:long>>, matches array<struct<label:string,first:long,last:long,share:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, kind)


def labelled(scanned: DataFrame) -> DataFrame:
    """The digest of a scan: numbers and ends of places, labels of places and of both, and a score: 1 if a phrase stands there, else the largest share of a match, 0 without any."""
    at, base = F.col("places.first"), F.col("places.label")
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("matches.share")), F.lit(0.0)))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.col("matches.label"))).alias("labels"), score.alias("score"),
    )
