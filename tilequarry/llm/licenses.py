"""License scan: an exact set-similarity join of text blocks with license templates by containment.

A block is a line of a text; a line of more than ``BLOCK_WORDS`` words is several blocks of that many, each starting half
a block after the one before. So that a notice broken by line feeds lies in a block too, a text of several lines is also
dealt into such blocks as a whole. Blocks and templates are sets of lower-cased words. A block B meets a template T if it
holds at least ceil(threshold * |T|) = o of its words. All words of templates are ordered by how many words of the whole
corpus equal them, rarest first (one counting pass; the vocabulary is that of the templates, so the counts are small).
Then a block that meets T

* holds one of the first |T| - o + 1 words of T (prefix filter),
* has at least o words (length filter), and
* from the first of T's words on that it holds, T has at least o words left, and so has the block among words of
  templates in the same order (positional filter).

What remains is verified by counting. Every pair over the threshold is found; nothing is sampled or capped. Where a block
meets two templates and one's words are among the other's, the label is that of the larger.

Defined results: a null or empty text has no words, no labels and score 0; a null document id stays null; repeated rows
give repeated results; an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .words import NOT_ALNUM, Words, find_words

BLOCK_WORDS = 128
THRESHOLD = 0.9
# The phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices by which works commonly state their license.
TEMPLATES = {
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["licensed under the GNU Lesser General Public License"],
    "agpl": ["licensed under the GNU Affero General Public License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["dedicated to the public domain under CC0 1.0 Universal"],
}


def _words(texts: list[str]) -> list[np.ndarray]:
    out = []
    for w in find_words(pa.array(texts), NOT_ALNUM, lower=True):
        h = w.hashes()
        out += [h[a:b] for a, b in zip(w.first, w.first[1:])]
    return out


class Templates:
    """Templates as word sets over a small vocabulary; :meth:`order` gives the vocabulary's order by corpus counts."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.labels = [label for label, texts in templates.items() for _ in texts]
        sets = [np.unique(h) for h in _words([t for texts in templates.values() for t in texts])]
        self.vocabulary = np.unique(np.concatenate(sets))
        self.sets = [np.searchsorted(self.vocabulary, s) for s in sets]
        self.least = [math.ceil(threshold * len(s) - 1e-9) for s in sets]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def order(self, counts: np.ndarray) -> Templates:
        rank = np.empty(len(self.vocabulary), np.int64)
        rank[np.lexsort((self.vocabulary, counts))] = np.arange(len(rank))
        self.rank = rank
        self.by_prefix: dict[int, list[tuple[int, int]]] = {}
        for t, (s, o) in enumerate(zip(self.sets, self.least)):
            self.sets[t] = s = s[np.argsort(rank[s])]
            for place, word in enumerate(s[: len(s) - o + 1].tolist()):
                self.by_prefix.setdefault(word, []).append((t, place))
        self.in_prefix = np.zeros(len(rank) + 1, bool)  # the last entry answers for -1
        self.in_prefix[list(self.by_prefix)] = True
        return self

    def met(self, words: Words, numbers: np.ndarray, block_words: int = BLOCK_WORDS) -> dict[int, dict[int, float]]:
        """For each text with a match: its templates and their best containment."""
        hits = np.flatnonzero(self.in_prefix[numbers])
        if not len(hits):
            return {}
        text = np.searchsorted(words.first, hits, "right") - 1
        # A line begins at a text's first byte and after each line feed.
        lines = np.union1d(np.flatnonzero(words.data == 10) + 1, words.offsets[:-1])
        line = np.searchsorted(lines, words.starts[hits], "right") - 1
        begin = np.searchsorted(words.starts, lines[line])
        stop = np.searchsorted(words.starts, np.append(lines, len(words.data))[line + 1])
        # The same hits once more, for blocks of the whole text, where that is more than the line.
        more = (words.first[text] < begin) | (words.first[text + 1] > stop)
        begin = np.append(begin, words.first[text][more])
        stop = np.append(stop, words.first[text + 1][more])
        hits, text = np.append(hits, hits[more]), np.append(text, text[more])
        found: dict[tuple[int, int, int], dict[int, float]] = {}
        sets: dict[tuple[int, int], np.ndarray] = {}
        seen: set[tuple[int, int, int]] = set()
        half = block_words // 2
        for w, d, a, b in zip(hits.tolist(), text.tolist(), begin.tolist(), stop.tolist()):
            k = (w - a) // half
            for at in {max(0, k - 1), k} if b - a > block_words else {0}:
                low = a + at * half
                high = min(b, low + block_words)
                for t, place in self.by_prefix[int(numbers[w])]:
                    o = self.least[t]
                    if high - low < o or (low, high, t) in seen:
                        continue
                    if (low, high) not in sets:
                        held = np.unique(numbers[low:high])
                        sets[low, high] = np.sort(self.rank[held[held >= 0]])
                    held, rank = sets[low, high], self.rank[self.sets[t]]
                    if len(self.sets[t]) - place < o or len(held) - np.searchsorted(held, rank[place]) < o - place:
                        continue
                    seen.add((low, high, t))
                    overlap = int(np.isin(rank, held, assume_unique=True).sum())
                    if overlap >= o:
                        found.setdefault((d, low, high), {})[t] = overlap / len(rank)
        out: dict[int, dict[int, float]] = {}
        for (d, *_), met in found.items():
            for t, c in met.items():
                if not any(set(self.sets[t]) < set(self.sets[u]) for u in met):
                    out.setdefault(d, {})[t] = max(out.get(d, {}).get(t, 0.0), c)
        return out


def phrase_places(words: Words, hashes: np.ndarray, phrases: list[list[np.uint64]]) -> list[np.ndarray]:
    """For each phrase, the numbers of the words at which it begins."""
    ends = np.repeat(words.first[1:], words.counts)
    out = []
    for p in phrases:
        at = np.flatnonzero(hashes == p[-1]) - (len(p) - 1)
        at = at[at >= 0]
        for k, h in enumerate(p):
            at = at[hashes[at + k] == h]
        out.append(at[at + len(p) <= ends[at]])
    return out


def corpus_counts(docs: DataFrame, templates: Templates) -> np.ndarray:
    """How many words of all texts equal each word of the vocabulary. One small row a partition is summed."""
    n = len(templates.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            for w in find_words(b.column(0), NOT_ALNUM, lower=True):
                v = templates.numbers(w.hashes())
                total += np.bincount(v[v >= 0], minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], ["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(n, np.int64)
    for word, c in rows:
        counts[word] = c
    return counts


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: its words, phrase places and labels; ``score`` is the best containment, 1 with a phrase."""
    store.small_batches(docs.sparkSession)
    index = Templates(templates, threshold)
    index.order(corpus_counts(docs, index))
    targets = [list(h) for h in _words(list(phrases))]
    names = list(phrases.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in find_words(b.column(1), NOT_ALNUM, lower=True):
                h = w.hashes()
                n = len(w.counts)
                n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base: dict[int, set[str]] = {}
                for name, at in zip(names, phrase_places(w, h, targets)):
                    d = np.searchsorted(w.first, at, "right") - 1
                    place = at - w.first[d]
                    np.add.at(n_base, d, 1)
                    np.minimum.at(first, d, place)
                    np.maximum.at(last, d, place)
                    for x in np.unique(d).tolist():
                        base.setdefault(x, set()).add(name)
                met = index.met(w, index.numbers(h))
                labels, score = [""] * n, np.zeros(n)
                base_labels = [",".join(sorted(base.get(d, ()))) if d in base else "" for d in range(n)]
                for d in base.keys() | met.keys():
                    labels[d] = ",".join(sorted(base.get(d, set()) | {index.labels[t] for t in met.get(d, ())}))
                    score[d] = 1.0 if d in base else max(met[d].values())
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(w.row, n), pa.array(w.counts), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(base_labels), pa.array(labels), pa.array(score)],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
