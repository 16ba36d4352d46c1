"""License scans by an exact set-similarity join with notice templates.

A text's words are cut into blocks of twice a template's width, each half
overlapping the next, so every passage as wide as the template lies in one
block whole.  A block matches when it contains at least ``CONTAINMENT`` of
the template's distinct words.  Template words are ordered by how many
documents of the corpus hold them, rarest first; a matching block must hold
one of the first |T| - need + 1 (prefix filter), enough words behind the first
that it holds (positional filter) and enough words at all (length filter).
What passes is counted exactly, and every block that matches is returned; a
passage in the overlap of two blocks is in both.  The templates are a fixed list, so every
task holds them all and no text is shuffled.

Besides, three base phrases are found wherever their words stand in a row.

Defined cases: null text is empty, with no words and no labels; repeated rows
and null ids are scanned one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.llm.common import text_or_empty

# The base phrases.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

# Notices of public licences, in the words their authors ask for.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files, to deal in the Software without restriction",
    "mit-short": "This project is released under the terms of the MIT license",
    "apache-2": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. "
                "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
           "License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    "all-rights": "Copyright all rights reserved no part of this work may be reproduced without written permission",
}
CONTAINMENT = 80  # per cent

# Lower-cases A-Z; every other ASCII character but letters and digits parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _need(n: int) -> int:
    return -(-n * CONTAINMENT // 100)


class Templates:
    """The templates under a global word order."""

    def __init__(self, texts: dict[str, str], frequency: dict[bytes, int]):
        self.names = list(texts)
        self.words = [words_of(t.encode()) for t in texts.values()]
        self.sets = [frozenset(w) for w in self.words]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for t, s in enumerate(self.sets):
            order = sorted(s, key=lambda w: (frequency.get(w, 0), w))
            for i, w in enumerate(order[:len(order) - _need(len(order)) + 1]):
                self.prefix.setdefault(w, []).append((t, i))
        self.rare = frozenset(self.prefix)

    def matches(self, words: list[bytes]) -> dict[int, tuple[float, int]]:
        """{template: (containment, first word of the best block)} of those that meet the threshold."""
        out: dict[int, tuple[float, int]] = {}
        for t, containment, at in self.blocks(words):
            if containment > out.get(t, (0.0, 0))[0]:
                out[t] = (containment, at)
        return out

    def blocks(self, words: list[bytes]) -> list[tuple[int, float, int]]:
        """(template, containment, first word) of every block that meets the threshold, by template and place."""
        if self.rare.isdisjoint(words):
            return []
        blocks: dict[tuple[int, int], int] = {}
        for pos, w in enumerate(words):
            if w in self.rare:
                for t, i in self.prefix[w]:
                    b = pos // len(self.words[t])
                    for k in (b - 1, b) if b else (b,):
                        blocks[t, k] = min(i, blocks.get((t, k), i))
        out = []
        for (t, k), i in sorted(blocks.items()):
            s, width = self.sets[t], len(self.words[t])
            if len(s) - i < _need(len(s)):
                continue
            block = set(words[k * width:(k + 2) * width])
            if len(block) < _need(len(s)):
                continue
            both = len(s & block)
            if both >= _need(len(s)):
                out.append((t, both / len(s), k * width))
        return out


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Every word at which the phrase starts."""
    first, n, out, at = phrase[0], len(phrase), [], -1
    while True:
        try:
            at = words.index(first, at + 1)
        except ValueError:
            return out
        if words[at:at + n] == phrase:
            out.append(at)


def _count(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, int] = {}
            for text in b.column("text").cast(pa.binary()).to_pylist():
                for w in vocabulary.intersection(words_of(text)):
                    seen[w] = seen.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
    return run


def global_order(docs: DataFrame, text_col: str = "text", texts: dict[str, str] | None = None) -> Templates:
    """Counts the documents that hold each template word, over the whole corpus."""
    texts = texts or TEMPLATES
    vocabulary = frozenset(w for t in texts.values() for w in words_of(t.encode()))
    counted = (docs.select(text_or_empty(text_col).alias("text")).mapInArrow(_count(vocabulary), "word binary, n long")
               .groupBy("word").agg(F.sum("n").alias("n")))
    return Templates(texts, {bytes(r["word"]): r["n"] for r in counted.collect()})  # a row for each template word


_SCAN = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
         "matches array<struct<template: string, containment: double, block: long>>")


def _scan(templates: Templates):
    phrases = {k: words_of(v.encode()) for k, v in PHRASES.items()}

    def one(text: bytes):
        words = words_of(text)
        found = {k: places(words, p) for k, p in phrases.items()}
        starts = [x for v in found.values() for x in v]
        base = {k for k, v in found.items() if v}
        hits = sorted((templates.names[t], at, c) for t, c, at in templates.blocks(words))
        labels = base | {("mit" if k == "mit-short" else k) for k, _, _ in hits}
        best = max([c for _, _, c in hits], default=0.0)
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(labels)), 1.0 if base else best,
                [{"template": k, "containment": c, "block": at} for k, at, c in hits])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64()), ("block", pa.int64())]))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), match]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
        for b in batches:
            rows = [one(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["id", *names])
    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """One row per document: id, word and phrase counts, labels, score and all matched blocks."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = rows.mapInArrow(_scan(global_order(docs, text_col, texts)), f"id {dict(rows.dtypes)['id']}, {_SCAN}")
    return found.withColumnRenamed("id", id_col)
