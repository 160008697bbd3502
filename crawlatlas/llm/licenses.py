"""License scans by a positional index of rare template words.

Templates are licence texts and notices. Document frequencies of their words come from the whole
corpus. A match must hold a mandatory key phrase of its template, so the words around each key phrase
are looked up in the template's positional index; places that agree relative to the file's are
intersected; and an alignment with the key phrase inside is kept if its words of highest IDF cover
enough of the weight of the template's. What else stands in the file has no influence.

Words are runs of digits, letters a to z (A to Z lower-cased) and all characters beyond ASCII. Base
phrases are found wherever their words stand next to each other, whatever the index says.

Defined results: null or empty text has no words, no labels and score 0; repeated rows each get a
result; an empty table gives none; extra columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlatlas.llm.common import CHUNK

# Phrases, and texts of public licences with the phrases of which one must stand in a match.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction",
     ["permission is hereby granted free of charge"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("apache", "Licensed under the Apache License, Version 2.0", ["apache license"]),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License "
               "is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
     ["unless required by applicable law"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ["general public license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation", ["gnu general public license"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License", ["lesser general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted", ["permission to use copy modify"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
     ["mozilla public license"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License",
     ["creative commons attribution"]),
]

WORD_BYTES = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
                   for b in range(256))
#: Rare words that count per alignment, words by which a position may be off, share of a template's weight.
RARE_WORDS, SLACK, COVERAGE = 16, 2, 0.7


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Index:
    """Positional index of the templates, weighted by IDF."""

    def __init__(self, templates=TEMPLATES, frequency: dict[bytes, int] | None = None, documents: int = 0):
        self.labels = [label for label, _, _ in templates]
        self.texts = [words_of(text) for _, text, _ in templates]
        self.keys = [[b" " + b" ".join(words_of(k)) + b" " for k in keys] for _, _, keys in templates]
        self.places: list[dict[bytes, list[int]]] = [defaultdict(list) for _ in self.texts]
        for own, words in zip(self.places, self.texts, strict=True):
            for at, word in enumerate(words):
                own[word].append(at)
        known = frequency or {}
        self.idf = {w: math.log((documents + 1) / (known.get(w, 0) + 1)) + 1e-6 for own in self.places for w in own}
        self.most = [self.weight(set(own)) for own in self.places]

    def regions(self, t: int, joined: bytes) -> list[tuple[int, int]]:
        """Ranges of words, apart from each other, that hold all alignments of a template with a key phrase inside."""
        reach, out = len(self.texts[t]) + 2 * SLACK, []
        for p in sorted(p for k in self.keys[t] for p in word_places(joined, k)):
            if out and p - reach <= out[-1][1]:
                out[-1] = (out[-1][0], p + reach)
            else:
                out.append((max(0, p - reach), p + reach))
        return out

    def scan(self, words: list[bytes], joined: bytes | None = None) -> dict[str, float]:
        """Labels that the method finds, with the share of the template's weight that they cover."""
        joined = b" " + b" ".join(words) + b" " if joined is None else joined
        found: dict[str, float] = {}
        for t in range(len(self.texts)):
            for first, last in self.regions(t, joined):
                share = self.best(t, words, first, last)
                if share >= max(COVERAGE, found.get(self.labels[t], 0)):
                    found[self.labels[t]] = share
        return found

    def best(self, t: int, words: list[bytes], first: int, last: int) -> float:
        """The largest share that an alignment within a region covers, a key phrase inside; 0 without one."""
        own, size, best = self.places[t], len(self.texts[t]), 0.0
        seen: dict[int, set[bytes]] = defaultdict(set)
        for at, word in enumerate(words[first:last], first):
            for place in own.get(word, ()):
                seen[at - place].add(word)
        for shift in seen:
            near = set().union(*(seen.get(shift + d, ()) for d in range(-SLACK, SLACK + 1)))
            share = self.weight(near) / self.most[t]
            if share > best and share >= COVERAGE:
                inside = b" " + b" ".join(words[max(0, shift - SLACK):shift + size + SLACK]) + b" "
                if any(k in inside for k in self.keys[t]):
                    best = share
        return best

    def weight(self, words: set[bytes]) -> float:
        """Weight of the rarest words."""
        return sum(sorted((self.idf[w] for w in words), reverse=True)[:RARE_WORDS])


def word_places(joined: bytes, needle: bytes) -> list[int]:
    """Numbers of the words at which a needle of words, a blank around each, begins."""
    at, counted, n, out = joined.find(needle), 0, 0, []
    while at >= 0:
        n += joined.count(b" ", counted, at)
        counted = at
        out.append(n)
        at = joined.find(needle, at + 1)
    return out


def base_places(joined: bytes) -> list[tuple[int, str]]:
    """(start, label) of every base phrase."""
    return [(n, label) for phrase, label in BASE.items() for n in word_places(joined, b" " + phrase.encode() + b" ")]


def frequencies(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> tuple[dict[bytes, int], int]:
    """In how many rows each template word stands, and the number of rows. At most the template words
    reach the driver."""
    wanted = frozenset(w for _, t, _ in templates for w in words_of(t))

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            found[b""] += batch.num_rows
            for i in range(0, batch.num_rows, CHUNK):
                for t in batch.column(0).slice(i, CHUNK).to_pylist():
                    found.update(wanted & set(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                                         ["word", "n"])

    rows = (docs.select(text).mapInArrow(run, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts, counts.pop(b"", 0)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    index = Index(templates, *frequencies(docs, text, templates))

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), CHUNK):
                rows = []
                for t in texts.slice(at, CHUNK).to_pylist():
                    words = words_of(t)
                    joined = b" " + b" ".join(words) + b" "
                    base, more = base_places(joined), index.scan(words, joined)
                    own = {label for _, label in base}
                    starts = [n for n, _ in base]
                    rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None),
                                 ",".join(sorted(own)), ",".join(sorted(own | more.keys())),
                                 max([0.5 * bool(own), *more.values()])))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (
                    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(at, CHUNK), *columns], [
                    "key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
             "labels string, score double")
    return out.withColumnRenamed("key", key)
