"""License scan: text blocks that contain a licence template, and places of licence names.

Method: an exact set-similarity join of text blocks with templates. Tokens are words, ordered by their frequency over all
documents (a first pass counts just the words of the templates). A block contains a template if it holds at least ``threshold`` of
its distinct words. It then holds one of the template's ``n - ceil(threshold * n) + 1`` rarest words (prefix filter), so only blocks
around those words are looked at. A block with fewer words than are needed is out (length filter), and the words are
looked up from the rarest on until too few are left to reach the threshold (positional filter).

Blocks: for a template of w words, the stretches of 2 w words that begin at multiples of w, so any w words in a row lie
in one block. A template of threshold 1 that is marked ``exact`` is a phrase: its blocks are all stretches of its own
length, its prefix is its rarest word, whose place in the phrase gives the only start to verify word by word.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import alnum_words, body, map_arrow, map_batches


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 0.8
    exact: bool = False


# The phrases and labels that every scan reports.
PHRASES = (
    Template("gpl", "gnu general public license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("cc-by", "cc by", 1.0, True),
    Template("mit", "mit license", 1.0, True),
)

# Opening sentences of public licence notices, as their stewards publish them.
NOTICES = (
    Template(
        "apache",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
    ),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation",
    ),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution International License"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)

FOUND = (
    "doc_id long, n_words long, phrase_starts array<int>, phrase_labels array<string>, "
    "block_starts array<int>, block_labels array<string>, block_scores array<double>"
)


class Matcher:
    """Templates as word numbers, and after ``order`` their rare words and where these lead."""

    def __init__(self, templates: tuple[Template, ...]):
        self.vocabulary: dict[bytes, int] = {}
        self.templates = [t for t in templates if alnum_words(t.text.encode())]
        self.words = [
            [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(t.text.encode())] for t in self.templates
        ]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int32, count=len(words))

    def order(self, counts: list[int]) -> None:
        """counts: occurrences over all documents by word number."""
        self.ordered, self.prefix = [], []
        for t, w in zip(self.templates, self.words):
            distinct = sorted(set(w), key=lambda x: (counts[x], x))
            need = ceil(t.threshold * len(distinct) - 1e-9)
            self.ordered.append((distinct, need))
            self.prefix.append(distinct[: len(distinct) - need + 1])
        self.rare = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        for p in self.prefix:
            self.rare[p] = True

    def find(self, ids: np.ndarray):
        """(phrases, blocks): starts and template numbers, the blocks with their containment."""
        places = np.flatnonzero(self.rare[ids])
        phrases, blocks = [], []
        if len(places):
            present = {int(w): places[ids[places] == w] for w in np.unique(ids[places])}
            for k, t in enumerate(self.templates):
                at = [present[w] for w in self.prefix[k] if w in present]
                if at:
                    if t.exact:
                        phrases += [(int(s), k) for s in self._phrase(k, ids, present)]
                    else:
                        blocks += self._blocks(k, ids, np.concatenate(at))
        return sorted(phrases), sorted(blocks)

    def _phrase(self, k: int, ids: np.ndarray, present: dict[int, np.ndarray]) -> np.ndarray:
        w = self.words[k]
        rarest = self.prefix[k][0]
        start = present[rarest] - w.index(rarest)
        start = start[(start >= 0) & (start + len(w) <= len(ids))]
        for i, x in enumerate(w):
            start = start[ids[start + i] == x]
        return start

    def _blocks(self, k: int, ids: np.ndarray, at: np.ndarray):
        distinct, need = self.ordered[k]
        step = len(self.words[k])
        numbers = np.unique(np.concatenate([at // step, at // step - 1]))
        for b in numbers[numbers >= 0]:
            block = ids[b * step : b * step + 2 * step]
            if len(block) < need:
                continue
            inside = set(block.tolist())
            left = len(distinct) - need  # words that may be missing
            for w in distinct:
                if w not in inside and (left := left - 1) < 0:
                    break
            else:
                yield int(b * step), k, sum(w in inside for w in distinct) / len(distinct)


def _counts(rows: DataFrame, matcher: Matcher) -> list[int]:
    """Occurrences of the templates' words over all documents (as many numbers as the templates have words)."""
    n = len(matcher.vocabulary) + 1

    def run(batches):
        total = np.zeros(n, dtype=np.int64)
        for batch in batches:
            for raw in batch.column("body").to_pylist():
                total += np.bincount(matcher.numbers(alnum_words(raw)), minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], names=["word", "n"])

    sums = map_arrow(rows.select("body"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = [0] * n
    for r in sums:
        counts[r.word] = r.n
    return counts


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[Template, ...] = PHRASES,
    notices: tuple[Template, ...] = NOTICES,
) -> DataFrame:
    """For each row: n_words, starts and labels of phrases, and starts, labels and containment of template blocks.

    Null and empty texts have no words and no matches. Repeated rows have a result each. Templates without a word match nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("body"))
    matcher = Matcher((*phrases, *notices))
    matcher.order(_counts(rows, matcher))
    labels = [t.label for t in matcher.templates]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, raw in zip(*(c.to_pylist() for c in batch.columns)):
            ids = matcher.numbers(alnum_words(raw))
            p, b = matcher.find(ids)
            out.append((doc_id, len(ids), [s for s, _ in p], [labels[k] for _, k in p], [x[0] for x in b],
                        [labels[x[1]] for x in b], [x[2] for x in b]))
        kinds = [pa.int64(), pa.int64(), *(pa.list_(t) for t in (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64()))]
        names = [f.split()[0] for f in FOUND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)

    return map_batches(rows, run, FOUND)


def op2_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def joined(*c: str):
        both = F.concat(*c) if len(c) > 1 else F.col(c[0])
        return F.array_join(F.array_sort(F.array_distinct(both)), ",")

    return license_scan(docs).select(
        "doc_id", "n_words", F.size("phrase_starts").cast("long").alias("n_base"),
        F.array_min("phrase_starts").cast("long").alias("first_word"), F.array_max("phrase_starts").cast("long").alias("last_word"),
        joined("phrase_labels").alias("base_labels"), joined("phrase_labels", "block_labels").alias("labels"),
        F.when(F.size("phrase_starts") > 0, 1.0).otherwise(F.coalesce(F.array_max("block_scores"), F.lit(0.0))).alias("score"),
    )
