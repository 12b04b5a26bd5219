"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line with a word, or a paragraph: a run of such lines. A template is a set of
words; a block meets it if it contains THRESHOLD of them. Only words that some template has can
be shared, so a block is the set of those it has, in the global order of words: rarest first
by the number of texts that have them, counted over all documents. By that order
 * the prefix filter looks up only a template's first words, so many that a block with none of
   them lacks too many;
 * the length filter passes blocks with as many such words as a template needs;
 * the positional filter drops a pair as soon as the words left on either side are too few.
Pairs that pass are verified by intersecting the sets: nothing is missed, nothing is approximate.
Notices share words; a block is labelled by the template it contains best, the longest of
equally good ones, then by the order of labels. The other pairs are returned all the same.

Templates are a parameter and small beside the documents. They are read on the driver and go
to the tasks in chunks of at most CHUNK_WORDS words, one pass over the text for each chunk, so
what a task holds is bounded however many there are. Documents are not shuffled; the count of
words is summed in the tasks first.

Fixed phrases are found as well, wherever their words stand consecutively. Null and empty texts
have no words, places or labels and score 0. Null ids stay null, repeated rows are rows of
their own and score alike, other columns are not read. No documents give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Share of a template's words that a block must contain, and words of the templates of one pass.
THRESHOLD, CHUNK_WORDS = 0.85, 50_000

#: The phrases of the base and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices by which licenses are named, as their authors recommend or as is common.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)

#: Bytes of words are kept, A-Z lowered, line ends too; all other ASCII is a space.
_WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() or b == 10 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORD_BYTES).split() if text else []


def _blocks(text: str) -> Iterator[list[bytes]]:
    """Words of every line that has any, and of every paragraph of several such lines."""
    paragraph, lines = [], 0
    for line in text.encode("utf-8", "replace").translate(_WORD_BYTES).split(b"\n"):
        words = line.split()
        if words:
            yield words
            paragraph += words
            lines += 1
        else:
            if lines > 1:
                yield paragraph
            paragraph, lines = [], 0
    if lines > 1:
        yield paragraph


class Templates:
    """Templates of one pass: their words in the global order and the index of their prefixes."""

    def __init__(self, templates: Iterable[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        sets = [(label, set(words_of(text))) for label, text in templates]
        self.rank = {w: i for i, w in enumerate(sorted({w for _, s in sets for w in s}, key=lambda w: (frequency.get(w, 0), w)))}
        self.labels = [label for label, _ in sets]
        self.words = [sorted(self.rank[w] for w in s) for _, s in sets]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.words]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, ranks in enumerate(self.words):
            for i in range(len(ranks) - self.need[t] + 1):
                self.index.setdefault(ranks[i], []).append((t, i))
        at = {r: w for w, r in self.rank.items()}
        self.prefixes = frozenset(at[r] for r in self.index)
        self.sets = [frozenset(r) for r in self.words]

    def met(self, words: list[bytes]) -> Iterator[tuple[float, int, str]]:
        """(containment, words, label) of the templates that a block meets."""
        block = sorted({self.rank[w] for w in words if w in self.rank})
        shared: dict[int, int] = {}
        for j, r in enumerate(block):
            for t, i in self.index.get(r, ()):
                if len(block) >= self.need[t]:  # length filter
                    had = shared.get(t, 0)
                    left = 1 + min(len(self.words[t]) - i - 1, len(block) - j - 1)
                    shared[t] = had + 1 if had >= 0 and had + left >= self.need[t] else -1  # positional filter
        for t, n in shared.items():
            if n > 0:
                both = len(self.sets[t].intersection(block))
                if both >= self.need[t]:
                    yield both / len(self.words[t]), len(self.words[t]), self.labels[t]


def _counted(vocabulary: frozenset[bytes]):
    """Task body: texts -> how many of the task's texts have each word of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(vocabulary.intersection(words_of(text.as_py())))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return run


def _scanned(templates: Templates):
    """Task body: row, text, met -> the same with the templates of this pass added to met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, before in zip(batch.column("text"), batch.column("met").to_pylist(), strict=True):
                text = text.as_py()
                pairs = {(m["place"], m["words"], m["label"]): m["score"] for m in before}
                if text and not templates.prefixes.isdisjoint(words_of(text)):
                    for place, words in enumerate(_blocks(text)):
                        for score, n, label in templates.met(words):
                            pairs[place, n, label] = max(score, pairs.get((place, n, label), 0.0))
                out.append([{"place": at, "words": n, "label": x, "score": c} for (at, n, x), c in sorted(pairs.items())])
            met = batch.schema.get_field_index("met")
            yield batch.set_column(met, batch.schema.field(met), pa.array(out, batch.schema.field(met).type))

    return run


def _places(words: list[bytes]) -> tuple[list[int], set[str]]:
    """Where the fixed phrases start, and the labels of those found."""
    joined = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for phrase, label in PHRASES:
        wanted, at, counted, word = f" {phrase} ".encode(), 0, 0, 0
        while (at := joined.find(wanted, at)) >= 0:
            word += joined.count(b" ", counted, at)
            counted = at
            places.append(word)
            labels.add(label)
            at += 1
    return places, labels


def _based(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: row, text, met -> row, met and what the fixed phrases give."""
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            words = words_of(text.as_py())
            places, labels = _places(words)
            rows.append((len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)))
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string())]
        made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("met"), *made], ["doc_id", "met", "n_words", "n_base", "first_word", "last_word", "phrases"])


def word_frequencies(docs: DataFrame, vocabulary: Iterable[bytes]) -> dict[bytes, int]:
    """Texts of ``docs`` that have each word; words of the vocabulary only, so no more than templates have."""
    counted = docs.select("text").mapInArrow(tidy(_counted(frozenset(vocabulary))), "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _chunks(templates: Iterable[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    chunk, size = [], 0
    for template in templates:
        n = len(words_of(template[1]))
        if not n:
            continue
        if chunk and size + n > CHUNK_WORDS:
            yield chunk
            chunk, size = [], 0
        chunk.append(template)
        size += n
    if chunk:
        yield chunk


def scan_licenses(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, met (place of the block, words and label of the template, containment), n_words, n_base, first_word, last_word, phrases for every row of ``docs(doc_id, text)``."""
    found = "array<struct<place:bigint,words:bigint,label:string,score:double>>"
    id_type = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.array().cast(found).alias("met"))
    for chunk in _chunks(templates):
        frequency = word_frequencies(docs, {w for _, text in chunk for w in words_of(text)})
        out = out.mapInArrow(tidy(_scanned(Templates(chunk, frequency, threshold))), f"doc_id {id_type}, text string, met {found}")
    return out.mapInArrow(tidy(_based), f"doc_id {id_type}, met {found}, n_words long, n_base long, first_word long, last_word long, phrases array<string>")


def best_labels(met: Column) -> Column:
    """Labels of the templates that blocks contain best."""
    of_block = lambda place: F.filter(met, lambda m: m["place"] == place)
    order = lambda m: F.struct(-m["score"], -m["words"], m["label"].alias("label"))
    return F.transform(F.array_distinct(F.transform(met, lambda m: m["place"])), lambda p: F.array_min(F.transform(of_block(p), order))["label"])


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (of the blocks' best templates too), score: the best containment, 1 where a fixed phrase stands."""
    rows = scan_licenses(docs)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.array_max(F.transform("met", lambda m: m["score"]))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("phrases")).alias("base_labels"),
        joined(F.concat("phrases", best_labels(F.col("met")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _place_sql(phrase: str) -> str:
    parts = phrase.split()
    same = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
    return f"list_filter(range(0, greatest(len(w) - {len(parts) - 1}, 0)), lambda i: {same})"


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_LOWERED} AS t FROM documents),
  w AS (SELECT doc_id, r, t, {_WORDS.format("t")} AS w FROM d),
  places AS (SELECT doc_id, r, len(w) AS n, {", ".join(f"{_place_sql(p)} AS p{i}" for i, (p, _) in enumerate(PHRASES))} FROM w),
  templates AS (SELECT label, list_distinct({_WORDS.format("lower(x)")}) AS s FROM (VALUES {", ".join(f"({_quoted(label)}, {_quoted(x)})" for label, x in TEMPLATES)}) AS v(label, x)),
  lines AS (SELECT r, i, {_WORDS.format("l[i]")} AS s FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT r, string_split(t, chr(10)) AS l FROM d))),
  runs AS (SELECT *, sum((len(s) = 0)::INT) OVER (PARTITION BY r ORDER BY i) AS g FROM lines),
  blocks AS (SELECT r, list_distinct(s) AS s FROM lines WHERE len(s) > 0 UNION ALL SELECT r, list_distinct(flatten(list(s))) FROM runs WHERE len(s) > 0 GROUP BY r, g),
  held AS (SELECT row_number() OVER () AS b, r, s FROM blocks WHERE list_has_any(s, (SELECT list_distinct(flatten(list(s))) FROM templates))),
  met AS (SELECT b, r, label, len(templates.s) AS k, len(list_intersect(held.s, templates.s)) / len(templates.s)::DOUBLE AS c FROM held, templates WHERE len(list_intersect(held.s, templates.s)) >= ceil({THRESHOLD} * len(templates.s) - 1e-9)),
  best AS (SELECT r, list(label) AS labels, max(c) AS c FROM (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY b ORDER BY c DESC, k DESC, label) = 1) GROUP BY r),
  named AS (SELECT doc_id, r, n, flatten([{", ".join(f"p{i}" for i in range(len(PHRASES)))}]) AS p, flatten([{", ".join(f"CASE WHEN len(p{i}) > 0 THEN ['{label}'] ELSE []::VARCHAR[] END" for i, (_, label) in enumerate(PHRASES))}]) AS b FROM places)
  SELECT doc_id, n AS n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word,
    coalesce(array_to_string(list_sort(b), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(b, coalesce(labels, []::VARCHAR[])))), ','), '') AS labels,
    CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
  FROM named LEFT JOIN best USING (r)"""
