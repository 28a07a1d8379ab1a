"""License scans: an exact containment join of text blocks with license templates.

A block is a sentence; it goes on over single line breaks, as license texts are usually hard-wrapped, and ends at a mark of [.!?] before white space or at a blank line. Tokens are
pairs of consecutive words (marks of comments are no words), so that words in another order are no match. A template's tokens are contained in a block to the degree
|T n B| / |T|; all blocks that reach the threshold match. Tokens are ordered by how many blocks of the whole corpus hold them, rarest first. A block with enough of a template
must hold one of the first |T| - need + 1 of its tokens (prefix filter), must itself have ``need`` tokens (length filter), and where
its first common token stands at place i of the template, need - 1 more must fit after it (positional filter, likewise for what remains of the block).
Only the tokens of templates need frequencies, so their table is as large as the templates', however large the corpus.

Besides, three fixed phrases are looked for as consecutive words of the whole text.

Null and empty texts have no words. Repeated rows get a row each. Very long texts, and blocks that are whole texts, cost time in proportion to their words; ties of containment are all given.
An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_texts, sliced
from quire.llm.decontaminate import words_of
from quire.session import bounded_batches


#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short statements and the telling sentences of common licenses, by label.
TEMPLATES: list[tuple[str, str]] = [
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("artistic-2.0", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed under the Artistic License 2.0"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "either version 3 of the License, or (at your option) any later version"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("warranty", "The software is provided as is, without warranty of any kind, express or implied"),
    ("warranty", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
]
THRESHOLD = 0.8
#: A block with the white space after it; the matches cover the text. RE2 reads it alike.
BLOCK = r"(?:[^.!?\n]+|[.!?]+[^.!? \t\n\r\f\v]|\n[ \t\r\f\v]*[^.!? \t\n\r\f\v]|\n[ \t\r\f\v]*[.!?]+[^.!? \t\n\r\f\v])*[.!?]*[ \t\n\r\f\v]*"

_block = re.compile(BLOCK.encode()).findall

Token = tuple[bytes, bytes]


def need_of(size: int, threshold: float) -> int:
    """Least overlap that reaches the threshold, counted in integers."""
    return max(1, -(-int(round(threshold * 1_000_000)) * size // 1_000_000))


def tokens_of(words: list[bytes]) -> set[Token]:
    return set(zip(words, words[1:]))


class Scanner:
    """Templates with their tokens in frequency order, indexed by their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[Token, int], threshold: float):
        self.templates = []
        self.index: dict[Token, list[tuple[int, int]]] = {}
        self.order = {x: (frequency.get(x, 0), x) for x in vocabulary(templates)}
        for label, text in templates:
            wanted = sorted(tokens_of(words_of(text.encode())), key=self.order.__getitem__)
            need = need_of(len(wanted), threshold)
            for place in range(len(wanted) - need + 1):
                self.index.setdefault(wanted[place], []).append((len(self.templates), place))
            self.templates.append((label, wanted, need))
        self.keys = frozenset(self.index)

    def block(self, words: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of the templates that a block holds."""
        if self.keys.isdisjoint(zip(words, words[1:])):
            return []
        have = tokens_of(words)
        common = sorted(self.order.keys() & have, key=self.order.__getitem__)
        rank = {x: i for i, x in enumerate(common)}
        seen, found = set(), []
        for token in common:
            for t, place in self.index.get(token, ()):
                if t in seen:
                    continue
                seen.add(t)
                label, wanted, need = self.templates[t]
                if len(have) < need or len(wanted) - place < need or len(common) - rank[token] < need:
                    continue
                overlap = sum(1 for x in wanted if x in have)
                if overlap >= need:
                    found.append((label, overlap / len(wanted)))
        return found


def vocabulary(templates: list[tuple[str, str]]) -> frozenset[Token]:
    held = [tokens_of(words_of(text.encode())) for _, text in templates]
    if not all(held):
        raise ValueError("a template needs two words")
    return frozenset().union(*held)


def blocks(utf8: bytes) -> list[list[bytes]]:
    return [words for piece in _block(utf8) if (words := words_of(piece))]


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word number, label) of all places of the fixed phrases."""
    out = []
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                out.append((at, label))
    return sorted(out)


def frequencies(df: DataFrame, templates: list[tuple[str, str]], text_col: str = "text") -> dict[Token, int]:
    """How many blocks of the corpus hold each token of the templates."""
    held = vocabulary(templates)
    bounded_batches(df.sparkSession)

    def run(batches):
        counts: Counter = Counter()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                for words in blocks((text or "").encode("utf-8")):
                    counts.update(held.intersection(zip(words, words[1:])))
        pairs = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)] + [pa.array([counts[p] for p in pairs], pa.int64())], names=["one", "two", "n"])

    rows = df.select(text_col).mapInArrow(run, "one binary, two binary, n long").groupBy("one", "two").agg(F.sum("n").alias("n"))
    return {(bytes(r["one"]), bytes(r["two"])): r["n"] for r in rows.collect()}  # at most the tokens of the templates


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches).

    score: the largest containment of a matching block, 0 without one. matches: array of (block number, its first word's number and its end, label, containment).
    """
    scanner = Scanner(templates, frequencies(df, templates, text_col), threshold)

    def each(utf8: bytes, _: str) -> tuple:
        all_words, score, labels, matches = [], 0.0, set(), []
        for k, words in enumerate(blocks(utf8)):
            first = len(all_words)
            all_words += words
            for label, share in scanner.block(words):
                labels.add(label)
                score = max(score, share)
                matches.append({"block": k, "first": first, "end": len(all_words), "label": label, "containment": share})
        places = phrase_places(all_words)
        base = {label for _, label in places}
        return len(all_words), len(places), places[0][0] if places else None, places[-1][0] if places else None, sorted(base), sorted(base | labels), score, matches

    match = pa.struct([("block", pa.int32()), ("first", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("containment", pa.float64())])
    fields = [
        ("n_words", "long", pa.int64()), ("n_base", "long", pa.int64()), ("first_word", "long", pa.int64()), ("last_word", "long", pa.int64()),
        ("base_labels", "array<string>", pa.list_(pa.string())), ("labels", "array<string>", pa.list_(pa.string())), ("score", "double", pa.float64()),
        ("matches", "array<struct<block:int,first:int,`end`:int,label:string,containment:double>>", pa.list_(match)),
    ]
    return map_texts(df, {id_col: F.col(id_col)}, F.col(text_col), each, fields)


def _oracle() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rows = ", ".join(f"({n}, '{label}', ['" + "', '".join(sorted(b" ".join(x).decode() for x in tokens_of(words_of(text.encode())))) + "'])" for n, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{label}', ['" + "', '".join(p.split()) + "'])" for p, label in PHRASES.items())
    return rf"""
WITH templates(t, label, wanted) AS (VALUES {rows}), phrases(label, parts) AS (VALUES {phrases}),
blocks AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{BLOCK}')) AS piece FROM documents
), sets AS (
  SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS have FROM (SELECT doc_id, regexp_extract_all({lower.format("piece")}, '{word}') AS w FROM blocks)
), shares AS (
  SELECT doc_id, label, len(list_intersect(wanted, have)) / CAST(len(wanted) AS DOUBLE) AS share FROM sets, templates
  WHERE len(have) > 0 AND len(list_intersect(wanted, have)) * 1000000 >= {int(round(THRESHOLD * 1_000_000))} * len(wanted)
), words AS (
  SELECT doc_id, regexp_extract_all({lower.format("coalesce(text, '')")}, '{word}') AS w FROM documents
), starts AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(parts)] = parts)) AS place FROM words, phrases WHERE len(list_intersect(w, parts)) = len(list_distinct(parts))
), base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM starts GROUP BY doc_id
), named AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM starts UNION ALL SELECT doc_id, label FROM shares) GROUP BY doc_id
), best AS (SELECT doc_id, max(share) AS score FROM shares GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""


ORACLE = _oracle()
