"""Licence scans by an index of where each licence word stands in each passage.

Passages of public licences are the templates.  The index lists, for every word
of theirs, the templates and places it has.  A first scan counts in how many
documents each of these words occurs.  A second looks up, for each file and each
template that enough of its words could cover, the template's rarest words that
the file has: every place of such a word in the file, less its place in the
template, votes for where the template would begin.  Beginnings on which at
least half of the rare words agree are candidates; there the whole template is
compared, and its mandatory phrases must stand within.

All of it is work within the row: no row meets another one, only the counts of
the words of the index are shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

# Phrases that name a licence, and passages of public licences with the phrases that must not lack.

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ["permission is hereby granted free of charge", "to deal in the software without restriction"],
    ),
    ("mit", "Released under the MIT License.", ["mit license"]),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ["apache license version 2 0", "you may not use this file except in compliance with the license"],
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ["apache license version 2 0"]),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE.",
        ["gnu general public license", "free software foundation"],
    ),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ["general public license version 2"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ["general public license version 3"]),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 "
        "of the License, or (at your option) any later version.",
        ["gnu lesser general public license", "free software foundation"],
    ),
    (
        "agpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
        ["gnu affero general public license", "free software foundation"],
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
        ["redistribution and use in source and binary forms", "must retain the above copyright notice"],
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies.",
        ["with or without fee is hereby granted", "this permission notice appear in all copies"],
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ["mozilla public license v 2 0"],
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
        "a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ["free and unencumbered software released into the public domain"],
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted "
        "to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
        ["permission is granted to anyone to use this software for any purpose"],
    ),
    ("cc-by-4.0", "Licensed under CC BY 4.0.", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ["cc by sa 4 0"]),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0.", ["cc by nd 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ["cc by nc 4 0"]),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0.", ["cc by nc sa 4 0"]),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0.", ["cc by nc nd 4 0"]),
]

RARE = 8  # words of a template that vote
SLACK = 4  # places by which words may be shifted, as by a name put in
COVER = 0.7  # share of a template's words that must stand at their places


def split(text: str) -> list[str]:
    """The words of a plain text."""
    raw = text.encode()
    return [bytes(p.low[s : s + n]).decode() for p in words.pieces(pa.array([text])) for s, n in zip(p.start, p.length)] if raw else []


@dataclass
class Index:
    """Words, and their places in templates; ``postings`` has rows (word, template, place) in order."""

    names: list[str]  # label of each template
    vocabulary: list[str]
    sizes: np.ndarray  # places of each template
    postings: np.ndarray
    phrases: list[list[list[int]]]  # of each template
    base: list[tuple[str, list[int]]]


def build(templates=None, base=None) -> Index:
    templates, base = TEMPLATES if templates is None else templates, BASE if base is None else base
    bodies = [split(text) for _, text, _ in templates]
    demands = [[split(p) for p in phrases] for *_, phrases in templates]
    named = [(label, split(p)) for p, label in base.items()]
    vocabulary = sorted({w for body in bodies for w in body} | {w for d in demands for p in d for w in p} | {w for _, p in named for w in p})
    long = [w for w in vocabulary if len(w.encode()) > words.KEY_BYTES]
    if long or len(vocabulary) > 32_000:
        raise ValueError(f"words of more than {words.KEY_BYTES} bytes: {long}" if long else "too many words")
    number = {w: i for i, w in enumerate(vocabulary)}
    rows = sorted((number[w], t, q) for t, body in enumerate(bodies) for q, w in enumerate(body))
    return Index(
        [label for label, *_ in templates], vocabulary, np.array([len(b) for b in bodies]), np.array(rows, dtype=np.int64).reshape(-1, 3),
        [[[number[w] for w in p] for p in d] for d in demands], [(label, [number[w] for w in p]) for label, p in named],
    )


class Finder:
    """Words of the index in pieces of text, by sixteen bytes of each."""

    def __init__(self, vocabulary: list[str]):
        low = np.concatenate([np.frombuffer(w.encode(), dtype=np.uint8) for w in vocabulary] + [np.zeros(words.ROOM, dtype=np.uint8)])
        length = np.array([len(w.encode()) for w in vocabulary])
        one, two = words.keys(low, np.cumsum(length) - length, length)
        self.order = np.lexsort((two, one))
        self.one, self.two = one[self.order], two[self.order]
        self.mixed = self._mix(self.one, self.two)
        by = np.argsort(self.mixed)
        self.order, self.one, self.two, self.mixed = self.order[by], self.one[by], self.two[by], self.mixed[by]
        if (self.mixed[1:] == self.mixed[:-1]).any():
            raise ValueError("two words of the index share a mixed key")

    @staticmethod
    def _mix(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        h = (one * np.uint64(0x9E3779B97F4A7C15)) ^ (two * np.uint64(0xC2B2AE3D27D4EB4F))
        return h ^ (h >> np.uint64(32))

    def find(self, piece: words.Piece) -> tuple[np.ndarray, np.ndarray]:
        """(word of the piece, word of the index) of each hit."""
        able = np.flatnonzero(piece.length <= words.KEY_BYTES)
        one, two = words.keys(piece.low, piece.start[able], piece.length[able])
        mixed = self._mix(one, two)
        at = np.minimum(np.searchsorted(self.mixed, mixed), len(self.mixed) - 1)
        hit = np.flatnonzero((self.one[at] == one) & (self.two[at] == two))
        return able[hit], self.order[at[hit]]


def _hits(texts: pa.Array, finder: Finder) -> tuple[np.ndarray, ...]:
    """(row, place, word) of all words of the index in a batch, in order, and the number of words of each row."""
    rows, places, found, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(texts), dtype=np.int64)
    for piece in words.pieces(texts):
        at, word = finder.find(piece)
        rows.append(piece.row[at].astype(np.int64))
        places.append(piece.place[at])
        found.append(word)
        n += np.bincount(piece.row, minlength=len(texts))
    return np.concatenate(rows), np.concatenate(places), np.concatenate(found), n


def document_counts(docs: DataFrame, index: Index, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each word of the index occurs, and the number of documents."""
    size = len(index.vocabulary)

    def run(batches):
        finder, held = Finder(index.vocabulary), np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            row, _, word, _ = _hits(batch.column(0), finder)
            held[:size] += np.bincount(np.unique(row * size + word) % size, minlength=size)
            held[size] += len(batch)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(held[there])], ["word", "n"])

    counted = docs.select(text).mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(size + 1, dtype=np.int64)
    for r in counted.collect():  # a row for each word of the index at most
        out[r.word] = r.n
    return out[:size], int(out[size])


def _expanded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, member) of all members of the ranges first[i] to last[i] - 1."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]


def _runs(row, place, word, phrase: list[int]) -> np.ndarray:
    """Which hits begin the phrase."""
    m = len(word) - len(phrase) + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    good = np.ones(m, dtype=bool)
    for i, w in enumerate(phrase):
        good &= (word[i : i + m] == w) & (row[i : i + m] == row[:m]) & (place[i : i + m] == place[:m] + i)
    return np.flatnonzero(good)


class Matcher:
    """Templates in a batch of texts."""

    def __init__(self, index: Index, idf: np.ndarray):
        self.index, self.idf = index, idf
        self.v, self.t = len(index.vocabulary), len(index.names)
        p = index.postings
        # (word, template) pairs of the index in order of words, with how often the word stands in the template
        pair, self.pair_first, self.pair_n = np.unique(p[:, 0] * max(1, self.t) + p[:, 1], return_index=True, return_counts=True)
        self.pair_word, self.pair_template = pair // max(1, self.t), pair % max(1, self.t)
        self.word_first = np.searchsorted(self.pair_word, np.arange(self.v + 1))
        self.bodies = [np.zeros(n, dtype=np.int64) for n in index.sizes]
        for w, t, q in p:
            self.bodies[t][q] = w

    def match(self, row, place, word) -> list[tuple[int, int, int, float]]:
        """(row, template, where it begins, cover) of the best alignment of each template that a row has."""
        if not len(row) or not self.t:
            return []
        span = int(place.max()) + int(self.index.sizes.max()) + 4 * SLACK + 2
        code, there = np.unique(row * self.v + word, return_counts=False), row * span + place
        # templates of which a row has words for enough places
        at, pair = _expanded(self.word_first[code % self.v], self.word_first[code % self.v + 1])
        group = (code[at] // self.v) * self.t + self.pair_template[pair]
        groups, of = np.unique(group, return_inverse=True)
        covered = np.bincount(of, self.pair_n[pair], len(groups))
        keep = covered[of] >= COVER * self.index.sizes[group % self.t] - 1e-9
        at, pair, group = at[keep], pair[keep], group[keep]
        if not len(at):
            return []
        # the rarest words of each
        order = np.lexsort((self.pair_word[pair], -self.idf[self.pair_word[pair]], group))
        at, pair, group = at[order], pair[order], group[order]
        groups, first, n = np.unique(group, return_index=True, return_counts=True)
        rank = np.arange(len(group)) - np.repeat(first, n)
        rare = rank < RARE
        at, pair, group, rank = at[rare], pair[rare], group[rare], rank[rare]
        wanted = np.minimum(n, RARE)
        number = np.searchsorted(groups, group)
        # votes: places in the file less places in the template
        hit_code = row * self.v + word
        by_code = np.argsort(hit_code, kind="stable")
        lo, hi = np.searchsorted(hit_code[by_code], code[at]), np.searchsorted(hit_code[by_code], code[at], side="right")
        w1, hit = _expanded(lo, hi)
        w2, posting = _expanded(self.pair_first[pair[w1]], self.pair_first[pair[w1]] + self.pair_n[pair[w1]])
        which = w1[w2]
        begin = place[by_code[hit]][w2] - self.index.postings[posting, 2]
        width = span + int(self.index.sizes.max()) + 2 * SLACK
        shift = int(self.index.sizes.max()) + SLACK
        votes = np.unique((number[which] * RARE + rank[which]) * width + begin + shift)
        candidates = np.unique(number[which] * width + begin + shift)
        g, o = candidates // width, candidates % width
        agreed = np.zeros(len(candidates), dtype=np.int64)
        for r in range(RARE):
            base = (g * RARE + r) * width + o
            i = np.searchsorted(votes, base - SLACK)
            agreed += (i < len(votes)) & (votes[np.minimum(i, len(votes) - 1)] <= base + SLACK)
        good = 2 * agreed >= wanted[g]
        g, o = g[good], o[good] - shift
        # the whole template at each candidate
        best: dict[tuple[int, int], tuple[float, int]] = {}
        starts = [[there[_runs(row, place, word, p)] for p in phrases] for phrases in self.index.phrases]
        for t in np.unique(groups[g] % self.t) if len(g) else ():
            mine = np.flatnonzero(groups[g] % self.t == t)
            body = self.bodies[t]
            for part in np.array_split(mine, 1 + len(mine) * len(body) // 200_000):
                r, begin = groups[g[part]] // self.t, o[part]
                ok = np.ones(len(part), dtype=bool)
                for phrase, known in zip(self.index.phrases[t], starts[t]):
                    low = r * span + np.maximum(begin - SLACK, 0)
                    high = r * span + np.maximum(begin + len(body) + SLACK - len(phrase), -1)
                    ok &= np.searchsorted(known, low) < np.searchsorted(known, high, side="right")
                r, begin = r[ok], begin[ok]
                found = np.zeros((len(r), len(body)), dtype=bool)
                for d in range(-SLACK, SLACK + 1):
                    spot = begin[:, None] + np.arange(len(body)) + d
                    wanted_at = r[:, None] * span + spot
                    i = np.minimum(np.searchsorted(there, wanted_at), len(there) - 1)
                    found |= (there[i] == wanted_at) & (spot >= 0) & (word[i] == body)
                for a, b, c in zip(r.tolist(), begin.tolist(), found.mean(axis=1).tolist()):
                    if c >= COVER and (c, -b) > best.get((a, int(t)), (0.0, 0)):
                        best[a, int(t)] = (c, -b)
        return [(a, t, -b, c) for (a, t), (c, b) in sorted(best.items())]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=None, base=None) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) of every row.

    ``matches`` has (label, first_word, cover) of each template found, where it
    covers most; ``score`` is the greatest cover, and 1 where a base phrase
    stands, as it stands whole.  Null and empty texts, and texts without words,
    have no words, empty labels and score 0.  Rows that repeat an id or a text
    are rows of their own.  An empty table gives an empty one.
    """
    index = build(templates, base)
    counts, n_docs = document_counts(docs, index, text)
    idf = np.array([math.log((n_docs + 1) / (c + 1)) for c in counts.tolist()])

    def run(batches):
        finder, matcher = Finder(index.vocabulary), Matcher(index, idf)
        for batch in batches:
            row, place, word, n_words = _hits(batch.column(1), finder)
            size = len(batch)
            n_base, first, last = np.zeros(size, dtype=np.int64), np.full(size, np.iinfo(np.int64).max), np.full(size, -1)
            named: dict[int, set[str]] = {}
            for label, phrase in index.base:
                at = _runs(row, place, word, phrase)
                n_base += np.bincount(row[at], minlength=size)
                np.minimum.at(first, row[at], place[at])
                np.maximum.at(last, row[at], place[at])
                for r in np.unique(row[at]).tolist():
                    named.setdefault(r, set()).add(label)
            found: dict[int, list] = {}
            for r, t, begin, cover in matcher.match(row, place, word):
                found.setdefault(r, []).append({"label": index.names[t], "first_word": begin, "cover": cover})
            base_labels = [",".join(sorted(named.get(r, ()))) for r in range(size)]
            labels = [",".join(sorted(named.get(r, set()) | {m["label"] for m in found.get(r, ())})) for r in range(size)]
            score = [1.0 if r in named else max((m["cover"] for m in found.get(r, ())), default=0.0) for r in range(size)]
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(base_labels), pa.array(labels), pa.array(score),
                    pa.array([found.get(r, []) for r in range(size)], pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("cover", pa.float64())]))),
                ],
                [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return docs.select(key, text).mapInArrow(run, f"{schema}, matches array<struct<label:string,first_word:bigint,cover:double>>")
