"""License scans: a positional index of rare licence words, verified by mandatory key phrases.

Words are the runs of digits, letters and non-ASCII characters of the text with A-Z lower-cased. The vocabulary is
that of the licence templates (some hundred words). ``licence_word_frequencies`` counts in how many documents each
of them occurs, over all texts; each task adds up its own counts first, so a row per word and task is shuffled.
``build_index`` keeps the ``RAREST`` words of the highest IDF of each template, with their positions. As ``LEAST_WORDS`` of
them must be met, one is among the first ``RAREST - LEAST_WORDS + 1``, the leading ones. ``scan_licenses`` looks up each
text's leading words, the highest IDF first: a posting (template, position) votes for the place where the template would
start. For the templates met, the other words' postings are intersected with these by relative position: places within
``SLACK`` words of each other count together, so that words put in or left out do no harm. Only where enough words meet, the
template's key phrase must stand, and the share of the template's words that follow each other in the same order there (the
longest common subsequence) must be ``LEAST_SHARE`` or more. A text's score is the largest such share; a base phrase alone
scores a half.

Null and empty texts have no words, no places and score 0. Repeated rows are scanned alike. An empty table gives no
rows. Texts of any length are scanned whole. Equal IDFs are ordered by the word. Other columns pass through, one named as
a computed column is replaced.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memjobs.llm.common import alnum_words, extended, raw_texts, sliced, table

#: Phrases of the contract and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Texts of public licences and licence notices: label, text, mandatory key phrase.
TEMPLATES = (
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.', "to deal in the software without restriction"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', "permission is hereby granted free of charge"),
    ("mit", "Released under the MIT License.", "mit license"),
    ("mit", "This project is licensed under the MIT License - see the LICENSE file for details", "licensed under the mit license"),
    ("mit", "SPDX-License-Identifier: MIT", "spdx license identifier mit"),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "apache license version 2 0"),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License', "apache license version 2 0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0", "spdx license identifier apache 2 0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "gnu general public license"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public license"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser general public license"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "gnu affero general public license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistribution and use in source and binary forms"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "permission to use copy modify and or distribute this software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mozilla public license"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "and to alter it and redistribute it freely"),
    ("boost", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "boost software license"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "dedicated all copyright and related and neighboring rights"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited", "unauthorized copying of this file"),
)
#: How many words of a template are indexed, how many of them must be met, how far places may lie apart, the least share.
RAREST, LEAST_WORDS, SLACK, LEAST_SHARE = 8, 3, 8, 0.6


def _words(text: str) -> list[bytes]:
    return alnum_words(text.encode())


@dataclass
class LicenseIndex:
    """``leading``: of each leading word, its (template, position) pairs; ``others``: (word, position) of each template's other
    indexed words; ``idf``: of every licence word."""

    idf: dict[bytes, float]
    leading: dict[bytes, list[tuple[int, int]]]
    others: list[list[tuple[bytes, int]]]
    templates: list[tuple[str, list[bytes], list[bytes]]]
    bases: list[tuple[list[bytes], str]] = field(default_factory=list)

    @property
    def vocabulary(self) -> frozenset[bytes]:
        return frozenset(self.idf)


def build_index(frequency: dict[bytes, int], n_docs: int, templates=TEMPLATES) -> LicenseIndex:
    """Of each template, the positions of the ``RAREST`` words of the highest IDF, however common the licence is."""
    parsed = [(label, _words(text), _words(phrase)) for label, text, phrase in templates]
    words = {w for _, ws, phrase in parsed for w in (*ws, *phrase)} | {w for p in BASE_PHRASES for w in _words(p)}
    idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 0.5)) for w in words}
    leading: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    others: list[list[tuple[bytes, int]]] = []
    for t, (_, ws, _) in enumerate(parsed):
        rarest = sorted(set(ws), key=lambda w: (-idf[w], w))[:RAREST]
        lead = set(rarest[: len(rarest) - min(LEAST_WORDS, len(rarest)) + 1])
        for p, w in enumerate(ws):
            if w in lead:
                leading[w].append((t, p))
        others.append([(w, p) for p, w in enumerate(ws) if w in rarest and w not in lead])
    return LicenseIndex(idf, dict(leading), others, parsed, [(_words(p), label) for p, label in BASE_PHRASES.items()])


def licence_word_frequencies(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word occurs, and the number of documents. A few hundred rows reach the driver."""
    vocabulary = frozenset(build_index({}, 1, templates=templates).idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)
        for batch in sliced(batches):
            counts[b""] += batch.num_rows
            for raw in raw_texts(batch, text_col):
                for w in vocabulary.intersection(alnum_words(raw)):
                    counts[w] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r[0].encode(): int(r[1]) for r in rows}
    return found, found.pop(b"", 0)


def held_share(template: list[bytes], words: list[bytes]) -> float:
    """The share of the template's words in its longest common subsequence with ``words``, one bit for each word."""
    masks: dict[bytes, int] = defaultdict(int)
    for k, w in enumerate(template):
        masks[w] |= 1 << k
    every = rest = (1 << len(template)) - 1
    for w in words:
        if w in masks:
            met = rest & masks[w]
            rest = (rest + met | rest - met) & every
    return 1 - rest.bit_count() / len(template)


def meetings(votes: list[tuple[int, bytes]], needed: int) -> list[tuple[int, int]]:
    """Of sorted (place, word) votes, the ranges of places in which ``needed`` different words lie within twice ``SLACK``."""
    out: list[tuple[int, int]] = []
    held: dict[bytes, int] = defaultdict(int)
    first = kinds = 0
    for place, word in votes:
        kinds += held[word] == 0
        held[word] += 1
        while place - votes[first][0] > 2 * SLACK:
            gone = votes[first][1]
            held[gone] -= 1
            kinds -= held[gone] == 0
            first += 1
        if kinds >= needed:
            low = votes[first][0]
            if out and low <= out[-1][1]:
                out[-1] = out[-1][0], place
            else:
                out.append((low, place))
    return out


def scan(words: list[bytes], index: LicenseIndex) -> tuple[list[int], set[str], set[str], float]:
    """Starts of base phrases, base labels, labels of the method, score."""
    vocabulary = index.idf
    places: dict[bytes, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        if w in vocabulary:
            places[w].append(i)
    starts, base, labels, score = [], set(), set(), 0.0
    if not places:
        return starts, base, labels, score

    def found(phrase: list[bytes]) -> list[int]:
        pivot = min(range(len(phrase)), key=lambda k: len(places.get(phrase[k], ())))
        return [p - pivot for p in places.get(phrase[pivot], ()) if p >= pivot and words[p - pivot : p - pivot + len(phrase)] == phrase]

    for phrase, label in index.bases:
        if at := found(phrase):
            starts += at
            base.add(label)
    votes: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
    for w in sorted(places.keys() & index.leading.keys(), key=lambda w: (-vocabulary[w], w)):
        for t, p in index.leading[w]:
            votes[t] += [(i - p, w) for i in places[w]]
    for t, cast in votes.items():
        label, ws, phrase = index.templates[t]
        needed = min(LEAST_WORDS, len(set(ws)))
        cast += [(i - p, w) for w, p in index.others[t] if w in places for i in places[w]]
        cast.sort()
        met = meetings(cast, needed)
        if not met:
            continue
        offset = next(k for k in range(len(ws)) if ws[k : k + len(phrase)] == phrase)
        begins, lows = [at for at, _ in cast], [low for low, _ in met]
        for key in found(phrase):
            at = key - offset
            at_range = bisect_right(lows, at + SLACK) - 1
            if at_range < 0 or met[at_range][1] < at - SLACK:
                continue
            near = cast[bisect_left(begins, at - SLACK) : bisect_right(begins, at + SLACK)]
            if len({w for _, w in near}) >= needed:
                share = held_share(ws, words[max(0, at - SLACK) : at + len(ws) + SLACK])
                if share >= LEAST_SHARE:
                    labels.add(label)
                    score = max(score, share)
    if base:
        score = max(score, 0.5)
    return starts, base, labels, round(score, 6)


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
]


def scan_licenses(docs: DataFrame, index: LicenseIndex, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    def compute(batch: pa.RecordBatch):
        rows = []
        for raw in raw_texts(batch, text_col):
            words = alnum_words(raw)
            starts, base, labels, score = scan(words, index)
            rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None),
                         ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
        columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
        for values, kind in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()], strict=True):
            yield pa.array(values, kind)

    return extended(docs, compute, FIELDS, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = build_index(*licence_word_frequencies(docs))
    return scan_licenses(docs, index, keep=["doc_id"]).select("doc_id", *(f.name for f in FIELDS))
