"""Licence scanning with a trained paragraph classifier.

A paragraph is a block of lines that are not blank (a line without a letter or digit is).
Notices are sought in each of its lines and in each window of consecutive lines of it, as
notices are often wrapped. What is looked at is described by the word uni- and bigrams that
it has of the training vocabulary. Multinomial logistic regression over these sparse features gives
each licence family, and the class of text without a licence, a probability; one
temperature, fitted on held-out examples, calibrates them. Where no family is probable
enough, or where the family's templates share too few n-grams with the text, a line that is
unlikely to be ordinary text counts as 'unknown' (or neighbouring lines that are so only together,
each of them doubtful by itself).

Every line is judged by the classifier, many at a time. A window needs a family, so windows are
tried in paragraphs that hold enough n-grams of some template together (a window has no more than its
paragraph), and each of a window's outer lines must add a word pair to what it has of the family's template. Between windows and lines that overlap, the one that has most pairs
of its template is taken, then the shorter, then the earlier one. The inner lines of a
window have at most INNER words, twice the longest template.

The model is trained here, in a few seconds in the driver, on variations of the notices
below and on generated text that is none of them. Documents are scanned where they lie,
whole, without a shuffle.

Results for unusual input: null and empty texts have no paragraphs; blank lines part
paragraphs; rows that are there twice give two rows; an empty table gives an empty
result; other columns are ignored; ties between families go to the one listed first.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

# Short notices by which texts declare a licence, by family.
TEMPLATES = {
    "mit": [
        "MIT License",
        "The MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The Software is provided 'as is', without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "apache": [
        "Apache License, Version 2.0, January 2004",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an 'AS IS' basis, without warranties or conditions of any kind, either express or implied.",
        "See the License for the specific language governing permissions and limitations.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl": [
        "GNU General Public License, Version 3, 29 June 2007",
        "GNU General Public License, Version 2, June 1991",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "GNU Lesser General Public License",
        "See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "GNU Affero General Public License",
        "See the GNU Affero General Public License for more details.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "BSD 3-Clause License",
        "BSD 2-Clause License",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors 'as is' and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "mpl": [
        "Mozilla Public License, Version 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "ISC License",
        "The Software is provided 'as is' and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "SPDX-License-Identifier: ISC",
    ],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "boost": ["Boost Software License - Version 1.0", "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "artistic": ["The Artistic License 2.0", "Licensed under the Artistic License, version 2.0.", "SPDX-License-Identifier: Artistic-2.0"],
    "zlib": [
        "Licensed under the zlib License.",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
}
# Ordinary sentences with words that notices also have.
ORDINARY = [
    "The license of the driver was valid until the end of the year.",
    "He studied at MIT and works on software now.",
    "The Apache helicopter landed near the public road.",
    "A general election is a public event under the law.",
    "Permission to enter was granted to the person at the door.",
    "This version of the file is free for the public.",
    "They released the creative work in common use.",
    "The source of the river is subject to the terms of the treaty.",
    "Use this form to obtain a copy of the document.",
    "Version 2.0 of the program is out.",
    "The software of the driver is provided without a warranty to the authors of the work.",
    "In the event of damages the author of the work is to be held at the door.",
    "All rights reserved.",
    "The following conditions of use are available to any person with a copy.",
    "These materials are made of the source of the common law of nature.",
    "The free person may modify the form, and the use of the files is permitted.",
    "An artistic boost to the public domain of the foundation was made available.",
    "The committee granted a license to the museum, subject to conditions on the use of its name.",
    "Persons to whom the building is furnished may copy the documents without limitation.",
    "The holders of the contract are liable for damages arising from the event.",
    "A particular purpose of the distribution is to be seen in the library for more details.",
    "The general received a copy of the list with the names of all contributors.",
]
NONE = "none"
FAMILIES = [NONE, *TEMPLATES]
#: Least calibrated probability of a family, and least share of a template's n-grams in the paragraph.
LEAST_PROBABILITY, LEAST_OVERLAP = 0.6, 0.6
#: A line with this probability of being ordinary text is no part of an unknown notice of several lines.
ORDINARY_ENOUGH = 0.9

_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


def words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


#: Most words of the inner lines of a window.
INNER = 2 * max(len(words(t.encode())) for v in TEMPLATES.values() for t in v)


class Model:
    """Sparse weights by n-gram: numbers of words, and of pairs of their numbers."""

    def __init__(self, number: dict[bytes, int], column: dict[int, int], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.number, self.column, self.weights, self.bias, self.temperature = number, column, weights, bias, temperature
        self.templates = {k: [self.grams(words(t.encode())) for t in v] for k, v in TEMPLATES.items()}
        # The columns of templates' word pairs; those of single words come first.
        self.pairs = {c for v in self.templates.values() for t in v for c in t if c >= len(number)}
        # The column of each pair of word numbers, or -1.
        base = len(number) + 1
        self.table = np.full(base * base, -1, np.int32)
        for pair, c in column.items():
            if c >= len(number):
                self.table[pair] = c
        self.in_pairs = np.zeros(len(column), bool)
        self.in_pairs[sorted(self.pairs)] = True
        every = [t for v in self.templates.values() for t in v]
        self.members = np.zeros((len(column), len(every)), np.float32)
        for k, t in enumerate(every):
            self.members[sorted(t), k] = 1
        self.enough = np.array([LEAST_OVERLAP * len(t) for t in every])

    def grams(self, text: list[bytes]) -> set[int]:
        """Columns of the n-grams of a paragraph that the vocabulary has."""
        get, column, base = self.number.get, self.column, len(self.number) + 1
        ids = [get(w, 0) for w in text]
        found = {column[i] for i in ids if i}
        for a, b in zip(ids, ids[1:], strict=False):
            if a and b and (c := column.get(a * base + b)) is not None:
                found.add(c)
        return found

    def judge(self, text: list[bytes]) -> tuple[str, float, float] | None:
        """(family or 'unknown', probability, overlap with the nearest template); None for ordinary text."""
        return self._judge(self.grams(text))

    def look_at(self, blocks: list[list[list[bytes]]]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """For each block of lines: the probability of ordinary text and the best class of every line, and whether the block
        holds enough of some template for a window."""
        lengths = [len(block) for block in blocks]
        sizes = np.array([len(t) for block in blocks for t in block], np.int64)
        get = self.number.get
        ids = np.array([get(w, 0) for block in blocks for t in block for w in t], np.int64)
        line = np.repeat(np.arange(len(sizes)), sizes)
        block_of = np.repeat(np.arange(len(blocks)), lengths)
        known = np.flatnonzero(ids)
        pair = np.where((ids[:-1] > 0) & (ids[1:] > 0), self.table[ids[:-1] * (len(self.number) + 1) + ids[1:]], -1)
        inner = line[:-1] == line[1:]
        across = np.flatnonzero((pair >= 0) & ~inner & (block_of[line[:-1]] == block_of[line[1:]]))
        within = np.flatnonzero((pair >= 0) & inner)
        width = len(self.column)
        codes = np.unique(np.concatenate([line[known] * width + ids[known] - 1, line[within] * width + pair[within]]))
        rows, columns = codes // width, codes % width
        logits = np.zeros((len(sizes), self.weights.shape[1]))
        if len(rows):
            starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            logits[rows[starts]] = np.add.reduceat(self.weights[columns], starts, axis=0)
        p = _softmax((logits + self.bias) / self.temperature)
        both = np.concatenate([block_of[rows] * width + columns, block_of[line[across]] * width + pair[across]])
        both = np.unique(both)
        have = np.zeros((len(blocks), len(self.enough)), np.float32)
        if len(both):
            at = both // width
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            have[at[starts]] = np.add.reduceat(self.members[both % width], starts, axis=0)
        windows = (have >= self.enough).any(axis=1)
        cut = np.cumsum([0, *lengths])
        best = p.argmax(axis=1)
        return [(p[a:b, 0], best[a:b], bool(w)) for a, b, w in zip(cut, cut[1:], windows, strict=False)]

    def _judge(self, found: set[int]) -> tuple[str, float, float] | None:
        p = _softmax((self.weights[sorted(found)].sum(axis=0) + self.bias)[None] / self.temperature)[0]
        best = int(np.argmax(p))
        if best == 0:
            return None
        family = FAMILIES[best]
        overlap = max(len(t & found) / max(1, len(t)) for t in self.templates[family])
        if p[best] >= LEAST_PROBABILITY and overlap >= LEAST_OVERLAP:
            return family, float(p[best]), overlap
        return ("unknown", float(1 - p[0]), overlap) if p[0] < 0.5 else None

    def _matched(self, family: str, found: set[int]) -> tuple[set[int], set[int]]:
        """The word pairs of that template of the family that is there and has most of them, and those that are found."""
        there = [t & self.pairs for t in self.templates[family] if len(t & found) >= LEAST_OVERLAP * len(t)]
        pairs = max(there, key=lambda t: len(t & found))
        return pairs, pairs & found

    def notices(self, lines: list[list[bytes]], seen: tuple[np.ndarray, np.ndarray, bool] | None = None) -> list[tuple[int, int, str, float, float]]:
        """(first line, last line, family or 'unknown', probability, overlap) in a paragraph, in order. seen: of look_at."""
        ordinary, best, windows = seen or self.look_at([lines])[0]
        doubtful = (ordinary < ORDINARY_ENOUGH).tolist()
        if not windows and not best.any() and not any(a and b for a, b in zip(doubtful, doubtful[1:], strict=False)):
            return []
        grams: dict[int, set[int]] = {}
        links: dict[int, set[int]] = {}

        def of(i: int) -> set[int]:
            if i not in grams:
                grams[i] = self.grams(lines[i])
            return grams[i]

        def link(i: int) -> set[int]:
            """The pair across the end of line i."""
            if i not in links:
                links[i] = self.grams([lines[i][-1], lines[i + 1][0]]) & self.pairs
            return links[i]

        def union(i: int, j: int) -> set[int]:
            return set().union(*map(of, range(i, j + 1)), *map(link, range(i, j)))

        single = [self._judge(of(i)) if c else None for i, c in enumerate(best.tolist())]
        sure = [(-len(self._matched(hit[0], of(i))[1]), 0, i, i, hit) for i, hit in enumerate(single) if hit and hit[0] != "unknown"]
        n = len(lines)
        for i in range(n - 1 if windows else 0):
            if not (link(i) or not self.pairs.isdisjoint(of(i))):
                continue
            found, inner = set(of(i)), 0
            for j in range(i + 1, n):
                found |= of(j) | link(j - 1)
                if (link(j - 1) or not self.pairs.isdisjoint(of(j))) and any(len(t & found) >= LEAST_OVERLAP * len(t) for v in self.templates.values() for t in v):
                    hit = self._judge(found)
                    if hit and hit[0] != "unknown":
                        pairs, have = self._matched(hit[0], found)
                        if all(len(pairs & part) < len(have) for part in (union(i + 1, j), union(i, j - 1))):
                            sure.append((-len(have), j - i, i, j, hit))
                inner += len(lines[j])
                if inner > INNER:
                    break
        out, free = [], [True] * n
        for *_, i, j, hit in sorted(sure, key=lambda x: x[:4]):
            if all(free[i : j + 1]):
                free[i : j + 1] = [False] * (j + 1 - i)
                out.append((i, j, *hit))
        out += [(i, i, *hit) for i, hit in enumerate(single) if free[i] and hit and hit[0] == "unknown"]
        # Lines that are unknown only together: runs of free ones that are doubtful each.
        i = 0
        while i < n:
            j = i
            while j < n and free[j] and doubtful[j] and single[j] is None and sum(map(len, lines[i:j])) <= INNER:
                j += 1
            if j - i > 1 and (hit := self._judge(union(i, j - 1))) and hit[0] == "unknown":
                out.append((i, j - 1, *hit))
            i = max(j, i + 1)
        return sorted(out)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def examples(n: int, seed: int) -> list[tuple[list[bytes], int]]:
    """Varied notices, and generated or ordinary text that is none."""
    r = random.Random(seed)
    syllables = "the er ing tion on re de la en es ver ung lich que ment in an to st".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3))).encode()
    vocabulary = sorted({w for v in TEMPLATES.values() for t in v for w in words(t.encode())} | {w for t in ORDINARY for w in words(t.encode())})
    out = []
    for i in range(n):
        if i % 2:
            label = r.randrange(1, len(FAMILIES))
            text = words(r.choice(TEMPLATES[FAMILIES[label]]).encode())
            drop = 0.08 if len(text) > 8 else 0.0
            text = [w for w in text if r.random() >= drop]
            if r.random() < 0.5:
                text = [word() for _ in range(r.randint(0, 12))] + text + [word() for _ in range(r.randint(0, 12))]
        else:
            label, kind = 0, r.random()
            if kind < 0.4:
                text = [word() for _ in range(r.randint(1, 40))]
            elif kind < 0.8:
                text = words(r.choice(ORDINARY).encode())
                if r.random() < 0.5:
                    r.shuffle(text)
            else:
                text = [r.choice(vocabulary) for _ in range(r.randint(1, 12))]
        out.append((text, label))
    return out


@lru_cache(1)
def train(n: int = 1600, rounds: int = 120, seed: int = 5) -> Model:
    """Full-batch gradient steps with momentum; the temperature is then chosen on as many new examples again."""
    data = examples(n, seed)
    seen = sorted({w for t in [*(x for v in TEMPLATES.values() for x in v), *ORDINARY] for w in words(t.encode())})
    number = {w: i + 1 for i, w in enumerate(seen)}
    base = len(number) + 1
    column: dict[int, int] = {i: k for k, i in enumerate(number.values())}
    for t in [*(x for v in TEMPLATES.values() for x in v), *ORDINARY]:
        ids = [number[w] for w in words(t.encode())]
        for a, b in zip(ids, ids[1:], strict=False):
            column.setdefault(a * base + b, len(column))
    model = Model(number, column, np.zeros((len(column), len(FAMILIES))), np.zeros(len(FAMILIES)), 1.0)

    def matrix(rows):
        x = np.zeros((len(rows), len(column)), np.float32)
        for i, (text, _) in enumerate(rows):
            x[i, sorted(model.grams(text))] = 1
        return x, np.array([label for _, label in rows])

    x, y = matrix(data)
    gold = np.eye(len(FAMILIES), dtype=np.float32)[y]
    w, b = np.zeros((len(column), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = (_softmax(x @ w + b) - gold) / len(x)
        vw, vb = 0.9 * vw + x.T @ g + 1e-4 * w, 0.9 * vb + g.sum(axis=0)
        w, b = w - 1.5 * vw, b - 1.5 * vb
    held, gold_held = matrix(examples(n, seed + 1))
    logits = held @ w + b
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(held)), gold_held] + 1e-12).mean()
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss)
    return Model(number, column, w.astype(np.float64), b.astype(np.float64), temperature)


def paragraphs(data: bytes):
    """The lines of each block of lines that are not blank: (start, end, words), in bytes."""
    at, block = 0, []
    for line in data.split(b"\n"):
        if text := words(line):
            block.append((at, at + len(line), text))
        elif block:
            yield block
            block = []
        at += len(line) + 1
    if block:
        yield block


SPANS = "array<struct<family:string,start:bigint,end:bigint,probability:double,overlap:double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """One row per row of docs: id_col, carried columns, n_paragraphs, notices (bytes of UTF-8, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train())  # a fixed size, below 1 MB

    def rows(texts):
        model = shared.value
        for i, data in enumerate(texts):
            blocks, found = list(paragraphs(data or b"")), []
            lines = [[text for _, _, text in block] for block in blocks]
            for block, own, seen in zip(blocks, lines, model.look_at(lines) if lines else (), strict=True):
                for first, last, family, p, overlap in model.notices(own, seen):
                    found.append({"family": family, "start": block[first][0], "end": block[last][1], "probability": p, "overlap": overlap})
            yield i, len(blocks), found

    return map_texts(docs, id_col, text_col, [("n_paragraphs", "bigint"), ("notices", SPANS)], rows, carry)
