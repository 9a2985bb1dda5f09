"""License scan: a trained paragraph classifier with an unknown class.

A multinomial logistic regression over sparse word n-grams (one to three words)
tells licence families from other text.  It is trained here from the templates
below: positives are templates with words dropped and foreign words around them.
Negatives (the unknown class) are notices of licences that are no family here,
templates whose telling words are replaced by others, sentences about licences
that grant nothing, shuffled templates and mixtures of their common words.  A
temperature fitted on notices written apart from the templates, of families and
of none, calibrates the probabilities; a paragraph is unknown unless a family
reaches ``least`` probability.  A prediction is confirmed if the paragraph covers
most word pairs of one of the family's templates, the licence's name where the
template has it, and at least half of its words that no other family's templates
have.

Scoring reads each text once, without a shuffle.  Only paragraphs with a licence
word (a word that is in templates and is no function word) can have a feature;
all others are unknown by the model's own bias, so they are passed over.

Cases: null and empty texts have no paragraphs.  A paragraph is a line; long
lines are read sentence by sentence, and so are others that confirm nothing whole.  Wrapped notices are paragraphs too: lines
without a blank one between them are joined, comment marks stripped, and read by
sentences, by pairs of sentences that confirm nothing, and, if short and nothing
else confirms, whole.  A line inside a sentence that is nearer to another family
is not confirmed.  Repeated rows get equal results.  An empty table gives an
empty result.  Texts are read whole; a carried column may have any name, and one
called ``families`` or ``found`` gives way to the operator's own.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

#: Notices of each family, in the usual words.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "Released under CC0 1.0 Universal, public domain dedication."],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "Licensed under the Eclipse Public License, Version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
}
#: Sentences about licences that grant nothing.
NOTHING = [
    "The driver must carry a valid license at all times.",
    "Her fishing license was issued by the county.",
    "Please read the license before you install the software.",
    "The source of the river lies in the general area of the public park.",
    "The conditions of the permission were not met and the work stopped.",
    "A copy of the documentation can be obtained free of charge from the library.",
    "The university of MIT published a paper on software and its use.",
    "The Apache people live in the south.",
    "Version 2.0 of the program was released.",
    "All files were published under the old version of the form.",
]
#: Notices of licences that are no family here.
OTHERS = [
    "Proprietary software. All rights reserved. No part may be copied without written permission.",
    "Licensed under the Common Development and Distribution License, Version 1.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This work is released under the Artistic License 2.0.",
    "Licensed under the Microsoft Public License.",
    "Use of this software is governed by the Business Source License.",
    "This product is licensed, not sold, under the end user license agreement.",
    "Licensed under the Academic Free License version 3.0.",
]
#: Notices apart from those above, on which the temperature is fitted and the accuracy is measured.
HELD_OUT = {
    "Apache-2.0": ["The code is available under the terms of the Apache License 2.0.", "This project uses the Apache License, Version 2.0, see the file LICENSE."],
    "AGPL": ["You may use it under the GNU Affero General Public License, version 3 or later."],
    "BSD": ["This library is distributed under the 3-clause BSD License.", "Redistribution and use in source and binary forms are permitted provided that this notice is kept and the following conditions are met."],
    "CC-BY": ["The text is available under the Creative Commons Attribution 4.0 License."],
    "CC-BY-NC": ["All photos are licensed under a Creative Commons Attribution-NonCommercial License."],
    "CC-BY-SA": ["The article text is under the Creative Commons Attribution-ShareAlike License."],
    "CC0": ["The data set is dedicated to the public domain under CC0 1.0 Universal."],
    "EPL-2.0": ["Available under the terms of the Eclipse Public License v 2.0."],
    "GPL": ["The program is distributed under the GNU General Public License, version 2.", "It is free software, released under the GNU General Public License."],
    "LGPL": ["The library may be used under the GNU Lesser General Public License 2.1."],
    "MIT": ["The code is distributed under the MIT License.", "Permission is granted, free of charge, to any person obtaining a copy of this software, to deal in the software without restriction."],
    "MPL-2.0": ["This file is covered by the Mozilla Public License, Version 2.0."],
    "": [
        "Proprietary Foo License, Version 2.0.",
        "Licensed under the European Union Public Licence, Version 1.2.",
        "Released under the Open Software License, version 3.",
        "This document is the property of the company and must not be distributed.",
        "The public library has a general collection of free books under its own terms.",
        "She got her license under the old terms in the same year.",
        "The software was released in version 2.0 with new conditions for use.",
        "A permission to copy the source was granted to the author by the foundation.",
    ],
}
#: Names of licences; where a template has one, the paragraph must have it too.
NAMES = {"affero", "agpl", "apache", "bsd", "cc", "cc0", "commons", "creative", "eclipse", "epl", "gpl", "lesser", "lgpl", "mit", "mozilla", "mpl"}
#: Function words; an n-gram needs another word to be a feature.
COMMON = {"a", "all", "an", "and", "any", "are", "as", "at", "be", "by", "can", "for", "from", "has", "in", "is", "it", "may", "not", "of", "on", "or", "or-later", "that", "the", "this", "to", "under", "use", "was", "were", "with", "work", "you", "v", "s"}

UNKNOWN = "unknown"
_WORDS = re.compile("[a-z0-9\u0080-\U0010ffff]+")
_STOPS = re.compile(r"(?<=[.!?;:])\s+")
#: Comment marks at the start of a line.
_MARKS = re.compile(r"(?:<!--|(?:REM|rem|dnl)\b|[\s/*#;%!|>\"'-])*+")
LONG = 60


def _words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def _grams(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _telling(gram: tuple[str, ...]) -> bool:
    return any(w not in COMMON and not w.isdigit() for w in gram)


class Model:
    """The classifier; small, and the same in every run."""

    def __init__(self, seed: int = 5, examples: int = 60, rounds: int = 150) -> None:
        draw = random.Random(seed)
        self.classes = [*TEMPLATES, UNKNOWN]
        self.features = {g: k for k, g in enumerate(sorted({g for ts in TEMPLATES.values() for t in ts for g in _grams(_words(t)) if _telling(g)}))}
        self.anchors = sorted({w for g in self.features for w in g if w not in COMMON and not w.isdigit()})
        words_of = {n: {w for t in ts for w in _words(t)} for n, ts in TEMPLATES.items()}
        #: Words that only one family's templates have.
        self.marks = {n: {w for w in ws if w not in COMMON and not w.isdigit() and not any(w in o for m, o in words_of.items() if m != n)} for n, ws in words_of.items()}
        rows: list[tuple[list[str], int]] = []
        pool = sorted({w for t in NOTHING for w in _words(t)} | {"lorem", "ipsum", "page", "table", "house", "year", "foo", "acme", "open", "source", "common"})
        around = lambda: [draw.choice(pool) for _ in range(draw.randrange(0, 9))]
        for k, name in enumerate(TEMPLATES):
            for t in TEMPLATES[name]:
                words = _words(t)
                for _ in range(examples):
                    kept = [w for w in words if draw.random() > 0.08 or w in self.marks[name]] or words
                    if draw.random() < 0.5:  # a part that holds the licence's name
                        a = draw.randrange(len(words))
                        part = words[a : a + max(3, len(words) * 2 // 5)]
                        if NAMES & set(words) <= set(part) and (NAMES & set(words) or len(part) > 9):
                            kept = part
                    rows.append((around() + kept + around(), k))
                for _ in range(examples // 3):  # another name in the same words
                    if self.marks[name] & set(words):
                        rows.append((around() + [draw.choice(pool) if w in self.marks[name] else w for w in words] + around(), len(TEMPLATES)))
        every = [w for ts in TEMPLATES.values() for t in ts for w in _words(t)]
        for _ in range(examples * 8):
            kind = draw.randrange(4)
            if kind == 0:
                words = _words(draw.choice(NOTHING)) + around()
            elif kind == 1:
                words = _words(draw.choice(draw.choice(list(TEMPLATES.values()))))
                draw.shuffle(words)
                words = words[: max(1, len(words) // 2)]
            elif kind == 2:
                words = around() + _words(draw.choice(OTHERS)) + around()
            else:
                words = [draw.choice(every) for _ in range(draw.randrange(1, 4))] + [draw.choice(pool) for _ in range(draw.randrange(0, 20))]
            rows.append((words, len(TEMPLATES)))
        draw.shuffle(rows)
        x, y = self._matrix([w for w, _ in rows]), np.array([k for _, k in rows])
        self.weights = np.zeros((x.shape[1], len(self.classes)), np.float32)
        aim = np.eye(len(self.classes), dtype=np.float32)[y]
        for _ in range(rounds):
            p = self._soft(x @ self.weights)
            self.weights -= 4.0 * (x.T @ (p - aim) / len(rows) + 1e-4 * self.weights)
        apart = [(_words(t), self.classes.index(n or UNKNOWN)) for n, ts in HELD_OUT.items() for t in ts]
        logits, truth = np.stack([self._logits(w) for w, _ in apart]), np.array([k for _, k in apart])
        loss = lambda t: -np.log(self._soft(logits / t)[np.arange(len(logits)), truth] + 1e-9).mean()
        self.temperature = min((0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0), key=loss)
        self.held_out_accuracy = float((logits.argmax(1) == truth).mean())
        pairs = lambda w: set(zip(w, w[1:], strict=False)) or {(w[0],)}
        self.templates = {n: [(pairs(w), self.marks[n] & set(w), NAMES & set(w)) for w in map(_words, ts)] for n, ts in TEMPLATES.items()}
        # No feature at all must mean unknown: then texts without licence words need no look.
        empty = self.weights[-1]
        assert empty.argmax() == len(self.classes) - 1

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def _matrix(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), len(self.features) + 1), np.float32)
        out[:, -1] = 1
        for i, words in enumerate(rows):
            own = [self.features[g] for g in _grams(words) if g in self.features]
            if own:
                out[i, own] = 1 / np.sqrt(len(own))
        return out

    def _logits(self, words: list[str]) -> np.ndarray:
        """The scores of one paragraph, from the weights of its own n-grams alone."""
        own = [self.features[g] for g in _grams(words) if g in self.features]
        return self.weights[-1] + (self.weights[own].sum(0) / np.sqrt(len(own)) if own else 0)

    def judge(self, paragraph: str, least: float) -> tuple[str, float, float] | None:
        """(family, probability, likeness to its nearest template), or None for unknown."""
        words = _words(paragraph)
        if not any(g in self.features for g in _grams(words)):
            return None  # unknown by the bias
        p = self._soft(self._logits(words)[None, :] / self.temperature)[0]
        k = int(p.argmax())
        if self.classes[k] == UNKNOWN or p[k] < least:
            return None
        own = set(zip(words, words[1:], strict=False)) | {(w,) for w in words}
        like = [len(t & own) / len(t) if 2 * len(marks & set(words)) >= len(marks) and names <= set(words) else 0.0 for t, marks, names in self.templates[self.classes[k]]]
        return self.classes[k], float(p[k]), max(like)


@cache
def model() -> Model:
    return Model()


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """(line, paragraph): lines, and the sentences of long lines instead."""
    for k, line in enumerate(text.split("\n")):
        if len(line.split(None, LONG)) <= LONG:
            yield k, line
        else:
            for sentence in _STOPS.split(line):
                yield k, sentence


def _bare(line: str) -> str:
    """A line without comment marks at its ends."""
    return line[_MARKS.match(line).end() :].rstrip().removesuffix("-->").rstrip(" \t\r/*#|")


def blocks(text: str) -> Iterator[list[tuple[int, str]]]:
    """Runs of two and more lines that are not blank without their comment marks, as (line, its words)."""
    held: list[tuple[int, str]] = []
    for k, line in enumerate([*text.split("\n"), ""]):
        bare = _bare(line)
        if bare:
            held.append((k, bare))
            continue
        if len(held) > 1:
            yield held
        held = []


def notices(own: Model, text: str, least: float, like: float) -> list[dict]:
    """What is found in the lines of a text, then in joined lines, in order of their first line."""

    def judged(line: int, paragraph: str) -> dict | None:
        seen = own.judge(paragraph, least)
        return seen and {"line": line, "family": seen[0], "probability": round(seen[1], 6), "likeness": round(seen[2], 6), "confirmed": seen[2] >= like, "text": paragraph}

    alone: list[dict] = []
    for k, paragraph in paragraphs(text):
        x, sentences = judged(k, paragraph), _STOPS.split(paragraph)
        inner = [y for y in (judged(k, s) for s in sentences) if y and y["confirmed"]] if len(sentences) > 1 and not (x and x["confirmed"]) else []
        alone += inner or ([x] if x else [])
    out = list(alone)
    for block in blocks(text):
        joined = " ".join(bare for _, bare in block)
        starts = np.cumsum([0] + [len(bare) + 1 for _, bare in block])
        inside = [x for x in alone if block[0][0] <= x["line"] <= block[-1][0]]
        new: list[tuple[int, int, dict]] = []

        def read(a: int, b: int) -> None:
            first, last = (int(np.searchsorted(starts, at, side="right")) - 1 for at in (a, b - 1))  # noqa: B023
            x = judged(block[first][0], joined[a:b]) if last > first else None  # noqa: B023
            if x is None:
                return
            within = [y for y in inside if block[first][0] <= y["line"] <= block[last][0]] + [y for c, d, y in new if a <= c and d <= b]  # noqa: B023
            for y in within:
                whole = y["text"] in joined[a:b] or _bare(y["text"]) in joined[a:b]  # noqa: B023
                if x["confirmed"] and whole and y["family"] != x["family"] and y["likeness"] < x["likeness"]:
                    y["confirmed"] = False
            if not any(y["family"] == x["family"] and y["confirmed"] >= x["confirmed"] for y in within):
                new.append((a, b, x))  # noqa: B023

        cuts = [0, *(m.end() for m in _STOPS.finditer(joined)), len(joined)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        for a, b in spans:
            read(a, b)
        done = [any(y["confirmed"] and a < d and c < b for c, d, y in new) or any(y["confirmed"] and _bare(y["text"]) in joined[a:b] for y in inside) for a, b in spans]
        for (a, _), (_, b), x, y in zip(spans, spans[1:], done, done[1:], strict=False):
            if not x and not y:
                read(a, b)
        if len(spans) > 2 and len(joined.split(None, LONG)) <= LONG and not any(x["confirmed"] for x in inside + [x for _, _, x in new]):
            read(0, len(joined))
        out += [x for _, _, x in new]
    return sorted(out, key=lambda x: x["line"])


def scan_licenses(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), least: float = 0.6, like: float = 0.6) -> DataFrame:
    """The carried columns, families (confirmed, sorted), and found: array of (line, family, probability, likeness, confirmed, text)."""
    carry = tuple(c for c in carry if c not in ("families", "found", "l_text"))
    chosen = docs.select(*carry, F.col(text).alias("l_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "l_text")
    found = pa.struct([("line", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64()), ("confirmed", pa.bool_()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model()
        column = pa.array(own.anchors, pa.large_string())
        _, data, offsets = next(kernels.slices(column))
        anchors = np.sort(kernels.span_hashes(data, offsets[:-1], offsets[1:]))
        breaks = kernels.NOT_ALNUM
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            families: list[list[str]] = [[] for _ in range(len(texts))]
            places: list[list[dict]] = [[] for _ in range(len(texts))]
            for first, data, offsets in kernels.slices(texts):
                data = kernels.lower(data)
                s, e, row = kernels.words(data, offsets, breaks)
                h = kernels.span_hashes(data, s, e)
                at = np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)
                for r in np.unique(row[anchors[at] == h]).tolist():
                    places[first + r] = notices(own, texts[first + r].as_py(), least, like)
                    families[first + r] = sorted({x["family"] for x in places[first + r] if x["confirmed"]})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(families, pa.list_(pa.string())), pa.array(places, pa.list_(found))], names=[*batch.schema.names[:-1], "families", "found"])
        kernels.release()

    return chosen.mapInArrow(run, f"{fields}, families array<string>, found array<struct<line:long,family:string,probability:double,likeness:double,confirmed:boolean,text:string>>")
