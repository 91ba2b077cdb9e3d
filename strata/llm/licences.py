"""Licence scans with a trained paragraph classifier.

A multinomial logistic regression over sparse word 1- and 2-grams names the
licence family of a passage, with a class for passages that are no licence. It
is trained here: positives are the template paragraphs below, seeded edits of
them and parts of them; the unknown class learns from a bounded sample of the
corpus (``sample_docs`` documents by a seeded hash, of each at most
``sample_chars`` characters, at most ``sample_lines`` lines) and from shuffled
template words. The threshold of the unknown class is calibrated on a held-out
third. The likeliest family counts that a template of it confirms: 0.8 or more of
the template's five-word shingles (all its words, if it has fewer) in the
passage, or of the passage's in the template; and not where the words right
before a mention deny it ("not licensed under ...").

A text's paragraphs are its parts between blank lines. In a paragraph each line
is a passage, and so are the lines of a notice that was wrapped: neighbouring
lines of template phrases are joined, first all of them, then shorter runs.
Grams outside the templates have no weight, so whole texts are scored line by
line by the grams that have one.

Defined cases: a null or empty text has no paragraphs; repeated rows get equal
rows; an empty table trains on the templates alone and gives an empty result;
extra columns pass through, columns named like a result are replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, text_slices

SHINGLE, SIMILARITY = 5, 0.8
SAMPLE_DOCS, SAMPLE_LINES, SAMPLE_CHARS, EDITS = 400, 2000, 4000, 12
UNKNOWN = "unknown"
#: A passage is compared with the templates of so many likeliest families.
LIKELY = 3
#: Lengths of runs of wrapped lines that are tried, beside all of them.
RUNS = (16, 12, 8, 6, 5, 4, 3, 2)
#: Words that deny what follows.
DENIALS = {"not", "never", "no", "isn", "aren", "wasn", "neither", "nor", "t", "without"}

#: Notices and opening paragraphs of public licences, by family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    ],
    "Boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    ],
    "zlib": [
        "Released under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "CC0": [
        "Licensed under CC0 1.0.",
        "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "This material may not be published, broadcast, rewritten, or redistributed without prior written permission.",
    ],
}
_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(ws: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(ws[i: i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def similarity(ws: list[str], template: list[str]) -> float:
    """Share of one side's shingles that the other has, the better side."""
    size = min(SHINGLE, len(template))
    a, b = shingles(ws, size), shingles(template, size)
    if not a or not b or len(ws) < size:
        return 0.0
    both = len(a & b)
    return max(both / len(b), both / len(a) if len(a) >= SHINGLE else 0.0)


def denied(ws: list[str], template: list[str]) -> bool:
    """Whether the words right before the template's first words deny it."""
    head = template[: min(3, len(template))]
    at = next((i for i in range(len(ws)) if ws[i: i + len(head)] == head), 0)
    return any(w in DENIALS for w in ws[max(0, at - 3): at])


class LicenceModel:
    """Sparse weights of the grams, the classes, and the threshold."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.word = {w: i for i, w in enumerate(dict.fromkeys(w for g in vocabulary for w in g.split()))}
        self.pair = {self.word[g.split()[0]] * len(self.word) + self.word[g.split()[1]]: i for g, i in vocabulary.items() if " " in g}
        self.single = {self.word[g]: i for g, i in vocabulary.items() if " " not in g}
        self.templates = {f: [words(t) for t in ts] for f, ts in TEMPLATES.items()}
        self.classes = [UNKNOWN, *TEMPLATES]
        self.weights = np.zeros((len(self.classes), len(vocabulary)))
        self.bias = np.zeros(len(self.classes))
        self.threshold = 0.5

    def features(self, ws: list[str]) -> list[int]:
        return self._grams(ws)[0]

    def _grams(self, ws: list[str]) -> tuple[list[int], int]:
        """(grams of templates, how many neighbouring words are one)"""
        ids = [self.word.get(w, -1) for w in ws]
        n = len(self.word)
        found = {self.single[i] for i in ids if i in self.single}
        pairs = [self.pair[a * n + b] for a, b in zip(ids, ids[1:]) if a >= 0 and b >= 0 and a * n + b in self.pair]
        found.update(pairs)
        return sorted(found), len(pairs)

    def probabilities(self, features: list[int]) -> np.ndarray:
        z = self.bias + self.weights[:, features].sum(axis=1)
        p = np.exp(z - z.max())
        return p / p.sum()

    def assess(self, ws: list[str], f: list[int] | None = None) -> tuple[str, float, float] | None:
        """(family, probability, similarity) of a passage that is accepted."""
        f = self.features(ws) if f is None else f
        if len(f) < 2:
            return None
        p = self.probabilities(f)
        if 1 - p[0] < self.threshold:
            return None
        for k in (np.argsort(-p[1:], kind="stable")[:LIKELY] + 1).tolist():
            best, t = max((similarity(ws, t), t) for t in self.templates[self.classes[k]])
            if best >= SIMILARITY:
                return None if denied(ws, t) else (self.classes[k], float(p[k]), best)
        return None

    def passages(self, lines: list[str]) -> list[tuple[int, int, tuple[str, float, float]]]:
        """(first line, lines, finding) of a paragraph's accepted passages."""
        ws = [words(x) for x in lines]
        grams = [self._grams(w) for w in ws]
        single = [self.assess(w, f) for w, (f, _) in zip(ws, grams)]
        out, i = [], 0
        while i < len(lines):
            if single[i]:
                out.append((i, 1, single[i]))
                i += 1
                continue
            j = i
            while j < len(lines) and not single[j] and 10 * grams[j][1] >= 3 * (len(ws[j]) - 1) and (j > i or len(ws[j]) > 2):
                j += 1
            if j - i > 1:
                out += self._joined(ws, i, j)
            i = max(j, i + 1)
        return out

    def _joined(self, ws: list[list[str]], i: int, j: int) -> list[tuple[int, int, tuple[str, float, float]]]:
        """Findings in the wrapped lines i to j - 1: the longest runs first."""
        for size in [j - i, *(n for n in RUNS if n < j - i)]:
            for at in range(i, j - size + 1):
                hit = self.assess([w for x in ws[at: at + size] for w in x])
                if hit:
                    before = self._joined(ws, i, at) if at - i > 1 else []
                    after = self._joined(ws, at + size, j) if j - at - size > 1 else []
                    return [*before, (at, size, hit), *after]
        return []


def _edited(ws: list[str], rng: random.Random, filler: list[str]) -> list[str]:
    """A few words dropped or replaced, and ordinary words around."""
    out = [w if rng.random() > 0.08 else rng.choice(filler) for w in ws if rng.random() > 0.06]
    take = lambda: [rng.choice(filler) for _ in range(rng.choice([0, 0, 4, 15]))]
    return take() + out + take()


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES,
          sample_chars: int = SAMPLE_CHARS, seed: int = 3) -> LicenceModel:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    spark = docs.sparkSession
    rng = random.Random(seed)
    # the least seeded hashes first, as numbers only; then the texts they belong to
    ranked = docs.where(F.col("text").isNotNull()).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    edge = ranked.select("_h").orderBy("_h").limit(sample_docs).agg(F.max("_h")).first()[0]
    sample = [] if edge is None else (ranked.where(F.col("_h") <= edge).select(F.substring("text", 1, sample_chars).alias("text"))
                                      .limit(2 * sample_docs).collect())
    lines = sorted({w for r in sample for w in r["text"].split("\n") if w.strip()})
    rng.shuffle(lines)
    corpus = [words(x) for x in lines[:sample_lines]]
    templates = [(f, words(t)) for f, ts in TEMPLATES.items() for t in ts]
    grams = {g for _, t in templates for g in [*t, *map(" ".join, zip(t, t[1:]))]}
    model = LicenceModel({g: i for i, g in enumerate(sorted(grams))})
    filler = [w for ws in corpus for w in ws[:20] if not w.isdigit()] or ["lorem", "ipsum", "dolor"]
    # the unknown class: corpus lines that no template is near, and template words out of order
    rows = [(0, ws) for ws in corpus if max(similarity(ws, t) for _, t in templates) < 0.5]
    known = [w for _, t in templates for w in t]
    rows += [(0, rng.sample(known, min(len(known), rng.randint(3, 25)))) for _ in range(EDITS * len(templates))]
    rows += [(model.classes.index(f), ws) for f, t in templates for ws in [t, *[_edited(t, rng, filler) for _ in range(EDITS)]]]
    # parts of long templates, as wrapped or broken off notices have them
    rows += [(model.classes.index(f), t[i: i + n]) for f, t in templates if len(t) > 16 for n in (8, 16, 24) for i in range(0, len(t) - 7, 8)]
    rng.shuffle(rows)
    rows = [(label, fs) for label, ws in rows if (fs := model.features(ws)) or label == 0]
    held, rest = rows[::3], [r for i, r in enumerate(rows) if i % 3]
    rest += [(model.classes.index(f), model.features(t)) for f, t in templates]
    size = len(model.vocabulary)
    frame = spark.createDataFrame([(float(y), Vectors.sparse(size, [(i, 1.0) for i in fs])) for y, fs in rest], ["label", "features"]).coalesce(1)
    fitted = LogisticRegression(maxIter=60, regParam=0.002, family="multinomial", standardization=False).fit(frame)
    model.weights = fitted.coefficientMatrix.toArray()
    model.bias = np.array(fitted.interceptVector.toArray())
    # calibration: the least threshold at which held-out acceptances are 99 % licences
    tried = [(1 - float(model.probabilities(fs)[0]), y != 0) for y, fs in held]
    tried.sort(reverse=True)
    right = np.cumsum([ok for _, ok in tried]) / np.arange(1, len(tried) + 1)
    good = np.flatnonzero(right >= 0.99)
    model.threshold = max(0.5, tried[int(good[-1])][0] if len(good) else 0.9)
    return model


def paragraphs(text: str) -> list[tuple[int, list[str]]]:
    """(number of the first line, lines) of the parts between blank lines."""
    out: list[tuple[int, list[str]]] = []
    for i, line in enumerate(text.split("\n")):
        if not line.strip():
            continue
        if out and out[-1][0] + len(out[-1][1]) == i:
            out[-1][1].append(line)
        else:
            out.append((i, [line]))
    return out


def scan_licences(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """All rows and columns of ``docs`` with n_paragraphs and licences: paragraph
    number, first line and number of lines, family, probability and similarity
    of every accepted passage."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("n_paragraphs", "licences")]
    item = (T.StructType().add("paragraph", "integer").add("line", "integer").add("lines", "integer").add("family", "string")
            .add("probability", "double").add("similarity", "double"))
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("line", pa.int32()), ("lines", pa.int32()), ("family", pa.string()),
                               ("probability", pa.float64()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in text_slices(batches, "text"):
            count, found = [], []
            for t in b.column(names.index("text")).to_pylist():
                parts = paragraphs(t or "")
                count.append(len(parts))
                found.append([{"paragraph": k, "line": first + at, "lines": size, "family": hit[0], "probability": hit[1], "similarity": hit[2]}
                              for k, (first, lines) in enumerate(parts) for at, size, hit in known.passages(lines)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(count, pa.int64()), pa.array(found, kind)], [*names, "n_paragraphs", "licences"])

    schema = T.StructType([*[f for f in docs.schema.fields if f.name in names], T.StructField("n_paragraphs", T.LongType()), T.StructField("licences", T.ArrayType(item))])
    return docs.select(*numbered(names)).mapInArrow(run, schema)
