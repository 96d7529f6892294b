"""License scans: a trained paragraph classifier confirmed by template comparison.

A paragraph is a line of the text, joined with the lines that it is wrapped to (see
``wrapped``); comment signs before lines don't count. Its features are the words' n-grams (n up to 3)
that occur in the templates below and hold a content word; a paragraph without such a
feature gets no further. A softmax regression over these sparse counts tells licence
families, ``unknown`` (wording of a licence, but of no family known here) and ``none``
apart. It is trained on the driver when the scan is planned, from the templates with
words dropped, replaced and put around them, and from a bounded sample of paragraphs of
the corpus.

The unknown class is calibrated on what training didn't see: in each of ``FOLDS`` folds
some phrases for every family and some families as a whole are held out. Over all folds one
temperature is fitted, and the least probability of known families together and least similarity to a template that best
tell unseen wordings of known families from unseen families; ``Model`` keeps how many of either came out right. These
are hard cases: families such as the GPL, LGPL and AGPL share nearly all of their wording.
A family is then confirmed by template comparison: of the families that the classifier holds possible,
that with the nearest template, if enough of the template's word triples, or the paragraph's own, are shared;
else the paragraph counts as ``unknown``, or as ``none`` where the classifier leans to it.

A short paragraph may name several licences, and a declaration (``License: ...``, ``SPDX-License-Identifier: ...``, a package's
classifier) may hold no more than a name. So declared values, and the parts of short licence paragraphs between "and", "or" and
the like, are put into a plain licence phrase and judged in the same way, by the classifier and the templates: a paragraph has each
family found so, if a declared value or a paragraph that is else ``unknown`` has any, or the parts have several.

Defined results: a null text counts as empty (no findings); offsets are code points,
end exclusive; documents without findings are in the result with a count of 0;
rows are judged one by one, so repeated rows and ids get equal results; texts are read
whole; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantide.llm.common import table

#: documents whose paragraphs serve as negative examples, and paragraphs taken from them, at most
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 400, 4_000
SEED = 11
FOLDS = 3
#: a family with less probability isn't compared
POSSIBLE = 0.02
#: distinct features below which a paragraph is no licence
LEAST_FEATURES = 3
UNKNOWN, NONE = "unknown", "none"

# Short wordings by which public licences are named or granted.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "Distributed under the MIT license (see the file LICENSE).",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "Licensed under the zlib License.",
        "SPDX-License-Identifier: Zlib",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
        "Released under the Unlicense.",
    ],
    "wtfpl": [
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
        "Licensed under the WTFPL, version 2.",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
        "SPDX-License-Identifier: WTFPL",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 1.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 2.",
        "Released under the GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Licensed under the BSD 2-Clause License.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
        "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 license.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Released under CC BY-ND 3.0.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under CC BY 3.0.",
    ],
    "cc0": [
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work has been dedicated to the public domain under CC0.",
    ],
    UNKNOWN: [
        "Licensed under the Harbour Community License, version 1.4.",
        "This work is licensed under the Northwind Data License.",
        "Released under the Quartz Sharing License.",
        "Use of this material is subject to the terms of the accompanying license agreement.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "This file is proprietary and confidential; unauthorized copying is prohibited.",
        "Distributed under the terms of a custom license; see the file COPYING.",
        "The license grants you a limited, non-transferable right to use this software.",
    ],
}
# Names of public licences, and phrases by which texts are put under one.
NAMES: dict[str, list[str]] = {
    "apache-2.0": ["the Apache License, Version 2.0", "the Apache 2.0 license", "the Apache Software License"],
    "mit": ["the MIT License", "the MIT/X11 license", "an MIT-style license"],
    "isc": ["the ISC License", "the Internet Systems Consortium license"],
    "zlib": ["the zlib License", "the zlib/libpng license"],
    "unlicense": ["the Unlicense license", "the Unlicense public domain dedication"],
    "wtfpl": ["the WTFPL license", "the WTFPL, version 2"],
    "epl": ["the Eclipse Public License", "the EPL license 2.0"],
    "gpl": ["the GNU General Public License", "the GPL version 3", "the GNU GPL v2", "the GPL license"],
    "lgpl": ["the GNU Lesser General Public License", "the GNU LGPL version 2.1", "the LGPL license"],
    "agpl": ["the GNU Affero General Public License", "the GNU AGPL v3", "the AGPL license"],
    "bsd": ["the BSD 3-Clause License", "the BSD license", "the 2-clause BSD license", "the New BSD License"],
    "mpl": ["the Mozilla Public License", "the MPL license 2.0"],
    "cc-by-nc": ["a Creative Commons Attribution-NonCommercial license", "the CC BY-NC 4.0 license"],
    "cc-by-nd": ["a Creative Commons Attribution-NoDerivatives license", "the CC BY-ND 4.0 license"],
    "cc-by-sa": ["a Creative Commons Attribution-ShareAlike license", "the CC BY-SA 4.0 license"],
    "cc-by": ["a Creative Commons Attribution 4.0 license", "the CC BY 4.0 license"],
    "cc0": ["the CC0 1.0 Universal dedication", "the Creative Commons Zero license"],
    UNKNOWN: ["the Harbour Community License", "the Northwind Data License", "the Quartz Sharing License", "the Fieldstone Public License, version 2", "the Open Lantern License 1.0", "a custom license", "the Larkspur Software License"],
}
PHRASES = [
    "Licensed under {}.",
    "Released under {}.",
    "This work is licensed under {}.",
    "This program is distributed under the terms of {}.",
    "You may use this code under {}.",
    "The source is available under {}.",
    "This file is subject to {}.",
    "Published under {}, see the file LICENSE.",
    "All code here is covered by {}.",
]
STOP = frozenset("a all an and any are as at be by can for from has have if in is it may must no not of on or our part shall should so that the their them this to under use was we were will with without you your".split())
_WORDS = re.compile(r"[^\W_]+(?:\.\d+)*")
#: words of a paragraph that may name several licences
SHORT = 25
#: what declares a licence, and the value declared
_DECLARED = re.compile(r"(?i)(?:\bspdx-license-identifier|\blicen[cs]e(?:[ _-]expression)?)[\"']?\s*(?:::(?:\s*osi approved\s*::)?|[:=])\s*(\S.{0,119})$")
_BETWEEN = re.compile(r"(?i)\s+(?:and|or|with)\s+|[,;/|&()]+")
#: a version written onto a name, versions, and words that only say that it is a licence
_GLUED = re.compile(r"(?i)\b([al]?gpl|bsd|mpl|epl|apache)-?(v?\d)")
_VERSION = re.compile(r"(?i)\b(?:version\s*)?v?\d+(?:\.\d+)*\+?(?:-(?:only|or-later))?")
_KIND = re.compile(r"(?i)\blicen[cs]es?\b")


def words_of(paragraph: str) -> list[str]:
    return _WORDS.findall(paragraph.lower())


def grams(words: list[str], n: int = 3) -> list[str]:
    """The distinct n-grams that hold a content word, in order."""
    return list(dict.fromkeys(" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1) if not STOP.issuperset(words[i : i + k])))


def triples(words: list[str]) -> frozenset[tuple[str, ...]]:
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


@dataclass
class Model:
    """What executors need: some thousand weights, whatever the size of the corpus."""

    classes: list[str]
    features: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    confirmed: float
    #: shares of held-out wordings given their family, and of wordings of held-out families given none
    seen_right: float = math.nan
    unseen_right: float = math.nan

    def __post_init__(self) -> None:
        self.content = frozenset(f for f in self.features if " " not in f)
        self.templates = {c: [triples(words_of(t)) for t in (*TEMPLATES[c], *NAMES[c])] for c in self.classes if c not in (UNKNOWN, NONE)}

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = [self.features[g] for g in grams(words) if g in self.features]
        z = (self.bias + (self.weights[at].sum(axis=0) / math.sqrt(len(at)) if at else 0.0)) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def similarity(self, family: str, words: list[str]) -> float:
        """The largest share of a template's word triples, or the paragraph's own if those are fewer, that both have."""
        own = triples(words)
        return max(len(own & t) / min(len(t), max(len(own), 3)) for t in self.templates[family])

    def nearest(self, words: list[str]) -> tuple[float, str, float]:
        """The probability of all known families together, the possible one with the nearest template, and that one's similarity."""
        p = dict(zip(self.classes, self.probabilities(words).tolist(), strict=True))
        near = {c: self.similarity(c, words) for c in self.templates if p[c] >= POSSIBLE}
        family = max(near, key=lambda c: (near[c], p[c]), default=UNKNOWN)
        return 1 - p[NONE] - p[UNKNOWN], family, near.get(family, 0.0)

    def classify(self, paragraph: str) -> str:
        if self.content.isdisjoint(words := words_of(paragraph)):
            return NONE
        if sum(g in self.features for g in grams(words)) < LEAST_FEATURES:
            return NONE
        p = dict(zip(self.classes, self.probabilities(words).tolist(), strict=True))
        if max(p, key=p.get) == NONE:
            return NONE
        mass, family, similarity = self.nearest(words)
        if mass >= self.least and similarity >= self.confirmed:
            return family
        # a few licence words in other prose aren't a licence
        return UNKNOWN if p[NONE] < 0.1 else NONE


    def named(self, value: str) -> str | None:
        """The family of a licence's name, judged in a plain phrase; names are tried with and without their version."""
        value = _GLUED.sub(r"\1 \2", _KIND.sub(" ", value))
        for name in (value, _VERSION.sub(" ", value)):
            words = words_of(f"Licensed under the {name} license")
            if self.content.isdisjoint(words_of(name)):
                continue
            mass, family, similarity = self.nearest(words)
            if mass >= self.least and similarity >= self.confirmed:
                return family
        return None

    def families(self, paragraph: str) -> list[str]:
        """The families that a paragraph has, or ``unknown`` alone, or none at all."""
        kind = self.classify(paragraph)
        declared = _DECLARED.search(paragraph)
        if not declared and (kind == NONE or len(words_of(paragraph)) > SHORT):
            return [] if kind == NONE else [kind]
        parts = _BETWEEN.split(declared.group(1) if declared else paragraph)
        found = list(dict.fromkeys(f for f in map(self.named, parts) if f))
        if len(found) > 1 or found and (declared or kind == UNKNOWN):
            return found
        return [] if kind == NONE else [kind]


def examples(negatives: list[str], rng: random.Random, templates: dict[str, list[str]] = TEMPLATES, copies: int = 8) -> list[tuple[list[str], str]]:
    """Varied templates and the negatives, each with its class."""
    prose = [w for p in negatives for w in words_of(p)[:40]] or ["lorem"]
    found: list[tuple[list[str], str]] = []
    for family, texts in templates.items():
        for text in texts:
            words = words_of(text)
            found.append((words, family))
            for _ in range(copies):
                kept = [w for w in words if rng.random() > 0.06]
                if rng.random() < 0.4:
                    kept = rng.choices(prose, k=rng.randint(1, 12)) + kept
                if rng.random() < 0.4:
                    kept = kept + rng.choices(prose, k=rng.randint(1, 12))
                found.append((kept, family))
    # single licence words in prose are no licence
    single = [w for texts in TEMPLATES.values() for t in texts for w in words_of(t) if w not in STOP]
    for p in negatives:
        words = words_of(p)[:200]
        found.append((words, NONE))
        if rng.random() < 0.5 and words:
            for w in rng.choices(single, k=rng.randint(1, 2)):
                words = [*words[: (at := rng.randrange(len(words) + 1))], w, *words[at:]]
            found.append((words, NONE))
    return found


def vectors(data: list[list[str]], features: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(data), len(features)), np.float32)
    for row, words in enumerate(data):
        at = [features[g] for g in grams(words) if g in features]
        x[row, at] = 1 / math.sqrt(max(1, len(at)))
    return x


def fit(templates: dict[str, list[str]], negatives: list[str], rng: random.Random) -> Model:
    """Softmax regression by full-batch gradient steps with momentum; classes weigh alike."""
    classes = [*templates, NONE]
    features = {g: i for i, g in enumerate(dict.fromkeys(g for ts in templates.values() for t in ts for g in grams(words_of(t))))}
    data = examples(negatives, rng, templates)
    y, x = np.array([classes.index(c) for _, c in data]), vectors([w for w, _ in data], features)
    each = (1 / np.maximum(np.bincount(y, minlength=len(classes)), 1))[y]
    each = (each / each.sum())[:, None].astype(np.float32)
    w, b = np.zeros((len(features), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    one = np.eye(len(classes), dtype=np.float32)[y]
    for _ in range(200):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - one) * each
        vw, vb = 0.9 * vw + x.T @ g + 1e-5 * w, 0.9 * vb + g.sum(axis=0)
        w, b = w - 8 * vw, b - 8 * vb
    return Model(classes, features, w, b, 1.0, 0.5, 0.5)


def wordings(phrases: list[str], families: list[str]) -> dict[str, list[str]]:
    return {c: [*TEMPLATES[c], *(p.format(name) for name in NAMES[c] for p in phrases)] for c in families}


def held_out(fold: int) -> tuple[dict[str, list[str]], list[tuple[str, str]], list[str]]:
    """Wordings to train on, (wording, family) held out of families that stay, and wordings of families held out as a whole."""
    gone = [c for n, c in enumerate(TEMPLATES) if c != UNKNOWN and n % (2 * FOLDS) == fold]
    stay = [c for c in TEMPLATES if c not in gone]
    phrases = [p for n, p in enumerate(PHRASES) if n % FOLDS != fold]
    seen = [(p.format(name), c) for c in stay if c != UNKNOWN for name in NAMES[c] for p in PHRASES if p not in phrases]
    return wordings(phrases, stay), seen, [t for ts in wordings(PHRASES, gone).values() for t in ts]


def train(negatives: list[str], seed: int = SEED) -> Model:
    """The model of all templates, calibrated on held-out wordings and families (see above)."""
    known = [triples(words_of(t)) for ts in TEMPLATES.values() for t in ts]
    negatives = [p for p in negatives if (own := triples(words_of(p))) and not any(len(own & t) >= 0.3 * min(len(own), len(t)) for t in known)]
    negatives = negatives or ["lorem ipsum dolor sit amet", "the quick brown fox"]
    folds = []
    for fold in range(FOLDS):
        kept, seen, unseen = held_out(fold)
        folds.append((fit(kept, negatives[fold::FOLDS], random.Random(seed + fold)), seen, unseen))

    def loss(temperature: float) -> float:
        total = []
        for model, seen, _ in folds:
            model.temperature = temperature
            total += [-math.log(max(1e-12, float(model.probabilities(words_of(t))[model.classes.index(c)]))) for t, c in seen]
        return sum(total) / len(total)

    temperature = min((2.0 ** (k / 2) for k in range(-4, 9)), key=loss)
    # (probability of known families, nearest family, its similarity) of the held-out texts
    near: list[list[tuple[float, bool, float]]] = [[], []]
    for model, seen, unseen in folds:
        model.temperature = temperature
        for to, texts in zip(near, (seen, [(t, UNKNOWN) for t in unseen]), strict=True):
            for text, family in texts:
                mass, nearest, similarity = model.nearest(words_of(text))
                to.append((mass, nearest == family, similarity))
    known, other = (np.array(x, dtype=float) for x in near)

    def told(least: float, confirmed: float) -> tuple[float, float]:
        pass_known, pass_other = ((x[:, 0] >= least) & (x[:, 2] >= confirmed) for x in (known, other))
        return float((pass_known & (known[:, 1] > 0)).mean()), float((~pass_other).mean())

    least, confirmed = max(((k / 20, c / 20) for k in range(1, 20) for c in range(4, 13)), key=lambda x: (round(math.prod(told(*x)), 9), -x[0], -x[1]))
    model = fit(wordings(PHRASES, list(TEMPLATES)), negatives, random.Random(seed))
    model.temperature, model.least, model.confirmed = temperature, least, confirmed
    model.seen_right, model.unseen_right = told(least, confirmed)
    return model


def negative_sample(docs: DataFrame, key: str, text: str) -> list[str]:
    """At most SAMPLE_PARAGRAPHS paragraphs' beginnings, the first ones of at most SAMPLE_DOCS ids, those with the smallest hashes."""
    h = F.xxhash64(F.col(key))
    # ids first, without texts; at most SAMPLE_DOCS hashes come to the driver
    chosen = [r.h for r in docs.select(h.alias("h")).orderBy("h").limit(SAMPLE_DOCS).collect()]
    lines = docs.select(h.alias("h"), F.col(text).alias("t")).where(F.col("h").isin(chosen))
    lines = lines.select("h", F.posexplode(F.slice(F.split(F.coalesce("t", F.lit("")), "\n"), 1, SAMPLE_PARAGRAPHS // SAMPLE_DOCS)).alias("k", "line"))
    lines = lines.select("h", "k", F.substring("line", 1, 2000).alias("line")).where("line <> ''").distinct()
    return [r.line for r in lines.orderBy("h", "k", "line").limit(SAMPLE_PARAGRAPHS).collect()]


_LEAD = re.compile(r"[\s#*/;%>|-]*")
#: lengths of lines that a writer may have wrapped
WRAPPED = range(40, 121)


def wrapped(line: str, following: str) -> bool:
    """Whether a line goes on in the following one: it is about as long as wrapped lines are, ends no sentence, and the next begins with no capital."""
    start = following[_LEAD.match(following).end() :][:1]
    return len(line.rstrip()) in WRAPPED and line.rstrip()[-1:] not in ".!?:;|" and bool(start) and (start.islower() or start.isdigit() or start in "(\"'")


def paragraphs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, words on one line) of each paragraph."""
    at, parts, start = 0, [], 0
    lines = text.split("\n")
    for n, line in enumerate(lines):
        parts.append(line[_LEAD.match(line).end() :] if parts else line)
        end = at + len(line)
        if n + 1 == len(lines) or not wrapped(line, lines[n + 1]):
            yield start, end, " ".join(parts)
            parts, start = [], end + 1
        at = end + 1


def find(model: Model, text: str | None) -> list[tuple[str, int, int]]:
    """(family or unknown, start, end) of each paragraph that holds a licence, once for each of its families; neighbours of one family are merged."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    last: dict[str, int] = {}
    for start, end, line in paragraphs(text):
        for kind in model.families(line) if line else ():
            at = last.get(kind, -1)
            if at >= 0 and found[at][2] + 1 == start:
                found[at] = (kind, found[at][1], end)
            else:
                last[kind] = len(found)
                found.append((kind, start, end))
    return found


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_licenses, families (sorted, comma-joined) and spans (family:start:end, comma-joined) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_found = [find(model, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(f) for f in all_found], pa.int64()),
                    pa.array([",".join(sorted({k for k, _, _ in f})) for f in all_found], pa.string()),
                    pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in f) for f in all_found], pa.string()),
                ],
                names=[key, "n_licenses", "families", "spans"],
            )

    kind = dict(docs.select(key).dtypes)[key]
    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, n_licenses long, families string, spans string")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(negative_sample(docs, "doc_id", "text")))
