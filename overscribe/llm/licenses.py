"""Licence scan: a trained classifier of paragraphs, calibrated, confirmed by templates.

Templates of licence notices are varied (words lost, replaced, brackets and
names added) to train a multinomial logistic regression on word n-grams,
together with licensing language of no known family and with ordinary
paragraphs of a bounded sample of the corpus. Its scores are calibrated by a
temperature on variants held out; below the threshold that keeps apart what was
held out of no family, whole families held out among it, a paragraph with
licensing language is ``unknown``. Families near to others (GNU, Creative
Commons) are only thought of where a paragraph has all that tells them apart,
the version or the terms, and nothing that another one has. A family is
confirmed if the paragraph shares enough of a template's word pairs and, of
families without such marks, of those that no other one has; else it is unknown.

A paragraph is a run of neighbouring lines with cue words, the words of the
templates that say something about licences; a blank line or one without a cue
ends it. Long ones are looked at in windows. The lines of a paragraph are
scored one by one as well: a line that is confirmed by itself counts by itself,
and what its paragraph is confirmed as takes in its unknown lines. Lines
without a cue hold no n-gram but such of PLAIN words and digits, which the
model has from ordinary text as well; they are not scored.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, in_batches

#: Notices by which licences are known.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
        "SPDX-License-Identifier: Apache-2.0",
        "License: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
        "License: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License v2.0 only.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1 or later.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "CC BY 3.0 Unported.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 3.0 Unported License.",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.",
    ],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported License.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "CC0": [
        "Released into the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright by the author, all rights reserved; no part may be reproduced without the prior written permission of the publisher.",
    ],
}
#: What families near to others must say, and what they must not, as patterns over words in lower case.
_TWO, _THREE = r"\b(version|v|gpl|license) ?2\b", r"\b(version|v|gpl|license) ?3\b"
_NC, _ND, _SA = r"\bnc\b|\bnon ?commercial\b", r"\bnd\b|\bno ?(derivs|derivatives)\b", r"\bsa\b|\bshare ?alike\b"
_GNU, _OTHER_GNU, _BY = r"\bgeneral public\b|\bgpl", r"\b(affero|lesser|agpl|lgpl)|\blibrary general\b", r"\bby\b|\battribution\b"
MARKS = {
    "GPL-2.0": ([_GNU, _TWO], [_OTHER_GNU]),
    "GPL-3.0": ([_GNU, _THREE], [_OTHER_GNU]),
    "AGPL-3.0": ([r"\baffero\b|\bagpl"], []),
    "LGPL": ([r"\blesser\b|\blgpl|\blibrary general\b"], []),
    "CC-BY": ([_BY], [_NC, _ND, _SA]),
    "CC-BY-NC": ([_BY, _NC], [_ND, _SA]),
    "CC-BY-ND": ([_BY, _ND], [_NC, _SA]),
    "CC-BY-SA": ([_BY, _SA], [_NC, _ND]),
    "CC-BY-NC-ND": ([_BY, _NC, _ND], [_SA]),
    "CC-BY-NC-SA": ([_BY, _NC, _SA], [_ND]),
}
#: Licensing language of no family above.
UNKNOWN = [
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "Licensed under the terms in the accompanying file.",
    "This work is licensed under its own terms, see the license agreement.",
    "Use of this software is subject to the license of the vendor.",
    "Please read the license before use; the license may change at any time.",
    "Distributed under the Example Company Community License, version 7.",
    "You may obtain a copy of the license from the author on request.",
    "A license is needed to use, copy or distribute this material.",
    "Licensed to the buyer under a separate agreement.",
    "The copyright holder grants a license for evaluation only.",
]
#: Ordinary prose with words of licences.
PROSE = [
    "The committee voted to license the new taxi drivers before the summer.",
    "She lost her driving license on the way home and had to ask for another copy.",
    "Nobody may enter the forest without the permission of the ranger.",
    "The software was slow that morning and the files were gone.",
    "They fought for the rights of the workers and for a fair agreement.",
    "The author of the book lived near the public library.",
    "The general spoke to the public about the conditions of the war.",
    "A free version of the program ran on every machine in the school.",
    "The state may revoke the license of a doctor who breaks the law.",
    "Poetic license lets a writer change the order of events.",
    "The publisher printed the work again after the war.",
    "The source of the river lies beyond the border.",
    "We believe that all human rights are reserved for citizens.",
    "The foundation published a library of general works for the public.",
]
NONE, OTHER = "none", "unknown"
FAMILIES = [*TEMPLATES, OTHER, NONE]
WORD = re.compile(r"[^\W_]+")
#: Words that say nothing about licences by themselves.
PLAIN = frozenset("a an and any are as at be by can copy either file following for form free from has in is it its later may no not of on only or our part person possible see source subject that the this to under use version with without work you your".split())
#: Ordinary documents from which negatives are taken, variants of each template, word pairs of a template that confirm it.
SAMPLE, VARIANTS, CONFIRM = 500, 60, 0.5
#: Words of a window over a long paragraph, and groups in which families are held out.
WINDOW, FOLDS = 120, 3
SEED = 11


def grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def variant(words: list[str], filler: list[str], rng: random.Random) -> list[str]:
    """Some words lost, replaced or added, and some of the filler before or after."""
    out = [rng.choice(filler) if rng.random() < 0.04 else w for w in words if rng.random() > 0.05 or len(words) < 5]
    before, after = (rng.choices(filler, k=rng.randint(0, 12)) if rng.random() < 0.3 else [] for _ in range(2))
    return before + (out or words) + after


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    temperature: float
    threshold: float
    cues: frozenset[str]

    def probabilities(self, paragraphs: list[list[str]]) -> np.ndarray:
        logits = np.tile(self.weights[-1], (len(paragraphs), 1))
        for i, words in enumerate(paragraphs):
            found = {j for g in grams(words) if (j := self.index.get(g)) is not None}
            if found:
                logits[i] += self.weights[sorted(found)].sum(axis=0)
        return softmax(logits / self.temperature)

    def judge(self, paragraphs: list[list[str]]) -> list[tuple[str, float]]:
        """(family, confidence) of each."""
        if not paragraphs:
            return []
        out = []
        for words, p in zip(paragraphs, self.probabilities(paragraphs), strict=True):
            p = p * [marked(words, f) for f in FAMILIES]
            p /= p.sum()  # unknown and none stay in
            k = int(p.argmax())
            family = FAMILIES[k]
            if family == NONE:
                out.append((NONE, float(p[k])))
            elif family != OTHER and p[k] >= self.threshold and confirmed(words, family):
                out.append((family, float(p[k])))
            else:
                out.append((OTHER, float(1 - p[FAMILIES.index(NONE)])))
        return out


    def found(self, lines: list[list[str]]) -> list[tuple[int, str, float]]:
        """(line, family, confidence) of what a text says; of a paragraph of several lines its first one."""
        out = []
        for run in paragraphs(lines, self.cues):
            single = [(i, *v) for i in run for v in [max(self.judge(windows(lines[i])), key=_weight)]]
            if len(run) > 1:
                whole = max(self.judge(windows([w for i in run for w in lines[i]])), key=_weight)
                if _weight(whole)[0] == 2:
                    single = [x for x in single if _weight(x[1:])[0] == 2]
                    single = single if any(f == whole[0] for _, f, _ in single) else [(run[0], *whole), *single]
                elif _weight(whole)[0] == 1 and all(f == NONE for _, f, _ in single):  # language that only the lines together show
                    single = [(run[0], *whole)]
            out += [x for x in single if x[1] != NONE]
        return out


def _weight(verdict: tuple[str, float]) -> tuple[int, float]:
    """A family goes before unknown, and that before none."""
    return (0 if verdict[0] == NONE else 1 if verdict[0] == OTHER else 2, verdict[1])


_MARKS = {f: tuple([re.compile(x) for x in part] for part in parts) for f, parts in MARKS.items()}


def marked(words: list[str], family: str) -> bool:
    """Whether the words have all that tells this family from those near to it; families without MARKS, unknown and none always do."""
    if family not in _MARKS:
        return True
    text = " ".join(words)
    needed, barred = _MARKS[family]
    return all(x.search(text) for x in needed) and not any(x.search(text) for x in barred)


_PAIRS = {f: [set(zip(w, w[1:], strict=False)) for w in map(words_of, t)] for f, t in TEMPLATES.items()}


def _own(family: str) -> set[tuple[str, str]]:
    """The word pairs that no other family has, and no unknown licensing language."""
    others = [words_of(t) for f, ts in [*TEMPLATES.items(), (OTHER, UNKNOWN)] if f != family for t in ts]
    return set().union(*_PAIRS[family]).difference(p for w in others for p in zip(w, w[1:], strict=False))


_OWN = {f: [t & _own(f) for t in _PAIRS[f]] for f in TEMPLATES}


def confirmed(words: list[str], family: str) -> bool:
    """Whether the words share enough pairs with a template, and have its family's marks or, where it has none, enough of the pairs that tell it."""
    pairs = set(zip(words, words[1:], strict=False))
    if family in _MARKS:
        return marked(words, family) and any(t and len(pairs & t) >= CONFIRM * len(t) for t in _PAIRS[family])
    return any(own and len(pairs & own) >= CONFIRM * len(own) and len(pairs & t) >= CONFIRM * len(t) for t, own in zip(_PAIRS[family], _OWN[family], strict=True))


def paragraphs(lines: list[list[str]], cues: frozenset[str]) -> list[list[int]]:
    """The runs of neighbouring lines with cues."""
    out: list[list[int]] = []
    for i, words in enumerate(lines):
        if not cues.isdisjoint(words):
            if out and out[-1][-1] == i - 1:
                out[-1].append(i)
            else:
                out.append([i])
    return out


def windows(words: list[str]) -> list[list[str]]:
    return [words[at : at + WINDOW] for at in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(ordinary: list[str]) -> Model:
    """ordinary: paragraphs without licensing language."""
    rng = random.Random(SEED)
    plain = [w for w in (words_of(p) for p in ordinary) if w]
    filler = sorted({w for words in plain for w in words})[:5000] or ["lorem", "ipsum", "dolor"]
    rows: list[tuple[list[str], int, bool]] = []
    for k, family in enumerate(FAMILIES[:-1]):
        for t in TEMPLATES.get(family, UNKNOWN):
            w = words_of(t)
            rows += [(w, k, False)] + [(variant(w, filler, rng), k, i % 4 == 0) for i in range(VARIANTS)]
    cue_words = {w for t in [*sum(TEMPLATES.values(), []), *UNKNOWN] for w in words_of(t) if w not in PLAIN and not w.isdigit()}
    stray = sorted(cue_words)
    plain = plain[:2000] + [rng.choices(filler, k=12) for _ in range(200)]
    rows += [(w, len(FAMILIES) - 1, i % 4 == 0) for i, w in enumerate(plain)]
    rows += [(rng.choices(filler, k=8) + [rng.choice(stray)] + rng.choices(filler, k=8), len(FAMILIES) - 1, i % 4 == 0) for i in range(4 * len(stray))]
    rows += [(variant(words_of(t), filler, rng), len(FAMILIES) - 1, i % 4 == 0) for t in PROSE for i in range(VARIANTS // 2)]
    vocabulary = sorted({g for t in [*sum(TEMPLATES.values(), []), *UNKNOWN] for g in grams(words_of(t))})
    index = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(index) + 1))
    x[:, -1] = 1
    for i, (words, _, _) in enumerate(rows):
        for g in grams(words):
            if g in index:
                x[i, index[g]] = 1
    y = np.eye(len(FAMILIES))[[k for _, k, _ in rows]]
    held = np.array([h for _, _, h in rows])
    w = _fit(x[~held], y[~held])
    logits, target = x[held] @ w, y[held].argmax(axis=1)
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(target)), target] + 1e-12).mean())
    p = softmax(logits / temperature)
    known = p[:, :-2].max(axis=1)
    wrong = [known[(target >= len(TEMPLATES)) & (p.argmax(axis=1) < len(TEMPLATES))]]
    # What families of which nothing was learned look like.
    kind = y.argmax(axis=1)
    for fold in range(FOLDS):
        gone = (kind % FOLDS == fold) & (kind < len(TEMPLATES))
        strange = softmax(x[gone] @ _fit(x[~held & ~gone], y[~held & ~gone], 100) / temperature)[:, :-2].max(axis=1)
        wrong.append(strange)
    wrong = np.concatenate(wrong)
    threshold = min(0.9, max(0.5, float(np.quantile(wrong, 0.95)) if len(wrong) else 0.5))
    return Model(index, w, temperature, threshold, frozenset(stray))


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a multinomial logistic regression, by gradient steps with momentum."""
    w = step = np.zeros((x.shape[1], y.shape[1]))
    rate = 4.0 / np.maximum(1, (x**2).sum(axis=1).mean())
    for _ in range(rounds):
        step = 0.9 * step + rate * (x.T @ (y - softmax(x @ w)) / len(x) - 2e-5 * w)
        w = w + step
    return w


def ordinary_paragraphs(docs: DataFrame) -> list[str]:
    """Of at most SAMPLE documents, those with the least hash of their doc_id: lines of under 2,000 characters without cues, at most a few each."""
    cue = "(?i)licen[sc]|copyright|copyleft|rights reserved|permission|warrant|redistribut|gnu|creative commons"
    chosen = docs.where("doc_id is not null").select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    few = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    few = few.select("doc_id", F.slice(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(cue) & (F.length(x) < 2000)), 1, 4).alias("lines"))
    rows = few.orderBy("doc_id", "lines").limit(2 * SAMPLE).collect()  # more rows than ids only where ids repeat
    return [x for r in rows for x in r.lines or []]


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, hits: array of (line, family, confidence) of every row; a null or empty text has none, rows that repeat have the same each."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(ordinary_paragraphs(docs)))  # the templates' size

    def run(batches):
        m = shared.value
        cues = m.cues
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                hits = []
                low = (text or "").lower()
                if not cues.isdisjoint(WORD.findall(low)):
                    hits = [{"line": i, "family": f, "confidence": p} for i, f, p in m.found([WORD.findall(x) for x in low.split("\n")])]
                out.append(hits)
            kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("confidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "hits"])

    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {id_type(docs)}, hits array<struct<line:int,family:string,confidence:double>>")


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (families, sorted, comma-joined; empty for none), n_paragraphs, confidence (the least; null for none).

    A null or empty text has no licence; an empty table gives an empty result.
    """
    hits = scan(docs)
    return hits.select(
        "doc_id",
        F.array_join(F.sort_array(F.array_distinct("hits.family")), ",").alias("licenses"),
        F.size("hits").cast("long").alias("n_paragraphs"),
        F.array_min("hits.confidence").alias("confidence"),
    )
