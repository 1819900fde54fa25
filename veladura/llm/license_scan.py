"""License scan: a trained paragraph classifier, confirmed by template comparison.

Paragraphs are lines, and blocks of several lines between blank lines.  Features are
word pairs and triples of the templates' vocabulary; a multinomial logistic regression
names the family, with ``none`` as a class of its own.  It is trained here: positives
are the templates as they are, in part, and with words left out, changed or put around;
negatives are ordinary sentences about licences and a bounded sample of the corpus's
own paragraphs (``SAMPLE`` documents, first by a hash of id and text).  On a separate part
of these the temperature of the probabilities is chosen by likelihood, and the
threshold below which a family is called ``unknown`` so that at most ``FALSE_ALARMS`` of
the held-out negatives would pass it.

A prediction above the threshold must then agree with a template of its family: the
share of the paragraph's word triples that are the template's, or of the template's
that are the paragraph's, whichever is larger, must reach ``CONFIRM``.  Notices of
neighbouring licences share nearly all triples, so the words that tell the family apart
must be there as well: its name and version (``MARKS``), or triples that no other
licence's wording has.
Short forms (``FORMS`` with ``SHORT_NAMES``, ``TITLES``: an SPDX line, a title, "License: MIT") are
training paragraphs too, and are confirmed by standing there word for word in a paragraph that
has little else.  A paragraph that offers several families, by an SPDX expression or by their
names, gets them joined by OR, whichever word joins them there; one that says that something is
*not* licensed so is ``unknown``.  The wording that all BSD licences share is no family.  A paragraph that fails
any of these tests is ``unknown`` if the model finds some licence in it beyond the
threshold, whichever it is; else it is ordinary text.

A line that is confirmed by name parts its block.  What is left of a block is judged as
a whole, and if that is confirmed it replaces its lines that were ``unknown`` or of the
same family: a notice wrapped over several lines is found.

Most paragraphs hold no feature at all; they are ``none`` at once, which is what the
model would say.  Scoring is one pass over whole texts without any exchange; the model
is bounded by the templates.

Edge cases: null and empty texts have no paragraphs and no licence; repeated rows are
scanned alike; a very long paragraph is one paragraph; without documents the negatives
are the built-in sentences; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veladura.llm.common import map_batches, ship

ship(__name__)

SAMPLE, SAMPLE_CHARS = 400, 20_000
VARIANTS, STEPS, RATE, RIDGE = 60, 250, 0.3, 1e-4
FALSE_ALARMS, LEAST_THRESHOLD, CONFIRM = 0.001, 0.6, 0.6

# Public notices and opening sentences of the licence families.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation; either version "
        "2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: Redistributions must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "This project is licensed under the terms of the BSD 2-Clause License, also known as the Simplified "
        "BSD License.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
        "of the MPL was not distributed with this file, You can obtain one at",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": (
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies.",
    ),
    "Zlib": (
        "Licensed under the zlib License.",
        "Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    "EPL-1.0": (
        "Licensed under the Eclipse Public License, version 1.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License v1.0 which accompanies this distribution, and is available at",
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License 2.0 which is available at",
    ),
    "BSL-1.0": (
        "Licensed under the Boost Software License, version 1.0.",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE or copy "
        "at the address given there)",
    ),
}


#: Wordings of several licences at once, by the family that they are trained as: they never confirm it.
SHARED = {
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted.",
    ),
}


def _version(number: str) -> str:
    return rf"(?:version |v )?v?{number}"


def _gnu(name: str, number: str) -> tuple[str, str]:
    return rf"gnu {name}", rf"(?:version|v|license) (?:v )?v?{number}|v{number}"


#: Name and version of a family, as patterns of whole words that must all be there.
MARKS = {
    "MIT": ("mit license|mit licensed",),
    "Apache-2.0": (f"apache (?:software )?license {_version('2.0')}",),
    "GPL-3.0": _gnu("general public license", r"3(?:.0)?"),
    "GPL-2.0": _gnu("general public license", r"2(?:.0)?"),
    "LGPL-3.0": _gnu("lesser general public license", r"3(?:.0)?"),
    "LGPL-2.1": _gnu("lesser general public license", r"2.1"),
    "AGPL-3.0": _gnu("affero general public license", r"3(?:.0)?"),
    "BSD-3-Clause": ("bsd 3-clause|3-clause bsd|bsd-3-clause|bsd-style license",),
    "BSD-2-Clause": ("bsd 2-clause|2-clause bsd|bsd-2-clause|simplified bsd license",),
    "MPL-2.0": (f"mozilla public license {_version('2.0')}",),
    "CC-BY-4.0": ("cc by 4.0|creative commons attribution(?: international)? 4.0",),
    "CC-BY-SA-4.0": ("cc by-sa 4.0|creative commons attribution-sharealike(?: international)? 4.0",),
    "CC-BY-NC-4.0": ("cc by-nc 4.0|creative commons attribution-noncommercial(?: international)? 4.0",),
    "CC0-1.0": ("cc0 1.0",),
    "Unlicense": ("the unlicense",),
    "ISC": ("isc license",),
    "Zlib": ("zlib license",),
    "EPL-1.0": (f"eclipse public license {_version('1.0')}",),
    "EPL-2.0": (f"eclipse public license {_version('2.0')}",),
    "BSL-1.0": (f"boost software license {_version('1.0')}",),
}
#: Without the name, so many triples that only this family has.
OWN_TRIPLES = 4

# How the families are called in short, and titles of whole texts.
SHORT_NAMES = {
    "MIT": ("MIT",),
    "Apache-2.0": ("Apache-2.0", "Apache 2.0", "Apache License 2.0"),
    "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPLv3", "GPL v3"),
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPLv2", "GPL v2"),
    "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPLv3"),
    "LGPL-2.1": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPLv2.1"),
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPLv3"),
    "BSD-3-Clause": ("BSD-3-Clause", "BSD 3-Clause"),
    "BSD-2-Clause": ("BSD-2-Clause", "BSD 2-Clause"),
    "MPL-2.0": ("MPL-2.0", "MPL 2.0"),
    "CC-BY-4.0": ("CC-BY-4.0", "CC BY 4.0"),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    "CC0-1.0": ("CC0-1.0", "CC0 1.0"),
    "Unlicense": ("Unlicense",),
    "ISC": ("ISC",),
    "Zlib": ("Zlib",),
    "EPL-1.0": ("EPL-1.0", "EPL 1.0"),
    "EPL-2.0": ("EPL-2.0", "EPL 2.0"),
    "BSL-1.0": ("BSL-1.0",),
    "Artistic-2.0": ("Artistic-2.0", "Artistic License 2.0"),
}
TITLES = {
    "Apache-2.0": ("Apache License Version 2.0, January 2004",),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3",),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2",),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3",),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1",),
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
    "Artistic-2.0": ("The Artistic License 2.0",),
}
#: Ways to name a licence in short, and how many other words the paragraph may have.
FORMS = (
    ("SPDX-License-Identifier: {}", 6), ("License: {}", 2), ("{} License", 1), ("Licensed under {}", 6),
    ("Licensed under the {} License", 6), ("Released under {}", 6), ("Released under the {} License", 6),
)
TITLE_EXTRA, SHORT_VARIANTS = 6, 16

NEGATIVES = (
    "The driving license must be renewed every five years at the town office.",
    "Poets take license with grammar, and readers forgive them for it.",
    "Please read the license before you use this software.",
    "The restaurant was licensed under the old rules of the city to sell beer.",
    "A copy of the letter was sent to any person who asked for one.",
    "The software was released under a new name in the spring.",
    "He worked in the public library and wrote a program that is free for schools.",
    "All rights reserved. No part of this book may be copied.",
    "This work was commissioned by the town and is on display in version two of the hall.",
    "The general asked the public for patience while the conditions are met.",
    "The version 2.0 of the tool is distributed in the hope that it helps.",
    "License plate numbers are issued under the terms of state law.",
    "Our terms of service may change at any time without notice.",
    "The foundation published a report on free software in schools.",
    "The MIT press released a book on law.",
    "Section 2.0 of the general plan was licensed to a public body.",
)

_WORD = re.compile(r"\w+(?:[.-]\w+)*")
_BLOCK = re.compile(r"\n[ \t\r]*\n")
_BROKEN = re.compile(r"(?<=\w)-[ \t\r]*\n[^\w\n]*(?=\w)")  # a line wrapped at a hyphen


@dataclass(frozen=True)
class LicenseModel:
    families: tuple[str, ...]  # the last is none
    features: dict[tuple[str, ...], int]
    weights: np.ndarray  # features by families
    bias: np.ndarray
    temperature: float
    threshold: float


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(_BROKEN.sub("-", paragraph.lower()))


def _grams(words: list[str], pairs: set) -> list[tuple[str, ...]]:
    """The features of a paragraph: known pairs, and triples whose both pairs are known."""
    hits = [p in pairs for p in zip(words, words[1:])]
    out = [(words[i], words[i + 1]) for i, h in enumerate(hits) if h]
    return out + [
        (words[i], words[i + 1], words[i + 2]) for i in range(len(hits) - 1) if hits[i] and hits[i + 1]
    ]


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Ranges of the lines that have words, and of blocks of several lines."""
    out, at = [], 0
    breaks = [*(m.span() for m in _BLOCK.finditer(text)), (len(text), len(text))]
    for end, following in breaks:
        if "\n" in text[at:end].strip():
            out.append((at, end))
        start = at
        for line in text[at:end].split("\n"):
            if line.strip():
                out.append((start, start + len(line)))
            start += len(line) + 1
        at = following
    return out


_FILLER = "the a of and in to for with this that author project file page site data work notes team".split()


# words without meaning may stand between those of a name
_GAP = rf" (?:(?:{'|'.join(_FILLER)}) )?"
_MARKS = {
    family: [re.compile(rf"(?<!\S)(?:{p.replace('.', r'[.]').replace(' ', _GAP)})(?!\S)") for p in all_of]
    for family, all_of in MARKS.items()
}
_SPDX = "spdx-license-identifier"
_NOT = re.compile(
    r"(?<!\S)(?:not|never|neither|nor|no longer|isn t|aren t|wasn t)(?: \S+){0,3} "
    r"(?:licensed|released|offered|available|covered)(?!\S)"
)
_EITHER = re.compile(r"(?<!\S)(?:or|either|dual|dual-licensed|both|and)(?!\S)")
_OTHER = re.compile(r"(?<!\S)(?:\S+ community|affero|lesser|library|\S+ public) license(?!\S)")


def _short_forms() -> list[tuple[str, list[str], int]]:
    """Family, words, and how many other words a paragraph may have beside them."""
    out = []
    for family, names in SHORT_NAMES.items():
        out += [(family, words_of(form.format(n)), extra) for n in names for form, extra in FORMS]
        out += [(family, words_of(t), TITLE_EXTRA) for t in TITLES.get(family, ())]
    # the longest first: of two that stand there the one that says more counts
    return sorted(out, key=lambda f: (-len(f[1]), f))


def _variant(words: list[str], chance: random.Random) -> list[str]:
    out = list(words)
    if len(out) > 12 and chance.random() < 0.5:  # a part of it
        size = chance.randint(10, len(out))
        at = chance.randint(0, len(out) - size)
        out = out[at : at + size]
    for _ in range(chance.randint(0, max(1, len(out) // 12))):
        i = chance.randrange(len(out))
        if chance.random() < 0.5:
            out.insert(i, chance.choice(_FILLER))
        elif len(out) > 5:
            out[i] = chance.choice(_FILLER)
    before, after = (chance.choices(_FILLER, k=chance.randint(0, 4)) for _ in range(2))
    return [*before, *out, *after] if chance.random() < 0.5 else out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def corpus_negatives(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Paragraphs of a bounded sample of the corpus that speak of no licence.

    The documents with the smallest hashes are chosen by these alone; texts are only
    fetched for the chosen ones.
    """
    key = F.xxhash64("doc_id", "text").alias("key")
    short = docs.filter(F.length("text").between(1, SAMPLE_CHARS)).select(key, "text")
    least = -(1 << 63)
    # hashes are evenly spread, so the smallest lie below a small multiple of their share
    bound = least + (1 << 64) * min(1.0, 8 * sample / max(docs.count(), 1))
    near = short.filter(F.col("key") <= F.lit(min(int(bound), (1 << 63) - 1)))
    chosen = near.select("key").distinct().orderBy("key").limit(sample)
    found = short.join(F.broadcast(chosen), "key").groupBy("key").agg(F.max("text").alias("text"))
    rows = found.orderBy("key").collect()
    return [
        r["text"][a:b]
        for r in rows
        for a, b in paragraphs(r["text"])
        if not re.search("licen[cs]|copyright|gnu|public domain", r["text"][a:b].lower())
    ]


def fit_licenses(negatives: list[str], seed: int = 13) -> LicenseModel:
    """Train, calibrate and set the threshold."""
    chance = random.Random(seed)
    families = (*sorted({*TEMPLATES, *SHORT_NAMES}), "none")
    pairs, grams = set(), set()
    for texts in (*TEMPLATES.values(), *SHARED.values()):
        for t in texts:
            ws = words_of(t)
            pairs |= set(zip(ws, ws[1:]))
            grams |= set(zip(ws, ws[1:])) | set(zip(ws, ws[1:], ws[2:]))
    short = _short_forms()
    for _, ws, _ in short:
        pairs |= set(zip(ws, ws[1:]))
        grams |= set(zip(ws, ws[1:])) | set(zip(ws, ws[1:], ws[2:]))
    features = {g: i for i, g in enumerate(sorted(grams))}
    samples: list[tuple[list[str], int]] = []
    for family in TEMPLATES:
        k = families.index(family)
        for t in (*TEMPLATES[family], *SHARED.get(family, ())):
            ws = words_of(t)
            samples += [(ws, k)] * 5 + [(_variant(ws, chance), k) for _ in range(VARIANTS)]
    for family, ws, _ in short:
        k = families.index(family)
        samples += [(ws, k)] * 2 + [(chance.choices(_FILLER, k=2) + ws, k) for _ in range(SHORT_VARIANTS)]
    none = len(families) - 1
    ordinary = [words_of(t) for t in (*NEGATIVES, *negatives)]
    samples += [(_variant(ws, chance), none) for ws in ordinary[: len(NEGATIVES)] for _ in range(20)]
    samples += [(ws, none) for ws in ordinary if ws]
    chance.shuffle(samples)
    held = len(samples) // 4

    def matrix(part):
        x = np.zeros((len(part), len(features)))
        for i, (ws, _) in enumerate(part):
            for g in _grams(ws, pairs):
                if g in features:
                    x[i, features[g]] = 1
        return x, np.array([k for _, k in part])

    # paragraphs without any feature are alike: one row with their number as its weight
    def collapsed(part):
        x, y = matrix(part)
        empty = ~x.any(axis=1) & (y == none)
        weight = np.ones(len(y))
        if empty.any():
            first = int(np.flatnonzero(empty)[0])
            weight[first] = min(empty.sum(), 2000)
            keep = ~empty
            keep[first] = True
            x, y, weight = x[keep], y[keep], weight[keep]
        return x, y, weight / weight.sum()

    x, y, weight = collapsed(samples[held:])
    wants = np.eye(len(families))[y]
    w, b = np.zeros((x.shape[1], len(families))), np.zeros(len(families))
    for step in range(STEPS):
        error = (_softmax(x @ w + b) - wants) * weight[:, None]
        rate = RATE * 30 / (1 + step / 100)
        w -= rate * (x.T @ error + RIDGE / 10 * w)
        b -= rate * error.sum(axis=0)
    x, y, weight = collapsed(samples[:held])
    z = x @ w + b
    temperature = min(
        (0.25, 0.4, 0.6, 0.8, 1.0, 1.3, 1.7, 2.5, 4.0),
        key=lambda t: -(np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12) * weight).sum(),
    )
    alarm = np.sort(_softmax(z / temperature)[y == none, :none].max(axis=1, initial=0.0))
    passed = int(len(alarm) * FALSE_ALARMS)
    highest = float(alarm[-1 - passed]) if len(alarm) else 0.0
    threshold = min(max(LEAST_THRESHOLD, highest + 1e-6), 0.99)
    return LicenseModel(families, features, w, b, temperature, threshold)


class Scanner:
    """A model with its templates, ready for texts."""

    def __init__(self, model: LicenseModel):
        self.model = model
        self.pairs = {g for g in model.features if len(g) == 2}
        self.templates = {
            family: [set(zip(ws, ws[1:], ws[2:])) for ws in map(words_of, texts)]
            for family, texts in TEMPLATES.items()
        }
        self.short: dict[str, list[tuple[str, list[str], int]]] = {}
        for form in _short_forms():
            self.short.setdefault(form[1][0], []).append(form)
        self.ids = {n.lower(): f for f, names in SHORT_NAMES.items() for n in names if " " not in n}
        shared = [set(zip(ws, ws[1:], ws[2:])) for texts in SHARED.values() for ws in map(words_of, texts)]
        # of the templates that don't name their family, the triples that no other wording has
        self.own = {
            family: [
                t.difference(*shared, *(o for f, others in self.templates.items() if f != family for o in others))
                for t, text in zip(templates, TEMPLATES[family])
                if not self.named(family, words_of(text))
            ]
            for family, templates in self.templates.items()
        }

    def agreement(self, family: str, words: list[str]) -> float:
        """The larger share of common word triples, over the family's templates."""
        own = set(zip(words, words[1:], words[2:]))
        if not own:
            return 0.0
        return max((len(own & t) / min(len(own), len(t)) for t in self.templates.get(family, ()) if t), default=0.0)

    def named(self, family: str, words: list[str]) -> bool:
        """Whether a family, or one of several joined by OR, is called by its name."""
        said = " ".join(words)
        return all(
            any(f in _MARKS and all(p.search(said) for p in _MARKS[f]) for f in (part,)) or self.in_short(words) == family
            for part in family.split(" OR ")
        )

    def in_short(self, words: list[str]) -> str | None:
        """The family that a short paragraph names, several joined by OR; ``unknown`` if it names another one."""
        if _SPDX in words:
            told = words[words.index(_SPDX) + 1 :]
            told = told[: next((i for i, w in enumerate(told) if w not in self.ids and w not in ("or", "and", "with")), None)]
            families = sorted({self.ids[w] for w in told if w in self.ids})
            return " OR ".join(families) or "unknown"
        for i, word in enumerate(words):
            for family, form, extra in self.short.get(word, ()):
                if words[i : i + len(form)] == form and len(words) <= len(form) + extra:
                    return family
        return None

    def several(self, words: list[str]) -> list[str]:
        """The families that a paragraph offers side by side; less than two are none."""
        if not _EITHER.search(" ".join(words)):
            return []
        held = [f for f in sorted(_MARKS) if self.named(f, words)]
        return held if len(held) > 1 else []

    def distinct(self, family: str, words: list[str]) -> bool:
        """Whether the words stand there that tell the family from its neighbours.

        Without its name these are triples of its own, and then no other licence may be named.
        """
        if self.named(family, words):
            return True
        triples = set(zip(words, words[1:], words[2:]))
        if not any(len(t & triples) >= OWN_TRIPLES for t in self.own[family]):
            return False
        return not _OTHER.search(" ".join(words)) and not any(self.named(f, words) for f in _MARKS)

    def judge(self, paragraph: str) -> tuple[str, float, float] | None:
        """Family or ``unknown``, probability, agreement; None for an ordinary paragraph."""
        words = words_of(paragraph)
        rows = [self.model.features[g] for g in _grams(words, self.pairs) if g in self.model.features]
        if not rows:
            return ("unknown", 1.0, 0.0) if _SPDX in words else None
        z = self.model.weights[sorted(set(rows))].sum(axis=0) + self.model.bias
        p = _softmax(z[None] / self.model.temperature)[0]
        best = int(p.argmax())
        family = self.model.families[best]
        if family == "none":
            return None
        agreement, some = self.agreement(family, words), float(1 - p[-1])
        if some >= self.model.threshold:
            if _NOT.search(" ".join(words)):
                return "unknown", some, agreement
            short, several = self.in_short(words), self.several(words)
            if several and (short is None or " OR " not in short):
                return " OR ".join(several), some, max(self.agreement(f, words) for f in several)
            if short is not None:
                return short, some, 1.0
        if p[best] >= self.model.threshold and agreement >= CONFIRM and self.distinct(family, words):
            return family, float(p[best]), agreement
        # some licence, but not surely one of these
        return ("unknown", some, agreement) if some >= self.model.threshold else None

    def scan(self, text: str | None) -> list[dict]:
        """What is found, by place: named lines part their block, what a block confirms replaces its lines."""
        text = text or ""
        found: dict[tuple[int, int], tuple[str, float, float]] = {}
        lines, blocks = [], []
        for start, end in paragraphs(text):
            if "\n" in text[start:end]:
                blocks.append((start, end))
                continue
            lines.append((start, end))
            judged = self.judge(text[start:end])
            if judged is not None:
                found[start, end] = judged
        at = 0
        for start, end in blocks:
            while lines[at][0] < start:
                at += 1
            runs: list[list[tuple[int, int]]] = [[]]
            while at < len(lines) and lines[at][0] < end:
                place = lines[at]
                family = found[place][0] if place in found else "unknown"
                if family != "unknown" and self.named(family, words_of(text[place[0] : place[1]])):
                    runs.append([])
                else:
                    runs[-1].append(place)
                at += 1
            for run in runs:
                if len(run) < 2:
                    continue
                place = (start, end) if len(runs) == 1 else (run[0][0], run[-1][1])
                judged = self.judge(text[place[0] : place[1]])
                if judged is None or (judged[0] == "unknown" and any(r in found for r in run)):
                    continue
                for r in run:
                    if r in found and found[r][0] in ("unknown", judged[0]):
                        del found[r]
                found[place] = judged
        names = ("family", "probability", "agreement")
        return [dict(zip(names, found[place])) | {"start": place[0], "end": place[1]} for place in sorted(found)]


def scan_licenses(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """``doc_id, license, n_found, families, found`` of every document.

    ``license`` is the confirmed family of most paragraphs (the surest of equals),
    ``unknown`` if only such were found, null if none.
    """
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = (
        f"doc_id {kind}, license string, n_found bigint, families array<string>, "
        "found array<struct<family:string,start:bigint,end:bigint,probability:double,agreement:double>>"
    )

    def prepare():
        scanner = Scanner(model)

        def run(columns):
            out = {c: [] for c in ("doc_id", "license", "n_found", "families", "found")}
            for doc_id, text in zip(columns["doc_id"], columns["text"]):
                found = scanner.scan(text)
                sure: dict[str, list[float]] = {}
                for f in found:
                    for family in f["family"].split(" OR "):
                        if family != "unknown":
                            sure.setdefault(family, []).append(f["probability"])
                top = max(sure, key=lambda k: (len(sure[k]), max(sure[k]), k), default=None)
                out["doc_id"].append(doc_id)
                out["license"].append(top or ("unknown" if found else None))
                out["n_found"].append(len(found))
                out["families"].append(sorted(sure))
                out["found"].append(found)
            return out

        return run

    return map_batches(docs.select("doc_id", "text"), schema, prepare)
