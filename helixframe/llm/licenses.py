"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

A document is compared as a whole, paragraph by paragraph and line by line; a template whose number of bigrams
rules out the wanted coefficient is never compared. Where none of these units matches a template, or
only part of the match, any run of words may: each template's best disjoint windows are reported as passages, so that a notice is found over several
paragraphs, amid code or prose, or within a line. A window that reaches the coefficient is reported or overlaps
a match of the same template.

Contract: null and empty texts match nothing; texts of one word have no bigram and match nothing; several templates
may match one span, each is reported and the best of a span marked (all of them on a tie); a passage is best if no
match that shares over half of the longer span has a higher coefficient; repeated rows are reported each; an empty table gives
an empty result; columns other than doc_id and text are never read. start and end are code points.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import best_disjoint, ship, table
from .license_texts import TEXTS

LEAST = 0.8

#: Licence notices as authors put them into files, from the licences' own "how to apply" sections and common use.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under CC0 1.0 Universal."),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",),
}

#: The complete texts come after the notices.
TEMPLATES |= {name: (*TEMPLATES.get(name, ()), text) for name, text in TEXTS.items()}

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def _lower(text: str) -> str:
    return text.lower().replace("licence", "license")


def normalise(text: str) -> list[str]:
    """Words in lower case without punctuation; comment marks and quotes fall away, version numbers stay whole."""
    return _WORD.findall(_lower(text))


def word_spans(text: str) -> tuple[list[int], list[int]]:
    """Where each word of normalise() starts and ends in the text."""
    spans = [m.span() for m in _WORD.finditer(_lower(text))]
    # the only character that is longer in lower case (by one)
    longer = [i + k for k, i in enumerate(i for i, c in enumerate(text) if c == "\u0130")] if "\u0130" in text else []
    return [a - bisect_left(longer, a) for a, _ in spans], [b - bisect_left(longer, b - 1) for _, b in spans]


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    """Twice the common bigrams over all bigrams, repeats counted."""
    total = sum(a.values()) + sum(b.values())
    return 2 * sum(min(n, b[g]) for g, n in a.items() if g in b) / total if total else 0.0


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST):
        self.least = least
        self.templates = sorted((sum(b.values()), name, k, b) for name, texts in templates.items() for k, t in enumerate(texts) if (b := bigrams(normalise(t))))
        self.known = {g for _, _, _, b in self.templates for g in b}
        self.smallest = min((n for n, *_ in self.templates), default=0)
        self.largest = max((n for n, *_ in self.templates), default=-1)
        #: Dice d needs sizes whose ratio is at least d / (2 - d).
        self.ratio = least / (2 - least)
        #: Bigram to the templates that hold it; bigrams a match has in common with a template at least, and has at most.
        holders = defaultdict(list)
        for t, (_, _, _, b) in enumerate(self.templates):
            for g in b:
                holders[g].append(t)
        self.holders = dict(holders)
        self.needed = [max(1, math.ceil(n * self.ratio - 1e-9)) for n, *_ in self.templates]
        self.most = [math.floor(n / self.ratio + 1e-9) for n, *_ in self.templates]

    def unit(self, words: list[str]) -> list[tuple[str, int, float]]:
        """(licence, template number, coefficient) of all templates that match these words."""
        n = len(words) - 1
        if n < self.smallest * self.ratio or n > self.largest / self.ratio:
            return []
        # at least d / 2 x (n + template) >= d / 2 x n bigrams must be ones that templates have
        if 2 * sum(map(self.known.__contains__, zip(words, words[1:], strict=False))) < self.least * n:
            return []
        own = bigrams(words)
        found = []
        for size, name, k, b in self.templates:
            if size * self.ratio <= n and n * self.ratio <= size and (d := dice(own, b)) >= self.least:
                found.append((name, k, d))
        return found

    def near(self, pairs: list[tuple[str, str]]) -> dict[int, list[int]]:
        """Template to the positions of its bigrams, where these bigrams could hold a match of it."""
        at = [i for i, g in enumerate(pairs) if g in self.holders]
        if len(at) < min(self.needed, default=1):
            return {}
        counts, common, places = Counter(pairs[i] for i in at), Counter(), defaultdict(list)
        for g, n in counts.items():
            for t in self.holders[g]:
                common[t] += min(n, self.templates[t][3][g])
        possible = {t for t, n in common.items() if n >= self.needed[t]}
        if possible:
            for i in at:
                for t in self.holders[pairs[i]]:
                    if t in possible:
                        places[t].append(i)
        return {t: p for t, p in places.items() if any(b - a < self.most[t] for a, b in zip(p, p[self.needed[t] - 1 :], strict=False))}

    def windows(self, t: int, pairs: list[tuple[str, str]], places: list[int], taken: list[tuple[int, int]]) -> list[tuple[float, int, int]]:
        """Disjoint windows (coefficient, first word, word after the last) that match template t outside the taken ones."""
        size, _, _, b = self.templates[t]
        p, most, needed = np.asarray(places), self.most[t], self.needed[t]
        # a bigram counts in windows that start after its occurrence as many places back as the template has it
        since, seen = np.empty(len(p), np.int64), defaultdict(list)
        for j, i in enumerate(places):
            own = seen[pairs[i]]
            since[j] = own[-b[pairs[i]]] if len(own) >= b[pairs[i]] else -1
            own.append(i)

        def best(start: int, limit: int) -> tuple[float, int] | None:
            first, last = np.searchsorted(p, (start, min(limit - 1, start + most)))
            if last - first < needed:
                return None
            d = 2 * np.cumsum(since[first:last] < start) / (p[first:last] - start + 1 + size)
            k = int(d.argmax())
            return (float(d[k]), int(p[first + k]) + 2) if d[k] >= self.least else None

        starts = p[: len(p) - needed + 1]
        return best_disjoint(best, starts[p[needed - 1 :] - starts < most].tolist(), len(pairs) + 1, taken)

    def passages(self, text: str, pairs: list[tuple[str, str]], near: dict[int, list[int]], found: list[dict]) -> list[dict]:
        """Matches of windows that overlap no unit which matches the same template, or are better and hold over half of it and more."""
        starts, ends = word_spans(text)
        out = []
        for t, places in sorted(near.items()):
            _, name, k, _ = self.templates[t]
            units = [(m["dice"], bisect_right(ends, m["start"]), bisect_left(starts, m["end"])) for m in found if (m["license"], m["template"]) == (name, k)]
            own = self.windows(t, pairs, places, [])
            if units:
                own = [(d, a, b) for d, a, b in own if all(b <= first or last <= a or (d > e and (a < first or last < b) and 2 * (min(b, last) - max(a, first)) > last - first) for e, first, last in units)]
                own += self.windows(t, pairs, places, [(a, b) for _, a, b in (*units, *own)])
            for d, a, b in own:
                out.append({"unit": "passage", "start": starts[a], "end": ends[b - 1], "license": name, "template": k, "dice": d, "best": True})
        for m in out:
            for o in (*found, *out):
                shared = min(m["end"], o["end"]) - max(m["start"], o["start"])
                if o["dice"] > m["dice"] and 2 * shared > max(m["end"] - m["start"], o["end"] - o["start"]):
                    m["best"] = False
        return sorted(out, key=lambda m: (m["start"], m["end"]))

    def scan(self, text: str | None) -> list[dict]:
        """All matches of the whole text, its paragraphs and its lines, then of passages; equal spans are reported once."""
        if not text:
            return []
        words = normalise(text)
        pairs = list(zip(words, words[1:], strict=False))
        near = self.near(pairs)
        if not near:
            return []
        spans = [("document", 0, len(text))]
        at = 0
        for part in re.split(r"(\n[ \t\r]*\n\s*)", text):
            if part.strip() and (at, at + len(part)) != (0, len(text)):
                spans.append(("paragraph", at, at + len(part)))
            at += len(part)
        at = 0
        for part in text.split("\n"):
            if part.strip():
                spans.append(("line", at, at + len(part)))
            at += len(part) + 1
        out, seen = [], set()
        for kind, start, end in spans:
            if (start, end) in seen:
                continue
            seen.add((start, end))
            found = self.unit(normalise(text[start:end]))
            top = max((d for _, _, d in found), default=0.0)
            for name, k, d in found:
                out.append({"unit": kind, "start": start, "end": end, "license": name, "template": k, "dice": d, "best": d == top})
        return out + self.passages(text, pairs, near, out)


FOUND = "doc_id long, unit string, start int, end int, license string, template int, dice double, best boolean"


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.bool_())
        for batch in batches:
            rows = [(doc, *m.values()) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in scanner.scan(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
