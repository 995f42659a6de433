"""License scan: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates and texts become words (runs of ASCII letters, digits and bytes from 128 on, lower case).  A template's
word grams are hashed and winnowed: of every window of consecutive grams the smallest hash is kept.  The inverted index
leads from gram to (template, position).  Short templates, whose few winnowed grams an edit may all touch, are indexed
by all their pairs of words instead.  All grams of a text are looked up; hits of a template on near diagonals are
one candidate when they cover enough of its fingerprints.  Around the candidate's diagonal a banded alignment of the
word sequences finds the span and which words match.

Coverage is matched words over the template's words and those inserted between them.  Words that tell one licence from
its siblings - versions, Lesser, Affero, NonCommercial, NoDerivatives, ShareAlike and their short forms - decide: a
template whose own, or whose name, is not all matched is not the text's licence, nor is one between whose words, or
joined to whose span by a point or hyphen, a deciding word stands that it does not have.  Of overlapping spans the one
with more matched words stays.

Defined cases: a null or empty text has no match; a very long text is scanned whole; a template shorter than a gram is
one gram of its own length; repeated or null ids are scanned row by row; an empty table gives an empty result; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

GRAM, WINDOW, BAND = 3, 2, 8
#: Share of a template's fingerprints that makes a candidate; share of its words that makes a match.
CANDIDATE, COVERAGE = 0.25, 0.6

#: Templates of at most so many words are indexed by all their word pairs, and one pair makes a candidate.
SHORT = 16

#: Words that tell licences of one family apart; a number counts too, but for years and a closing zero.
DECIDING = frozenset("lesser library affero noncommercial nc noderivatives noderivs nd sharealike sa clause attribution patent".split())
#: Names of licences, which a template must find in the text too.
NAMED = frozenset("apache mit bsd isc gnu cc commons mozilla mpl unencumbered reserved".split())

#: Templates by licence: short notices as they stand in texts, notices of use, and whole licences where they are short.
#: The public texts of the licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD", "Released under the BSD License."),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("All-rights-reserved", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

_KEEP = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_KEEP).lower().split()


def _hash(gram: tuple[bytes, ...]) -> int:
    return zlib.crc32(b" ".join(gram))


def grams(words: list[bytes], size: int = GRAM) -> list[tuple[bytes, ...]]:
    return [tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]


def winnow(words: list[bytes], size: int = GRAM, window: int = WINDOW) -> list[tuple[tuple[bytes, ...], int]]:
    """The kept (gram, position): in each window the smallest hash, of equal ones the last."""
    own = grams(words, size)
    hashes = [_hash(g) for g in own]
    kept = set()
    for k in range(max(1, len(own) - window + 1)):
        kept.add(min(range(k, min(k + window, len(own))), key=lambda i: (hashes[i], -i)))
    return [(own[k], k) for k in sorted(kept)]


def decides(word: bytes) -> bool:
    """Whether a word tells licences apart: one of DECIDING, or a number of one or two digits but zero."""
    return word.decode("latin-1") in DECIDING or (word.isdigit() and len(word) <= 2 and word.strip(b"0") != b"")


def align(template: list[bytes], words: list[bytes], band: int | None = BAND) -> tuple[int, int, list[tuple[int, int]]]:
    """The span (first, last + 1) in ``words`` and the matched places (template, words) of the best banded alignment.

    The template is aligned whole, ``words`` may overhang at both ends; only cells within ``band`` of the main diagonal,
    as widened by the difference in lengths, are filled; all cells where there is no band.
    """
    wide = max(0, len(words) - len(template))
    band = max(len(template), len(words)) if band is None else band
    low = -1 << 30
    # a cell: score, matches, less the place where the span begins; from where
    before = {j: (0, 0, -j) for j in range(0, min(len(words), wide + band) + 1)}
    back: list[dict] = []
    for i, t in enumerate(template, 1):
        now, came = {}, {}
        for j in range(max(0, i - band), min(len(words), i + wide + band) + 1):
            best, way = (low, 0, 0), 0
            if j and j - 1 in before:
                s, m, b = before[j - 1]
                hit = words[j - 1] == t
                best, way = (s + (2 if hit else -1), m + hit, b if m else 1 - j if hit else -j), 2 if hit else 1
            if j in before:
                s, m, b = before[j]
                best, way = max((best, way), ((s - 1, m, b if m else -j), 3))
            if j and j - 1 in now:
                s, m, b = now[j - 1]
                best, way = max((best, way), ((s - 1, m, b if m else -j), 4))
            now[j], came[j] = best, way
        back.append(came)
        before = now
    j = max(before, key=lambda j: (before[j], -j))
    i, matched = len(template), []
    while i:
        way = back[i - 1][j]
        if way == 2:
            matched.append((i - 1, j - 1))
        i, j = i - (way != 4), j - (way != 3)
    matched.reverse()
    return (matched[0][1], matched[-1][1] + 1, matched) if matched else (0, 0, [])


@dataclass(frozen=True)
class Match:
    license: str
    coverage: float
    first: int
    last: int
    matched: int


class Joined:
    """Whether a point or hyphen is all that stands between a word of a text and the one before; places on demand."""

    def __init__(self, data: bytes):
        self.data, self.spans = data, None

    def __call__(self, k: int) -> bool:
        if self.spans is None:
            self.spans = [m.span() for m in _WORD.finditer(self.data)]
        return self.data[self.spans[k - 1][1] : self.spans[k][0]] in (b".", b"-")


class Scanner:
    """Inverted index over templates."""

    def __init__(self, templates=TEMPLATES):
        self.templates = [(name, words_of(text.encode())) for name, text in templates]
        self.index: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
        self.sizes = []
        for k, (_, words) in enumerate(self.templates):
            brief = 2 <= len(words) <= SHORT
            kept = [(g, k) for k, g in enumerate(grams(words, 2))] if brief else winnow(words)
            self.sizes.append(0 if brief else len(kept))
            for gram, at in kept:
                self.index.setdefault(gram, []).append((k, at))
        self.needed = [{k for k, w in enumerate(words) if decides(w) or w.decode("latin-1") in NAMED} for _, words in self.templates]
        self.vocabulary = {w for g in self.index for w in g}
        self.short = sorted({len(g) for g in self.index})

    def candidates(self, words: list[bytes]):
        """(template, diagonal, hits) of clustered hits."""
        known, index = self.vocabulary, self.index
        at = [k for k, w in enumerate(words) if w in known]
        hits: dict[int, list[tuple[int, int]]] = {}
        for size in self.short:
            for x, k in enumerate(at):
                if x + size <= len(at) and at[x + size - 1] == k + size - 1:
                    for t, pos in index.get(tuple(words[k : k + size]), ()):
                        hits.setdefault(t, []).append((k - pos, pos))
        for t, found in hits.items():
            found.sort()
            group: list[tuple[int, int]] = []
            for hit in [*found, None]:
                if group and (hit is None or hit[0] - group[0][0] > BAND):
                    if len({p for _, p in group}) >= max(1, CANDIDATE * self.sizes[t]):
                        yield t, group[0][0], group[-1][0]
                    group = []
                if hit:
                    group.append(hit)

    def fits(self, t: int, words: list[bytes], span: tuple[int, int, list[tuple[int, int]]], joined) -> Match | None:
        """The match of a template that an alignment gives, unless its coverage or a deciding word is against it.

        ``joined``: whether a point or hyphen is all that stands between a word and the one before.
        """
        name, template = self.templates[t]
        first, last, matched = span
        coverage = len(matched) / (len(template) + last - first - len(matched))
        if not matched or coverage < COVERAGE or self.needed[t] - {i for i, _ in matched}:
            return None
        theirs = {j for _, j in matched}
        if any(j not in theirs and decides(words[j]) for j in range(first, last)):
            return None
        if (first and decides(words[first - 1]) and joined(first)) or (last < len(words) and decides(words[last]) and joined(last)):
            return None
        return Match(name, coverage, first, last, len(matched))

    def scan(self, data: bytes) -> list[Match]:
        words = words_of(data)
        found, joined = [], Joined(data)
        for t, low, high in self.candidates(words):
            template = self.templates[t][1]
            spans = [(max(0, low - BAND // 2), min(len(words), high + len(template) + BAND // 2))]
            while spans:  # a short notice may stand several times within a candidate's band
                begin, end = spans.pop()
                if end - begin < COVERAGE * len(template):
                    continue
                a, b, matched = align(template, words[begin:end], BAND + max(0, len(template) - (end - begin)))
                if len(matched) >= COVERAGE * len(template):
                    match = self.fits(t, words, (begin + a, begin + b, [(i, begin + j) for i, j in matched]), joined)
                    if match:
                        found.append(match)
                    spans += [(begin, begin + a), (begin + b, end)]
        found.sort(key=lambda m: (-m.matched, -m.coverage, m.first, m.license))
        kept: list[Match] = []
        for m in found:  # spans that stay do not overlap, so only the neighbours need a look
            at = bisect.bisect_left(kept, m.first, key=lambda k: k.first)
            if (at == len(kept) or kept[at].first >= m.last) and (not at or kept[at - 1].last <= m.first):
                kept.insert(at, m)
        return kept


SCHEMA = "doc_id long, n_matches int, licenses string, coverage double, span_start long, span_end long, matches array<struct<license:string,coverage:double,start:long,end:long>>"


def _row(text: str | None, scanner: Scanner):
    data = (text or "").encode("utf-8", "surrogatepass")
    found = scanner.scan(data)
    if not found:
        return 0, None, None, None, None, []
    spans = [m.span() for m in _WORD.finditer(data)]
    place, chars, last = {}, 0, 0  # characters before a byte, counted once along the text
    for at in sorted({x for m in found for x in (spans[m.first][0], spans[m.last - 1][1])}):
        chars += len(data[last:at].decode("utf-8", "surrogatepass"))
        place[at], last = chars, at
    out = [{"license": m.license, "coverage": round(m.coverage, 6), "start": place[spans[m.first][0]], "end": place[spans[m.last - 1][1]]} for m in found]
    best = max(out, key=lambda m: (m["coverage"], m["end"] - m["start"], -m["start"]))
    return len(out), ",".join(sorted({m["license"] for m in out})), best["coverage"], best["start"], best["end"], out


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """A row per document: number of matches, licences, the best match's coverage and span (characters), all matches.

    No shuffle; the index is as small as its templates.
    """
    require(docs, ("doc_id", "text"))

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            rows = [_row(t.as_py(), scanner) for t in batch.column(1)]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    match = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
    types = [pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(match)]
    names = ["doc_id", "n_matches", "licenses", "coverage", "span_start", "span_end", "matches"]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, with all matches."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
