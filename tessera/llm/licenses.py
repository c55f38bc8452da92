"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

A template's word GRAM-grams are winnowed (of every WINNOW consecutive hashes the least is kept); the index maps a kept
hash to its places in templates. Where a template of coverage MIN_COVERAGE need not keep a run of words that long, its grams
are shorter or all kept. All grams of a document are looked up; hits of one template on nearby diagonals are a candidate,
which a local alignment within BAND words of the diagonals turns into spans that don't overlap and their coverage: matched
words in parts of the template's. What lies between a candidate's spans is aligned again while it has hits. Candidates below
MIN_COVERAGE are dropped, and a span inside another's of more matched words. Words put between a template's words, unlike
changed ones, can break all its grams; such a notice is not found.

Null and wordless texts have no match. Documents are scanned whole. Repeated rows, extra columns and empty tables pass
through; columns with an output's name are replaced. Of matches with as many words the one of higher coverage wins, then
the first template in order.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import map_columns

GRAM, WINNOW, BAND, MIN_COVERAGE = 3, 2, 8, 0.8
_WORD = re.compile(r"[^\W_]+")

# The texts by which public licences are granted.
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_MIT_END = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'


def _gnu(name: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


_NO_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", _MIT_GRANT, f"{_MIT_GRANT} {_MIT_END}"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _gnu("GNU General Public License", "3"), f"{_gnu('GNU General Public License', '3')} {_NO_WARRANTY}"],
    "GPL-2.0": [_gnu("GNU General Public License", "2").replace("software: you", "software; you")],
    "LGPL-3.0": [_gnu("GNU Lesser General Public License", "3")],
    "LGPL-2.1": [_gnu("GNU Lesser General Public License", "2.1").replace("program", "library").replace("software: you", "software; you")],
    "AGPL-3.0": [_gnu("GNU Affero General Public License", "3")],
    "BSD-2-Clause": [_BSD_2, f"{_BSD_2} {_BSD_END}"],
    "BSD-3-Clause": [f"{_BSD_2} {_BSD_3}", f"{_BSD_2} {_BSD_3} {_BSD_END}"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
}

MATCH = StructType([StructField("license", StringType(), False), StructField("coverage", DoubleType(), False), StructField("matched", IntegerType(), False), StructField("first_word", IntegerType(), False), StructField("last_word", IntegerType(), False), StructField("start", IntegerType(), False), StructField("end", IntegerType(), False)])


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, min_coverage: float = MIN_COVERAGE):
        self.min_coverage = min_coverage
        self.templates = [(name, [w.lower() for w in _WORD.findall(t)]) for name, texts in templates.items() for t in texts]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in self.templates for w in ws}))}
        self.coded = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in self.templates]
        self.needed = [math.ceil(min_coverage * len(words) - 1e-9) for words in self.coded]
        self.index: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, words in enumerate(self.coded):
            if not len(words):
                continue
            run = -(-self.needed[t] // (len(words) - self.needed[t] + 1))  # words in a row that changing the others must leave
            size = min(GRAM, run)
            window = min(WINNOW, run - size + 1)
            hashes = self._grams(words, size)
            kept = {k + int(np.argmin(hashes[k : k + window])) for k in range(max(1, len(hashes) - window + 1))}
            places = self.index.setdefault(size, defaultdict(list))
            for p in sorted(kept):
                places[int(hashes[p])].append((t, p))
        self.hashes = {size: np.array(sorted(places), np.int64) for size, places in self.index.items()}

    def _grams(self, words: np.ndarray, size: int) -> np.ndarray:
        """A number for each gram, equal only for equal grams; the templates' vocabulary is small."""
        n = len(words) - size + 1
        out = np.zeros(max(0, n), np.int64)
        for k in range(size):
            out = out * (len(self.vocabulary) + 1) + words[k : k + len(out)]
        return out

    def scan(self, text: str | None) -> list[dict]:
        words = _WORD.findall(text.lower()) if text else []
        known = self.vocabulary.get
        coded = np.array([known(w, 0) for w in words], np.int64)
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for size, index in self.index.items():
            grams = self._grams(coded, size)
            hits = np.flatnonzero(np.isin(grams, self.hashes[size]))
            for at, h in zip(hits.tolist(), grams[hits].tolist(), strict=True):
                for t, p in index[h]:
                    places[t].append((at - p, at))
        found = [m for t, hits in places.items() for m in self._matches(t, coded, hits)]
        found.sort(key=lambda m: (-m["matched"], -m["coverage"], m["first_word"], m["t"]))
        kept: list[dict] = []
        over: dict[int, int] = {}  # for each word the last word of the kept spans over it
        for m in found:
            if over.get(m["first_word"], -1) < m["last_word"]:
                kept.append(m)
                for w in range(m["first_word"], m["last_word"] + 1):
                    over[w] = max(over.get(w, -1), m["last_word"])
        spots = [m.span() for m in _WORD.finditer(text)] if kept else []
        if len(spots) != len(words):  # lower-casing changed the words' number
            spots = [m.span() for m in _WORD.finditer(text.lower())] if kept else []
        return [{**{k: v for k, v in m.items() if k != "t"}, "start": spots[m["first_word"]][0], "end": spots[m["last_word"]][1]} for m in sorted(kept, key=lambda m: m["first_word"])]

    def _matches(self, t: int, coded: np.ndarray, hits: list[tuple[int, int]]) -> Iterator[dict]:
        """All matches of a template that don't overlap. hits: (diagonal, place in the document)."""
        size, left = len(self.coded[t]), [(0, len(coded), sorted(hits))]
        while left:
            start, end, hits = left.pop()
            cut = [0, *(i for i in range(1, len(hits)) if hits[i][0] - hits[i - 1][0] > BAND), len(hits)]
            for a, b in zip(cut, cut[1:]):
                low, high = hits[a][0], hits[b - 1][0]
                first, last = max(start, low - BAND), min(end, high + size + BAND)
                spans = sorted(self._align(t, coded, low, high, first, last))
                for a_word, b_word, matched in spans:
                    yield {"t": t, "license": self.templates[t][0], "coverage": matched / size, "matched": matched, "first_word": a_word, "last_word": b_word}
                edges = [first, *(x for s in spans for x in (s[0], s[1] + 1)), last]
                if not spans:
                    continue
                by_place = sorted(hits[a:b], key=lambda h: h[1])
                for x, y in zip(edges[::2], edges[1::2]):
                    i, j = (bisect_left(by_place, z, key=lambda h: h[1]) for z in (x, y))
                    if y - x >= self.needed[t] and i < j:
                        left.append((x, y, sorted(by_place[i:j])))

    def _align(self, t: int, coded: np.ndarray, low: int, high: int, first: int, last: int) -> list[tuple[int, int, int]]:
        """(first word, last word, matched): local alignments of the template with words first to last, the best and then the
        next best beside it, on the diagonals low - BAND to high + BAND."""
        template = self.coded[t].tolist()
        doc, width = coded[first:last].tolist(), high - low + 2 * BAND + 1
        present = set(doc)
        if sum(w in present for w in template) < self.needed[t]:
            return []
        shift = low - BAND - first  # column of the band's first cell in row 0
        before: list[tuple] = [(0, 0, 0, 0)] * (width + 2)  # score, matched, first and last document word
        ends: dict[int, tuple] = {}  # the best alignment that ends at each word
        for i, w in enumerate(template):
            row = [(0, 0, 0, 0)] * (width + 2)
            for k in range(1, width + 1):
                j = i + shift + k - 1
                if not 0 <= j < len(doc):
                    continue
                d = before[k]
                if doc[j] == w:
                    cell = (d[0] + 2, d[1] + 1, d[2] if d[0] > 0 else j, j)
                else:
                    cell = max((d[0] - 1, *d[1:]), (before[k + 1][0] - 1, *before[k + 1][1:]), (row[k - 1][0] - 1, *row[k - 1][1:]))
                if cell[0] > 0:
                    row[k] = cell
                    if doc[j] == w and cell[1] >= self.needed[t] and cell > ends.get(j, ()):
                        ends[j] = cell
            before = row
        taken, spans = bytearray(len(doc)), []
        for _, matched, a, b in sorted(ends.values(), reverse=True):
            if not any(taken[a : b + 1]):
                taken[a : b + 1] = b"\x01" * (b + 1 - a)
                spans.append((first + a, first + b, matched))
        return spans


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with matches: license, coverage, matched words, first and last word, and character span, in order of place."""
    templates = templates or TEMPLATES

    def make():
        s = Scanner(templates)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        return lambda texts: [pa.array([s.scan(t) for t in texts.to_pylist()], kind)]

    return map_columns(docs, [text_col], [StructField("matches", ArrayType(MATCH, False), False)], make, () if keep_text else (text_col,))
