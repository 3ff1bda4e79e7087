"""License scan by patience alignment.

Words that are unique to both the text and a template anchor the alignment; the longest increasing
subsequence of anchors is kept, and the gaps between them are aligned in the same way, down to gaps without anchors, of which
the longest common subsequence is taken. The ends of a region are not tied to the template's: before the first anchor
and after the last one only the nearest words count. Coverage is the share of the template's words that are aligned.

A template is found in a stretch of at most SPREAD times its length if its coverage is reached there, the words that tell it from similar ones
(a name, a version) are aligned, and words that make it another license don't stand between. Of matches that overlap only the best stays,
beside those that stand there word for word. Where a template could be found is settled without loss first: at least so many of its telling
words must lie within that length.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.common import LOWER, lean, pick, slices, span_hash, spans, table

COVERAGE = 0.8
#: Aligned words lie within so many template lengths of each other.
SPREAD = 2
#: Templates of up to so many words are notices, which differ from others in a word.
NOTICE = 32

_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3RD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause-notice": "Released under the 3-Clause BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced or transmitted in any form without written permission.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies."
    ),
    "BSD-2-Clause": _BSD_2 + _BSD_WARRANTY,
    "BSD-2-Clause-conditions": _BSD_2,
    "BSD-3-Clause": _BSD_2 + _BSD_3RD + _BSD_WARRANTY,
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed "
        "or altered from any source distribution."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}
# Words that a notice must hold to be this license, and words that make it another one.
REQUIRED: dict[str, str] = {
    "MIT-notice": "mit", "MIT-notice-2": "mit", "Apache-2.0-notice": "apache 2", "GPL-3.0-notice": "general public 3", "GPL-2.0-notice": "general public 2", "LGPL-3.0-notice": "lesser general public 3",
    "AGPL-3.0-notice": "affero general public 3", "MPL-2.0-notice": "mozilla public 2", "BSD-3-Clause-notice": "3 clause bsd", "CC-BY-4.0": "cc by 4", "CC-BY-SA-4.0": "cc by sa 4",
    "CC-BY-NC-4.0": "cc by nc 4", "CC-BY-ND-4.0": "cc by nd 4", "CC-BY-NC-SA-4.0": "cc by nc sa 4", "CC-BY-NC-ND-4.0": "cc by nc nd 4", "BSD-3-Clause": "endorse",
}
EXCLUDED: dict[str, str] = {
    "GPL-3.0-notice": "affero lesser", "GPL-2.0-notice": "affero lesser library", "GPL-header": "affero lesser", "CC-BY-4.0": "nc nd sa", "CC-BY-SA-4.0": "nc nd", "CC-BY-NC-4.0": "nd sa", "CC-BY-ND-4.0": "nc sa",
    "CC-BY-NC-SA-4.0": "nd", "CC-BY-NC-ND-4.0": "sa", "BSD-2-Clause": "endorse",
}
_COMMON = frozenset("the a an of to in and or is are be by for with on at as it its this that any all you your not no may from under which 0 1 2 3 4".split())
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_TABLE_BITS = 20


def words(text: str) -> list[str]:
    """Lower-cased runs of ASCII letters, digits and bytes beyond ASCII."""
    return [w.decode("utf-8", "replace") for w in re.findall(rb"[0-9a-z\x80-\xff]+", LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes())]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence, increasing in the second place, of pairs sorted by the first."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect.bisect_left(tops, b)
        before[i] = ends[k - 1] if k else -1
        tops[k : k + 1], ends[k : k + 1] = [b], [i]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned index pairs of a and b, increasing in both. a's ends are not tied to b's."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b), False, False)]  # a gap, and whether an anchor lies before and after it
    while stack:
        alo, ahi, blo, bhi, before, after = stack.pop()
        ca, cb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        where = {w: j for j, w in enumerate(b[blo:bhi], blo) if cb[w] == 1}
        anchors = increasing([(i, where[w]) for i, w in enumerate(a[alo:ahi], alo) if ca[w] == 1 and w in where])
        if not anchors:
            out += _common(a, alo, ahi, b, blo, bhi)
            continue
        out += anchors
        edges = [(alo - 1, blo - 1), *anchors, (ahi, bhi)]
        for k, ((p, r), (q, s)) in enumerate(zip(edges[:-1], edges[1:])):
            first, last, reach = k == 0 and not before, k == len(anchors) and not after, SPREAD * (s - r)
            lo, hi = (max(p + 1, q - reach) if first else p + 1), (min(q, p + reach) if last else q)
            if hi > lo and s > r + 1:
                stack.append((lo, hi, r + 1, s, not first, not last))
    return sorted(out)


def _common(a: list[str], alo: int, ahi: int, b: list[str], blo: int, bhi: int) -> list[tuple[int, int]]:
    """The longest common subsequence of a gap: the longest increasing one of all its pairs of equal words."""
    places: dict[str, list[int]] = {}
    for k in range(bhi - 1, blo - 1, -1):
        places.setdefault(b[k], []).append(k)
    return increasing([(i, k) for i in range(alo, ahi) for k in places.get(a[i], ())])


def _heaviest(a: list[str], b: list[str], heavy: frozenset[str]) -> list[tuple[int, int]]:
    """The common subsequence with most heavy words, and of those the longest."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], below[j + 1] + (len(b) + 1 if a[i] in heavy else 1) if a[i] == b[j] else 0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b) and best[i][j]:
        if best[i][j] == best[i][j + 1]:
            j += 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            out.append((i, j))
            i, j = i + 1, j + 1
    return out


@dataclass
class Template:
    name: str
    words: list[str]
    need: int  # telling words that a match within SPREAD lengths must hold
    required: frozenset[str] = frozenset()
    excluded: frozenset[str] = frozenset()


class Scanner:
    """Which templates reach the coverage, and where."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE) -> None:
        self.coverage = coverage
        self.templates: list[Template] = []
        if len(templates) > 64:
            raise ValueError("at most 64 templates in a scanner; scan further ones with another")
        table_ = np.zeros(1 << _TABLE_BITS, np.uint64)
        for k, (name, text) in enumerate(templates.items()):
            tokens = words(text)
            spare = len(tokens) - int(np.ceil(coverage * len(tokens) - 1e-9))
            telling = [w for w in tokens if w not in _COMMON]
            if len(telling) <= spare:
                telling = tokens
            vocabulary = sorted(set(telling))
            raw = [w.encode() for w in vocabulary]
            e = np.cumsum([len(w) for w in raw])
            h = span_hash(np.frombuffer(b"".join(raw), np.uint8), e - [len(w) for w in raw], e)
            table_[h >> np.uint64(64 - _TABLE_BITS)] |= np.uint64(1 << k)
            self.templates.append(Template(name, tokens, max(1, len(telling) - spare), frozenset(REQUIRED.get(name, "").split()), frozenset(EXCLUDED.get(name, "").split())))
        self.table = table_

    def scan(self, data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[float, int, str, int, int]]]:
        """By document: (coverage, -template length, name, first word, word after the last) of matches, the best first."""
        low = LOWER[data]
        s, e, firsts = spans(_WORD[low], off)
        out: dict[int, list] = {}
        if not len(s):
            return out
        marks = self.table[span_hash(low, s, e) >> np.uint64(64 - _TABLE_BITS)]
        some = np.flatnonzero(marks)
        held = marks[some]
        doc = np.searchsorted(firsts, some, "right") - 1
        for k, t in enumerate(self.templates):
            at = np.flatnonzero(held & np.uint64(1 << k))
            if len(at) < t.need:
                continue
            place, owner = some[at], doc[at]
            width = SPREAD * len(t.words)
            first, last = place[: len(place) - t.need + 1], place[t.need - 1 :]
            good = (last - first < width) & (owner[: len(first)] == owner[t.need - 1 :])
            regions: list[list[int]] = []
            for p, q, d in zip(first[good].tolist(), last[good].tolist(), owner[: len(first)][good].tolist()):
                lo, hi = max(int(firsts[d]), p - width), min(int(firsts[d + 1]), q + width)
                if regions and regions[-1][2] == d and lo <= regions[-1][1]:
                    regions[-1][1] = max(regions[-1][1], hi)
                else:
                    regions.append([lo, hi, d])
            for lo, hi, d in regions:
                text = [low[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(s[lo:hi].tolist(), e[lo:hi].tolist())]
                base = lo - int(firsts[d])
                for share, a, b, whole in self.matches(t, text):
                    out.setdefault(d, []).append((share, -len(t.words), t.name, base + a, base + b, whole))
        return {d: kept for d, found in out.items() if (kept := _settled(found))}

    def matches(self, t: Template, text: list[str]) -> list[tuple[float, int, int, bool]]:
        """(coverage, first word, word after the last, word for word) of the template's best stretch of the text, if it is one of this license."""
        width = SPREAD * len(t.words)
        own = set(t.words)
        # stretches overlap, so that each holds every match that starts in its first half; where a text repeats itself short ones find what
        # anchors miss, and a notice is looked for from each of its words on in the end, by a common subsequence with its required words
        short = [k for k, w in enumerate(text) if w in own] if len(t.words) <= NOTICE else []
        for length, starts, align in (
            (2 * width, range(0, max(1, len(text) - width), width), patience),
            (width, range(0, len(text), max(1, len(t.words) // 4)), patience),
            (width, short, lambda a, b: _heaviest(a, b, t.required)),
        ):
            best = (0.0, 0, 0, False)
            for start in starts:
                pairs = align(text[start : start + length], t.words)
                lo = 0
                for hi in range(len(pairs)):
                    while pairs[hi][0] - pairs[lo][0] >= width:
                        lo += 1
                    share = (hi - lo + 1) / len(t.words)
                    if share < self.coverage or share <= best[0]:
                        continue
                    a, b = start + pairs[lo][0], start + pairs[hi][0] + 1
                    if t.required <= {t.words[j] for _, j in pairs[lo : hi + 1]} and not (t.excluded and t.excluded & set(text[a:b])):
                        best = (share, a, b, share == 1 and b - a == len(t.words))
            if best[0]:
                return [best]
        return []


def _settled(found: list[tuple]) -> list[tuple]:
    """Matches, the best first: of those that overlap only the best, and what stands there word for word."""
    found.sort(key=lambda m: (round(m[0] * m[1]), -m[0], m[2], m[3]))  # most aligned words first
    kept: list[tuple] = []
    for m in found:
        if m[5] or all(m[4] <= k[3] or k[4] <= m[3] for k in kept):
            kept.append(m)
    return kept


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word, licenses) for every row of docs(doc_id, text).

    license is the template with most words aligned (the best covered, then the first by name, of equals), with its coverage and
    the range of words that it spans; licenses lists all that are found, by name. Null, empty and
    other texts without a match have null, 0.0, null, null and an empty string. Repeated rows each get a row.
    """
    named = list((TEMPLATES if templates is None else templates).items())
    shared = docs.sparkSession.sparkContext.broadcast([Scanner(dict(named[k : k + 64]), coverage) for k in range(0, len(named), 64)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches, limit=1 << 20):
            found = shared.value[0].scan(data, off) if shared.value else {}
            for scanner in shared.value[1:]:
                for d, more in scanner.scan(data, off).items():
                    found[d] = _settled(found.get(d, []) + more)
            n = rows.num_rows
            best = [found[i][0] if i in found else None for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([m and m[2] for m in best], pa.string()), pa.array([m[0] if m else 0.0 for m in best]), pa.array([m and m[3] for m in best], pa.int64()), pa.array([m and m[4] - 1 for m in best], pa.int64()), pa.array([",".join(sorted({m[2] for m in found.get(i, ())})) for i in range(n)], pa.string())],
                names=["doc_id", "license", "coverage", "first_word", "last_word", "licenses"],
            )

    return pick(docs, "doc_id", "text").mapInArrow(lean(scan), "doc_id bigint, license string, coverage double, first_word bigint, last_word bigint, licenses string")


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """The license of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))
