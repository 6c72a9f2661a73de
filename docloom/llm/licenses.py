"""License scans by patience alignment.

A template and a window of a text are aligned like this: words that occur once in
both are anchors; the longest increasing run of anchors is kept; the gaps between
them are aligned in the same way, after equal words at their ends are matched.
Coverage is the share of a template's words that are matched.

A text with coverage c of a template of w words has at least c * w words, and holds
at least one of any w - ceil(c * w) + 1 different words of it, so the template's
longest such words are looked for first, and a text without one of them is passed by.
Each word that occurs once in the template and stands in the text says where the
template would begin; beginnings that lie close together are one window, and every
window is aligned, so a license is found wherever it stands and however often.
Neighbouring windows that each hold too little are aligned again as one, which finds
a license with long insertions.  Of passages that overlap, that with most matched
words counts, then that with the higher coverage: a license that holds another's
text wholly is reported as itself.

Cases: null and empty texts hold nothing; texts of any length are read whole; of
templates with equal words the first by name is reported; repeated documents each
give rows; an empty table gives an empty result; other columns of the input don't
matter, whatever their names.
"""

from __future__ import annotations

import importlib.resources
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, types as T

from docloom.llm.names import col
from docloom.session import ship

COVERAGE = 0.8
#: Words of the templates whose words are looked for in the raw text; for longer ones a text must be long too.
SHORT = 300
WORD = re.compile(r"[^\W_]+(?:[.'’-][^\W_]+)*")

# Notices and short texts of public licenses; the long texts are in license_texts, a file a license.
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "gpl-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
    "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
    'agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF '
    "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    'that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
    "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
    "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
    "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": _BSD_START + _BSD_END,
    "bsd-3-clause": _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. " + _BSD_END,
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
    "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
    "by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
    "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our "
    "heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to "
    'this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
    "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
    "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), ascending in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = longest_increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
        out += anchors
    return sorted(out)


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (ascending by the first) that ascends by the second, by patience piles."""
    tops: list[int] = []
    pile: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(pile[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            pile.append(n)
        else:
            tops[at], pile[at] = j, n
    out, n = [], pile[-1] if pile else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def all_templates() -> dict[str, str]:
    """Short and long templates by name."""
    files = importlib.resources.files("docloom.llm").joinpath("license_texts")
    return TEMPLATES | {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in files.iterdir() if f.name.endswith(".txt")}


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage, self.templates = coverage, []
        told = set()
        for name, text in sorted(templates.items()):
            words = words_of(text)
            if not words or tuple(words) in told:
                continue
            told.add(tuple(words))
            counts = Counter(words)
            # The fewest words, longest first, of which any text with enough coverage holds one.
            least = ceil(coverage * len(words))
            have, keys = 0, []
            for w in sorted(counts, key=lambda w: (-len(w), w)):
                if have > len(words) - least:
                    break
                keys.append(w)
                have += counts[w]
            place = {w: i for i, w in enumerate(words) if counts[w] == 1}
            self.templates.append((name, words, least, frozenset(keys), place))
        self.short = sorted({k for _, words, _, keys, _ in self.templates if len(words) <= SHORT for k in keys})
        self.long = min((2 * least - 1 for _, words, least, _, _ in self.templates if len(words) > SHORT), default=None)

    def able(self, low: str) -> tuple[list[tuple], list[str]]:
        """The templates that the text may hold, and its words if there are any."""
        seen = {k for k in self.short if k in low}
        if not seen and (self.long is None or len(low) < self.long):
            return [], []
        words = WORD.findall(low)
        own = set(words)
        return [t for t in self.templates if len(words) >= t[2] and not own.isdisjoint(t[3])], words

    def passages(self, template: tuple, words: list[str], where: dict[str, list[int]]) -> list[tuple[int, int, int]]:
        """(matched words, start, end) of each place that holds the template."""
        _, own, least, _, place = template
        size = len(own)
        slack = max(2, size // 4)
        windows: list[list[int]] = []  # least and greatest beginning
        for s in sorted({p - o for w, o in place.items() for p in where.get(w, ())} or {p - o for o, w in enumerate(own) for p in where.get(w, ())}):
            if windows and s - windows[-1][1] <= slack:
                windows[-1][1] = s
            else:
                windows.append([s, s])

        def hit(first: int, last: int) -> tuple[int, int, int] | None:
            best = None
            for wide in (0, size):  # what is not whole may go on behind an insertion
                low, high = max(0, first - slack - wide), min(len(words), last + size + slack + wide)
                matched = align(own, words[low:high])
                if len(matched) >= (best[0] + 1 if best else least):
                    best = (len(matched), low + matched[0][1], low + matched[-1][1] + 1)
                if not best or best[0] == size:
                    break
            return best

        out, poor = [], []
        for first, last in windows:
            found = hit(first, last)
            if found:
                out.append(found)
            if poor and (found or first - poor[-1][1] > size):
                if len(poor) > 1:
                    out.append(hit(poor[0][0], poor[-1][1]))
                poor = []
            if not found:
                poor.append((first, last))
        if len(poor) > 1:
            out.append(hit(poor[0][0], poor[-1][1]))
        return [x for x in out if x]

    def __call__(self, text: str) -> list[tuple]:
        """(license, coverage, passages, first word, end word) of each template that the text holds, where it does so best."""
        able, words = self.able(text.lower())
        if not able:
            return []
        where: dict[str, list[int]] = {w: [] for t in able for w in t[1]}
        for i, w in enumerate(words):
            if w in where:
                where[w].append(i)
        hits = [(matched, matched / len(t[1]), a, b, t[0]) for t in able for matched, a, b in self.passages(t, words, where)]
        chosen: list[tuple] = []
        starts: list[int] = []  # of the chosen passages, ascending, with their ends
        ends: list[int] = []
        for h in sorted(hits, key=lambda h: (-h[0], -h[1], h[2], h[4])):
            at = bisect_left(starts, h[3])
            if at and ends[at - 1] > h[2]:
                continue
            starts.insert(at, h[2])
            ends.insert(at, h[3])
            chosen.append(h)
        out = {}
        for _, share, a, b, name in chosen:  # the first of a license is its best
            best = out.setdefault(name, [share, 0, a, b])
            best[1] += 1
        return [(name, share, n, a, b) for name, (share, n, a, b) in sorted(out.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, license, coverage, passages, start, stop): each template that a document holds, and where it does so best, in words."""
    ship(docs.sparkSession)
    chosen = docs.sparkSession.sparkContext.broadcast(all_templates() if templates is None else templates)  # a fixed set of texts
    shape = T.StructType(
        [
            T.StructField(ident, docs.schema[ident].dataType),
            T.StructField("license", T.StringType()),
            T.StructField("coverage", T.DoubleType()),
            *(T.StructField(c, T.IntegerType()) for c in ("passages", "start", "stop")),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(chosen.value, coverage)
        for batch in batches:
            rows = [(i, *hit) for i, t in zip(batch["_id"], batch["_text"]) for hit in scanner(t)]
            if rows:
                yield pd.DataFrame(rows, columns=shape.names)

    return docs.select(col(ident).alias("_id"), col(text).alias("_text")).where("_text is not null").mapInPandas(run, shape)
