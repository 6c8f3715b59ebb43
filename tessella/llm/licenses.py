"""License scans by patience alignment.

A text's words are aligned with a template's: words that the other side lacks are left out, equal words at both ends are
matched, words that stand once in both are anchors, the longest increasing subsequence of anchors is kept, and the gaps
between anchors are aligned in the same way. Coverage is the share of the template's words that are matched.

A match is a window of a text, at most twice the template long, whose alignment covers ``least`` of the template. Windows
that begin or end with a foreign word align like those without it, so windows begin and end with template words. Their
bounds are the words that they have in common with the template, counted with their repetitions: only windows whose bound
reaches ``least`` are aligned, in the order of their bounds, until no bound is above the best coverage. So no match is lost
and no coverage is too low. (A text made of a template's words in a wrong order costs an alignment for each such window.)

Templates are few (their size is checked), so they travel with the function; texts are scanned where they lie and never
shuffled. Words are runs of letters and digits in lower case. Null and empty texts have no match; repeated rows each have
theirs; a text has at most one row a template: its window of best coverage, then of greatest bound, then the first and
shortest. An empty table, or no template with a word, gives no row. Only the id and text columns are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import rest

LEAST = 0.8
MOST_TEMPLATE_BYTES = 4 << 20
WORD = regex.compile(r"[\p{L}\p{N}]+")

#: Texts, standard headers and notices of common licences.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause condition": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program.""",
    "LGPL header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software
Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
You should have received a copy of the GNU Lesser General Public License along with this library.""",
    "AGPL header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
You should have received a copy of the GNU Affero General Public License along with this program.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSL-1.0 header": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    at_top: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(at_top[k - 1] if k else -1)
        tops[k : k + 1] = [v]
        at_top[k : k + 1] = [i]
    out, i = [], at_top[-1] if at_top else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both."""
    out, todo = [], [(list(range(len(a))), list(range(len(b))))]
    while todo:
        own, other = todo.pop()  # places of one gap
        words = {b[y] for y in other}
        own = [x for x in own if a[x] in words]
        words = {a[x] for x in own}
        other = [y for y in other if b[y] in words]
        head = 0
        while head < min(len(own), len(other)) and a[own[head]] == b[other[head]]:
            out.append((own[head], other[head]))
            head += 1
        own, other = own[head:], other[head:]
        while own and other and a[own[-1]] == b[other[-1]]:
            out.append((own.pop(), other.pop()))
        if not own or not other:
            continue
        ca, cb = Counter(a[x] for x in own), Counter(b[y] for y in other)
        place = {b[y]: k for k, y in enumerate(other) if cb[b[y]] == 1}
        single = [(k, place[a[x]]) for k, x in enumerate(own) if ca[a[x]] == 1 and a[x] in place]
        anchors = [single[k] for k in increasing([y for _, y in single])]
        if not anchors:
            if head:  # what the head has taken may leave words without a counterpart
                todo.append((own, other))
            continue
        out += [(own[x], other[y]) for x, y in anchors]
        for (p, q), (r, s) in zip([(-1, -1), *anchors], [*anchors, (len(own), len(other))]):
            todo.append((own[p + 1 : r], other[q + 1 : s]))
    return sorted(out)


def needed(template: list[str], least: float) -> int:
    """Fewest matched words that make a coverage of ``least``."""
    return next(n for n in range(1, len(template) + 2) if n / len(template) >= least or n > len(template))


def windows(words: list[str], template: list[str], least: float):
    """(bound, first word, end) of the windows whose bound allows a match, greatest bounds first, then by start and end."""
    wanted, need, room = Counter(template), needed(template, least), 2 * len(template)
    at = [i for i, w in enumerate(words) if w in wanted]
    held, common, hi = Counter(), 0, 0
    starts = []
    for lo, i in enumerate(at):  # which starts have a window with enough of the template's words
        while hi < len(at) and at[hi] - i < room:
            held[words[at[hi]]] += 1
            common += held[words[at[hi]]] <= wanted[words[at[hi]]]
            hi += 1
        if common >= need:
            starts.append((common, lo))
        common -= held[words[i]] <= wanted[words[i]]
        held[words[i]] -= 1
    for bound in range(max((c for c, _ in starts), default=0), need - 1, -1):
        for _, lo in (x for x in starts if x[0] >= bound):
            held, common = Counter(), 0
            for k in range(lo, len(at)):
                if at[k] - at[lo] >= room:
                    break
                w = words[at[k]]
                held[w] += 1
                common += held[w] <= wanted[w]
                if common > bound:
                    break
                if common == bound:
                    yield bound, at[lo], at[k] + 1


def best_match(words: list[str], template: list[str], least: float) -> tuple[float, int, int, int] | None:
    """Coverage, first word, end and number of matched words of the best window."""
    best, count = None, needed(template, least) - 1
    for bound, lo, hi in windows(words, template, least):
        if bound <= count:
            break
        matched = align(words[lo:hi], template)
        if len(matched) > count:
            count = len(matched)
            best = (count / len(template), lo + matched[0][0], lo + matched[-1][0] + 1, count)
    return best


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, template, coverage, first_word, end_word and matched for every template that a text covers."""
    if sum(len(t.encode()) for t in templates.values()) > MOST_TEMPLATE_BYTES:
        raise ValueError("the templates are too large to travel with the function")
    split = {name: words for name, text in templates.items() if (words := words_of(text))}
    # A text that lacks too many of a template's distinct words can't cover it.
    distinct = {name: (set(words), len(words) - needed(words, least)) for name, words in split.items()}

    def match(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py() or "")
                held = set(words)
                for name, template in split.items():
                    own, spare = distinct[name]
                    if len(own - held) > spare:
                        continue
                    if (found := best_match(words, template, least)) is not None:
                        rows.append((doc.as_py(), name, *found))
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["doc_id", "template", "coverage", "first_word", "end_word", "matched"])

    return rest(docs, [id_col], text_col).mapInArrow(match, "doc_id long, template string, coverage double, first_word long, end_word long, matched long")
