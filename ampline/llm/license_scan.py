"""License scans by patience alignment.

A text is held against license notices, word by word. Words that occur once in both the text part and the template
anchor the alignment; the longest increasing subsequence of anchors is kept, and the gaps between them are aligned in
the same way. The share of template words that are aligned is the coverage.

Which texts to align is decided for all templates at once: a text that lacks too many of a template's words can't
reach the coverage. What remains is aligned in windows around each occurrence of the template word that is rarest in
the text, so a notice is found anywhere and however often it is repeated, and a very long text costs no more
than its windows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampline.llm.common import slices, table, words_of

#: License texts and notices as their publishers word them, without titles and copyright lines.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>",
}

_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


@dataclass(frozen=True)
class LicenseConfig:
    coverage: float = 0.85
    templates: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))


def core(word: str) -> str:
    return _EDGE.sub("", word.lower())


def patience(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned (text, template) positions, increasing in both; the recursion is kept on a stack."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        while a < b and c < d and text[a] == template[c]:  # equal ends need no anchor
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        once, again = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if again[w] == 1}
        pairs = [(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place and once[w] == 1]
        if not pairs:
            continue
        tops: list[int] = []  # the last template position of each pile
        heads: list[int] = []
        below = [-1] * len(pairs)
        for k, (_, j) in enumerate(pairs):
            pile = bisect_left(tops, j)
            below[k] = heads[pile - 1] if pile else -1
            if pile == len(tops):
                tops.append(j)
                heads.append(k)
            else:
                tops[pile], heads[pile] = j, k
        chain, k = [], heads[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = below[k]
        chain.reverse()
        out += chain
        edges = [(a - 1, c - 1), *chain, (b, d)]
        todo += [(i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


class Templates:
    """The templates as word numbers, and how often each word stands in each."""

    def __init__(self, config: LicenseConfig):
        self.config, self.names = config, list(config.templates)
        words = [[w for w in map(core, t.split()) if w] for t in config.templates.values()]
        self.number = {w: k for k, w in enumerate(dict.fromkeys(w for t in words for w in t))}
        self.words = [[self.number[w] for w in t] for t in words]
        self.times = np.zeros((len(self.number), len(words)))
        for k, t in enumerate(self.words):
            np.add.at(self.times[:, k], t, 1)
        self.least = np.array([config.coverage * len(t) for t in self.words])

    def best(self, text: np.ndarray, k: int) -> tuple[float, int, int]:
        """(coverage, first word, end word) of the best window of the text (word numbers, -1 for others).

        A notice that reaches the coverage lacks fewer template words than the rarest words tried count, so it holds one
        of these in its place; a window lies around each of their occurrences. Windows start at multiples of
        ``cell`` and are longer by one, so those that start in one cell are one window.
        """
        template = self.words[k]
        n, count = len(template), Counter(text[text >= 0].tolist())
        slack = max(3, n // 4)
        cell = max(1, slack // 2)
        places: dict[int, list[int]] = {}
        for j, w in enumerate(template):
            places.setdefault(w, []).append(j)
        rare = sorted(places, key=lambda w: (count[w], len(places[w]), w))
        top = (0.0, 0, 0)
        spare = n - int(np.ceil(self.least[k] - 1e-9))
        tried, seen = 0, set()
        for w in rare:
            for p in np.flatnonzero(text == w).tolist():
                for at in places[w]:
                    start = (p - at - slack) // cell
                    if start in seen:
                        continue
                    seen.add(start)
                    a, b = max(0, start * cell), min(len(text), start * cell + n + 2 * slack + cell)
                    part = text[a:b]
                    if np.isin(part, template).sum() < max(self.least[k] - 1e-9, top[0] * n):
                        continue  # too few words of the template, in whatever order
                    pairs = patience(part.tolist(), template)
                    if len(pairs) / n > top[0]:
                        top = (len(pairs) / n, a + pairs[0][0], a + pairs[-1][0] + 1)
                    if top[0] == 1:
                        return top
            tried += len(places[w])
            if tried > spare:
                break
        return top


def _scan(templates) -> Callable:
    def run(batches):
        t: Templates = templates.value
        for batch in slices(batches, "text"):
            offsets, codes, vocab = words_of(batch.column("text"))
            number = np.fromiter((t.number.get(core(w), -1) for w in vocab), np.int64, len(vocab))[codes]
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            has = np.zeros((batch.num_rows, len(t.number)), np.float32)
            known = number >= 0
            has[doc[known], number[known]] = 1
            may = has @ t.times.astype(np.float32) >= t.least - 1e-6
            found: list[list[tuple[float, int, int, str]]] = [[] for _ in range(batch.num_rows)]
            for r, k in np.argwhere(may).tolist():
                share, a, b = t.best(number[offsets[r] : offsets[r + 1]], k)
                if share >= t.config.coverage - 1e-9:
                    found[r].append((share, a, b, t.names[k]))
            rows = [sorted(x, key=lambda y: (-len(t.words[t.names.index(y[3])]), y[3])) for x in found]
            columns = [
                pa.array([[y[3] for y in x] for x in rows], pa.list_(pa.string())),
                pa.array([[y[0] for y in x] for x in rows], pa.list_(pa.float64())),
                pa.array([[y[1] for y in x] for x in rows], pa.list_(pa.int64())),
                pa.array([[y[2] for y in x] for x in rows], pa.list_(pa.int64())),
            ]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", "licenses", "coverage", "first_word", "end_word"])

    return run


def scan_licenses(docs: DataFrame, config: LicenseConfig = LicenseConfig()) -> DataFrame:
    """One row per input row: doc_id, licenses, and for each its coverage and the words that it spans; longest template first.

    The arrays are empty where no template reaches the coverage, as for null and empty texts. Words are compared
    lower-cased and without punctuation at their ends. An empty table gives no rows; null ids and repeated rows give a
    row each; further columns are ignored.
    """
    templates = docs.sparkSession.sparkContext.broadcast(Templates(config))
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        _scan(templates), "doc_id long, licenses array<string>, coverage array<double>, first_word array<long>, end_word array<long>"
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "licenses", F.transform("coverage", lambda x: F.round(x, 6)).alias("coverage"), "first_word", "end_word")
