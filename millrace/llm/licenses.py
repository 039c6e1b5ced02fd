"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.batches import ALNUM, LOWER, slices, span_hashes, utf8, words

# fixed values: notices as they are met in texts, some of them shortened
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-work": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "Proprietary": "All rights reserved. Do not distribute.",
}
# fixed values: whole license texts and headers, word for word
LICENSES = {
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MIT-license": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public
domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
}
TEMPLATES = {**NOTICES, **LICENSES}
LEAST_COVERAGE = 0.8
SLACK = 3  # words between two aligned ones that cost as much as one aligned word brings
SCALES = (1.25, 2.5, SLACK + 1)  # a notice with that many strange words is at most SLACK + 1 times as long as its template


def read_templates(folder: str) -> dict[str, str]:
    """License texts of a folder, by file name without suffix."""
    return {p.stem: p.read_text(errors="replace") for p in sorted(Path(folder).iterdir()) if p.is_file()}


def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        if at:
            back[i] = piles[at - 1]
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
    out: list[int] = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising on both sides; ``right`` is the template.

    Equal words at both ends are paired. Between them, words that occur once on either side are anchors: the longest
    subsequence of them that rises on both sides is kept, and the gaps between kept anchors are aligned the same way.
    In a gap without such words those that occur once on the right are anchors at all their places on the left, of which
    the subsequence takes one each, the last if several serve; a gap without these either gets a longest common subsequence.
    """
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(left), 0, len(right))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and left[a] == right[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        once, there = Counter(left[a:b]), Counter(right[c:d])
        place = {w: j for j, w in enumerate(right[c:d], c) if there[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(left[a:b], a) if once[w] == 1 and w in place]
        anchors = anchors or [(i, place[w]) for i, w in enumerate(left[a:b], a) if w in place]
        if not anchors:
            pairs += [(a + i, c + j) for i, j in common(left[a:b], right[c:d])]
            continue
        kept = [anchors[i] for i in longest_rising([j for _, j in anchors])]
        pairs += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(pairs)


def densest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The run of pairs that gains most, one for each pair less 1 / SLACK for each word of the text between; then the first.

    A few words of the template far from the notice thus do not stretch its place."""
    best, span, gain, low = 0, (0, 0), 0, 0
    for i, (at, _) in enumerate(pairs):
        gain -= at - pairs[i - 1][0] - 1 if i else 0
        if gain < 0:
            gain, low = 0, i
        gain += SLACK
        if gain > best:
            best, span = gain, (low, i + 1)
    return pairs[span[0] : span[1]]


@dataclass(frozen=True)
class Template:
    name: str
    words: list[int]


def compiled(templates: Mapping[str, str]) -> list[Template]:
    data, offsets = utf8(pa.array(list(templates.values()), type=pa.string()))
    data = LOWER[data]
    starts, ends, rows = words(data, offsets, ALNUM)
    hashes = span_hashes(data, starts, ends)
    return [Template(name, hashes[rows == i].tolist()) for i, name in enumerate(templates)]


def common(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence: one bit a word on the right, one step a word on the left."""
    places: dict[int, int] = {}
    for j, w in enumerate(right):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(right)) - 1
    rows = [full]
    for w in left:
        v = rows[-1]
        u = v & places.get(w, 0)
        rows.append((v + u | v - u) & full)
    held = lambda i, j: j - (rows[i] & (1 << j) - 1).bit_count()
    i, j, pairs = len(left), len(right), []
    while n := held(i, j):
        if held(i - 1, j) == n:
            i -= 1
        elif held(i, j - 1) == n:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def stretches(places: list[int], held: list[int], width: int, need: float) -> Iterator[tuple[int, int]]:
    """Ranges of places that lie within ``width`` words from the first and hold ``need`` distinct words; one for each first place at most."""
    counts: Counter[int] = Counter()
    distinct = high = 0
    for low, at in enumerate(places):
        while high < len(places) and places[high] < at + width:
            distinct += not counts[held[high]]
            counts[held[high]] += 1
            high += 1
        if distinct >= need:
            yield low, high
        counts[held[low]] -= 1
        distinct -= not counts[held[low]]


def best_notice(text: np.ndarray, places: np.ndarray, template: Template, least: float) -> list[tuple[int, int]]:
    """Pairs of places of the best covered notice, or none; of equally covered ones the shortest, then the first.

    Stretches of three lengths are aligned, the tight ones first, as several copies in one stretch leave fewer anchors.
    Any place of a word of the template may begin a notice; a stretch is an eighth longer than the notices it is for, so
    it serves all that begin in this eighth, and the text is aligned about nine times for each length at most. Stretches
    with too few distinct words of the template are left out, which loses nothing.
    """
    words = template.words
    least *= len(words)
    need = least - (len(words) - len(set(words)))
    found: list[tuple[int, int]] = []
    score = (0, 0)
    at, held = places.tolist(), text[places].tolist()
    for scale in SCALES:
        width = math.ceil(scale * len(words))
        hop = max(width // 8, 1)
        free = -1
        for low, high in stretches(at, held, width + hop, need):
            if at[low] < free:
                continue
            free = at[low] + hop
            pairs = densest([(at[low + i], j) for i, j in align(held[low:high], words)])
            if len(pairs) >= least and (new := (len(pairs), pairs[0][0] - pairs[-1][0])) > score:
                found, score = pairs, new
                if score == (len(words), 1 - len(words)):
                    return found
    return found


def _scan(templates: list[Template], least: float):
    vocabulary = np.unique(np.array([w for t in templates for w in t.words], dtype=np.uint64))
    symbols = [Template(t.name, np.searchsorted(vocabulary, np.array(t.words, dtype=np.uint64)).tolist()) for t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            data = LOWER[data]
            starts, ends, rows = words(data, offsets, ALNUM)
            hashes = span_hashes(data, starts, ends)
            symbol = np.searchsorted(vocabulary, hashes)
            known = vocabulary[np.minimum(symbol, len(vocabulary) - 1)] == hashes if len(vocabulary) else np.zeros(len(hashes), dtype=bool)
            counts = np.bincount(rows, minlength=batch.num_rows)
            first = np.cumsum(counts) - counts
            at = np.flatnonzero(known)
            cells = np.zeros((batch.num_rows, len(vocabulary) + 1), dtype=bool)
            cells[rows[at], symbol[at]] = True
            out: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            for template in symbols:
                if not template.words:
                    continue
                distinct = sorted(set(template.words))
                # a notice that reaches the coverage has that share of the template's words
                need = least * len(template.words) - (len(template.words) - len(distinct))
                for r in np.flatnonzero(cells[:, distinct].sum(axis=1) >= need).tolist():
                    own = slice(int(first[r]), int(first[r] + counts[r]))
                    text = np.where(known[own], symbol[own], -1)
                    pairs = best_notice(text, np.flatnonzero(np.isin(text, distinct)), template, least)
                    if pairs:
                        i, j = pairs[0][0], pairs[-1][0]
                        out[r].append((template.name, len(pairs) / len(template.words), int(starts[own][i] - offsets[r]), int(ends[own][j] - offsets[r]), len(pairs)))
            best = [max(f, key=lambda x: (x[1], x[4], x[0]), default=(None, 0.0, None, None)) for f in out]
            names = [sorted(x[0] for x in f) for f in out]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), pa.array([b[2] for b in best], pa.int64()), pa.array([b[3] for b in best], pa.int64()), pa.array([",".join(n) for n in names], pa.string())], names=["doc_id", "license", "coverage", "start_byte", "end_byte", "licenses"])

    return run


def scan(documents: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, license, coverage, start_byte, end_byte and licenses (all found, comma-joined) of every document.

    Words are compared in lower case without punctuation. A template is found if patience alignment pairs at least
    ``least`` of its words in a stretch of the text of up to ``SLACK`` + 1 times its length. The license is the one best
    covered, then the one with most words, then the last by name; its place is the shortest, then the first. Texts of any
    length are looked at whole, in time that grows with their length times the logarithm of a template's. Documents
    without a license, null and empty texts have a null license and coverage 0; templates without words are found
    nowhere; repeated rows come out repeatedly. One pass, no shuffle.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(_scan(compiled(templates), least), f"doc_id {kind}, license string, coverage double, start_byte long, end_byte long, licenses string")
