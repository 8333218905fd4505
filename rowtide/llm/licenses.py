"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Texts and templates are normalised to lower-case words (copyright lines of templates are left out). A document's word
bigrams that occur in any template are its hits; a stretch without hits can't match. For each template with enough hits
the scan takes stretches from each hit on, word by word to each further hit, while the stretch's size stays within
the bounds that the Dice coefficient sets (a set of n bigrams and a template of m can reach t only if
t / (2 - t) * m <= n <= (2 - t) / t * m, of which at most 2 * (1 - t) / t * m are foreign; and a stretch has at most twice as
many words as those of a template of that size), and keeps the best. Where
a stretch begins or ends amid the template, the words of the same line that stand for the template's rest count, too. Otherwise line
breaks don't matter, so a notice amid a line, a text without line feeds and a licence that fills a page are found alike. Stretches of one
template that overlap are one match; its best one counts. A match inside that of a template twice as large is part of it. Of other
templates that match overlapping stretches, the one with the higher score stays (ties: the larger template, then the name).

Work is by document in Arrow batches, without a shuffle; the templates are a fixed list. Null and empty texts have no
matches. Every row gets a result row.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, pick, slices, words_of

THRESHOLD = 0.8
RESULT = "doc_id long, n_matches long, licenses string, best_license string, best_score double, matches array<struct<license:string,score:double,first_line:int,last_line:int>>"

#: Licence texts and notices as their authors publish them.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
    "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-notice": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
    "appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
    "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
    "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
    "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. "
    "If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
    "version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; "
    "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
    "https://mozilla.org/MPL/2.0/.",
    "Unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
    "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
    "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "
    "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
    "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
    "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
    "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
    "altered from any source distribution.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
    "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General "
    "Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either "
    "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General "
    "Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
    "version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General "
    "Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "CC-BY-NC-4.0-long-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0-long-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0-long-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0-long-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-4.0-short-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-short-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-short-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-short-notice": "Licensed under CC BY-NC-ND 4.0.",
    "All-rights-reserved": "All rights reserved.",
}


class Template(NamedTuple):
    name: str
    grams: frozenset[int]
    low: float  #: sizes of stretches that can reach the threshold
    high: float
    most: int  #: words of a stretch, at most
    before: dict[int, int]  #: bigrams before a bigram's first place, and after its last
    after: dict[int, int]


class Templates(NamedTuple):
    words: dict[bytes, int]
    known: np.ndarray  #: sorted bigram codes of all templates
    all: list[Template]


def bigrams(ids: list[int], size: int) -> set[int]:
    return {a * size + b for a, b in zip(ids, ids[1:])}


@lru_cache(4)
def templates(threshold: float = THRESHOLD) -> Templates:
    words: dict[bytes, int] = {}
    texts = {n: [words.setdefault(w, len(words) + 1) for w in words_of(t.encode())] for n, t in TEMPLATES.items()}
    size = len(words) + 1
    made = []
    for name, ids in texts.items():
        grams = frozenset(bigrams(ids, size))
        order = [a * size + b for a, b in zip(ids, ids[1:])]
        before, after = ({g: i for i, g in reversed(list(enumerate(o)))} for o in (order, order[::-1]))
        made.append(Template(name, grams, threshold / (2 - threshold) * len(grams), (2 - threshold) / threshold * len(grams), int(2 * (2 - threshold) / threshold * len(ids)) + 1, before, after))
    return Templates(words, np.array(sorted(set().union(*(t.grams for t in made)))), made)


class Match(NamedTuple):
    license: str
    score: float
    first_line: int
    last_line: int


class Apart:
    """Ranges that don't overlap, by their starts."""

    def __init__(self) -> None:
        self.firsts: list[int] = []
        self.lasts: list[int] = []

    def add(self, first: int, last: int) -> bool:
        """Takes the range in unless it overlaps one."""
        k = bisect_right(self.firsts, last)
        if k and self.lasts[k - 1] >= first:
            return False
        self.firsts.insert(k, first)
        self.lasts.insert(k, last)
        return True

    def holds(self, first: int, last: int) -> bool:
        """Whether one of the ranges contains this one."""
        k = bisect_right(self.firsts, first)
        return k > 0 and self.lasts[k - 1] >= last


def scan(text: bytes, threshold: float = THRESHOLD) -> list[Match]:
    """All matches of a text, by line."""
    known = templates(threshold)
    size = len(known.words) + 1
    lines = [[known.words.get(w, 0) for w in words_of(line)] for line in text.split(b"\n")]
    flat = np.array([i for line in lines for i in line], np.int64)
    if len(flat) < 2:
        return []
    ends = np.cumsum([len(line) for line in lines]).tolist()
    begins = [0, *ends[:-1]]
    codes = flat[:-1] * size + flat[1:]
    hits = np.flatnonzero((flat[:-1] > 0) & (flat[1:] > 0))
    hits = hits[np.isin(codes[hits], known.known)]
    if not len(hits):
        return []
    codes_hit, places = codes[hits].tolist(), hits.tolist()
    distinct = set(codes_hit)
    ids: list[int] = []  # bigrams of all words, by first occurrence
    found: list[tuple[float, int, str, int, int]] = []
    spans: list[tuple[int, Apart]] = []
    for t in known.all:
        count = len(distinct & t.grams)
        if 2 * count < threshold * (count + len(t.grams)) - 1e-9:
            continue
        if not ids:
            words = words_of(text)
            numbers: dict[tuple[bytes, bytes], int] = {}
            ids = [numbers.setdefault(pair, len(numbers)) for pair in zip(words, words[1:])]
        own = {place: code for place, code in zip(places, codes_hit) if code in t.grams}
        mine = {ids[place] for place in own}
        foreign = 2 * (1 - threshold) / threshold * len(t.grams) + 1e-9
        best: list[tuple[float, int, int]] = []
        for first in own:
            start = max(first - t.before[own[first]], begins[bisect_right(ends, first)])
            stretch = set(ids[start:first]) - {ids[first]}
            shared, top = len(stretch & mine), threshold - 1e-9
            for at in range(first, min(len(ids), first + t.most)):
                gram = ids[at]
                if gram in stretch:
                    if gram == ids[first]:
                        break  # what starts at a later hit is shorter and no worse
                    continue
                stretch.add(gram)
                if gram not in mine:
                    if len(stretch) - shared > foreign:
                        break
                    continue
                shared += 1
                if 2 * shared / (len(stretch) + len(t.grams)) < top:
                    continue
                end = min(at + t.after[own[at]], ends[bisect_right(ends, at + 1)] - 2)
                rest = set(ids[at + 1 : end + 1]) - stretch
                if (score := 2 * (shared + len(rest & mine)) / (len(stretch) + len(rest) + len(t.grams))) >= top:
                    best.append((score, start, end + 1))
                    top = score + 1e-12
        best.sort(key=lambda b: (-b[0], b[2] - b[1], b[1]))
        taken = Apart()
        for score, first, last in best:
            if taken.add(first, last):
                found.append((score, len(t.grams), t.name, first, last))
        spans.append((len(t.grams), taken))
    whole = [f for f in found if not any(n >= 2 * f[1] and taken.holds(f[3], f[4]) for n, taken in spans)]
    chosen: list[tuple[float, int, str, int, int]] = []
    apart = Apart()
    for f in sorted(whole, key=lambda f: (-f[0], -f[1], f[2], f[3])):
        if apart.add(f[3], f[4]):
            chosen.append(f)
    line_of = lambda word: bisect_right(ends, word)
    return [Match(name, score, line_of(first), line_of(last)) for score, _, name, first, last in sorted(chosen, key=lambda c: c[3])]


def _scan(threshold: float):
    kind = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = [scan(t, threshold) for t in texts.to_pylist()]
            best = [max(f, key=lambda m: (m.score, -m.first_line)) if f else None for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *keep(batch, ["doc_id"]),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(sorted(Counter(m.license for m in f))) for f in found], pa.string()),
                    pa.array([b and b.license for b in best], pa.string()),
                    pa.array([b and b.score for b in best], pa.float64()),
                    pa.array([[m._asdict() for m in f] for f in found], kind),
                ],
                names=["doc_id", "n_matches", "licenses", "best_license", "best_score", "matches"],
            )

    return run


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs (doc_id, text): how many matches, the licences' names, the best one, and each match's score and lines."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan(threshold), RESULT)
