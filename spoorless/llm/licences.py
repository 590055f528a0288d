"""Licence scans: windows of words against licence templates, by the Dice coefficient of word bigrams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load

#: A window of words is a licence notice from this Dice coefficient on.
DICE = 0.8
#: Cells of the tables of windows (a start by a length) that are made at once.
CELLS = 1 << 20

# The usual wording of notices and headers, by SPDX identifier.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0"],
    "MIT": ["the MIT License", "the terms of the MIT License"],
    "ISC": ["the ISC License"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "GPL": ["the GNU General Public License"],
    "GPL-2.0": ["the GNU General Public License, version 2"],
    "GPL-3.0": ["the GNU General Public License, version 3"],
    "LGPL": ["the GNU Lesser General Public License"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "AGPL": ["the GNU Affero General Public License"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "Unlicense": ["the Unlicense"],
    "Zlib": ["the zlib License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0"],
}
OPENINGS = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is licensed under {}."]
TAG = "SPDX-License-Identifier"
_GNU_END = "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
_GNU = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {{}} {_GNU_END}"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEXTS = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "BSD-2-Clause": [f"{_BSD} {_BSD_END}"],
    "BSD-3-Clause": [f"{_BSD} {_BSD_NAMES} {_BSD_END}"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-2.0": [_GNU.format("General Public License", "2", "General Public License")],
    "GPL-3.0": [_GNU.format("General Public License", "3", "General Public License")],
    "LGPL-2.1": [_GNU.format("Lesser General Public License", "2.1", "Lesser General Public License")],
    "LGPL-3.0": [_GNU.format("Lesser General Public License", "3", "Lesser General Public License")],
    "AGPL-3.0": [_GNU.format("Affero General Public License", "3", "Affero General Public License")],
    "CC0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}

_WORD = re.compile(r"spdx-license-identifier|[^\W_]+(?:\.\d+)*")


def normal_words(text: str) -> list[str]:
    """Lower-cased words and version numbers; marks, white space and a British spelling don't count. A tag's name is one word."""
    return ["license" if w == "licence" else "licensed" if w == "licenced" else w for w in _WORD.findall(text.lower())]


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    return 2 * sum((a & b).values()) / max(1, a.total() + b.total())


@dataclass
class Template:
    licence: str
    grams: Counter
    least: int  # bigrams that a text must have, and may have, to reach the threshold
    most: int
    times: np.ndarray  # how often it has each known bigram; the last entry, of unknown ones, is 0
    telling: np.ndarray  # which ones no other licence's templates have; all of its own, if there are none


class Scanner:
    """Templates, and the bigrams of which any text that is like a template holds at least one."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float = DICE):
        self.threshold = threshold
        counted = [(licence, bigrams(normal_words(text))) for licence, text in templates]
        use = Counter(g for _, grams in counted for g in grams)
        self.known = {g: i for i, g in enumerate(use)}
        licences: dict[tuple[str, str], set[str]] = {}
        for licence, grams in counted:
            for g in grams:
                licences.setdefault(g, set()).add(licence)
        share = Fraction(str(threshold)) / (2 - Fraction(str(threshold)))
        self.templates: list[Template] = []
        self.anchors: dict[int, list[int]] = {}
        for k, (licence, grams) in enumerate(counted):
            n = grams.total()
            times = np.zeros(len(use) + 1, np.int64)
            times[[self.known[g] for g in grams]] = list(grams.values())
            telling = np.zeros(len(use) + 1, bool)
            telling[[self.known[g] for g in grams if len(licences[g]) == 1] or [self.known[g] for g in grams]] = True
            # a like text has, and shares, at least d |T| / (2 - d) bigrams, so one of any others left and one more
            least = ceil(share * n)
            self.templates.append(Template(licence, grams, least, int(n / share), times, telling))
            spare = n - least + 1
            for gram in sorted(grams.elements(), key=lambda g: (use[g], g))[:spare]:
                if k not in self.anchors.setdefault(self.known[gram], []):
                    self.anchors[self.known[gram]].append(k)

    def scan(self, text: str | None) -> list[tuple[int, int, str, float, int, int]]:
        """(first line, lines, licence, Dice, first word, words) of each notice, by place.

        A window may begin and end at any word of the text, whatever lines it lies in. It is compared only
        with templates that its size and an anchor allow, and it must share a bigram that tells their licence from
        all others', as "licensed under the terms of the" is of none. Each beginning has its likest window, and the longest
        of equal ones, for each template; of windows that share words the likest stays, then the longest.
        """
        lower = (text or "").lower()
        words = normal_words(lower)
        unknown = len(self.known)
        ids = np.fromiter((self.known.get(g, unknown) for g in zip(words, words[1:], strict=False)), np.int64, max(0, len(words) - 1))
        hit = sorted({k for gram in np.unique(ids).tolist() for k in self.anchors.get(gram, ())})
        found = [window for k in hit for window in self.windows(self.templates[k], ids)]
        if not found:
            return []
        line_of = np.repeat(*map(np.array, zip(*((k, len(normal_words(line))) for k, line in enumerate(lower.split("\n"))), strict=True)))
        out, taken = [], np.zeros(len(words), bool)
        for d, less, begin, licence in sorted(found):
            end = begin - less
            if not taken[begin : end + 1].any():
                taken[begin : end + 1] = True
                out.append((int(line_of[begin]), int(line_of[end] - line_of[begin]) + 1, licence, -d, begin, end - begin + 1))
        return sorted(out, key=lambda x: x[4])

    def windows(self, t: Template, ids: np.ndarray) -> Iterator[tuple[float, int, int, str]]:
        """(minus Dice, minus bigrams, first word, licence) of the likest window of each beginning.

        A likest window begins and ends with a bigram of the template: without others at its ends it is liker.
        The p-th bigram counts as shared unless the template has it k times and the k before it are in the window, too.
        """
        times = t.times[ids]
        inside = np.flatnonzero(times)
        order = np.argsort(ids[inside], kind="stable")
        ranked = inside[order]
        behind = np.arange(len(ranked)) - times[ranked]
        same = (behind >= 0) & (ids[ranked[np.maximum(behind, 0)]] == ids[ranked])
        before = np.full(len(ids) + t.most, len(ids), np.int64)  # of other bigrams: never shared
        before[ranked] = np.where(same, ranked[np.maximum(behind, 0)], -1)
        told = np.append(np.flatnonzero(t.telling[ids]), len(ids) + t.most)
        reach = told[np.searchsorted(told, inside)] - inside  # a window must reach a telling bigram
        starts, reach = inside[reach < t.most], reach[reach < t.most]
        lengths = np.arange(1, t.most + 1)
        step = max(1, CELLS // t.most)
        for k in range(0, len(starts), step):
            begin, first = starts[k : k + step, None], reach[k : k + step, None]
            counts = before[begin + lengths - 1] < begin
            d = 2 * np.cumsum(counts, 1) / (lengths + t.grams.total())
            d[(lengths < t.least) | (lengths <= first) | ~counts | (begin + lengths > len(ids))] = 0
            last = t.most - 1 - d[:, ::-1].argmax(1)
            best = d[np.arange(len(d)), last]
            for i in np.flatnonzero(best >= self.threshold).tolist():
                yield -float(best[i]), -int(lengths[last[i]]), int(begin[i, 0]), t.licence


def standard_templates() -> list[tuple[str, str]]:
    notices = [(licence, opening.format(name)) for licence, names in NAMES.items() for name in names for opening in OPENINGS]
    tags = [(licence, f"{TAG}: {licence}") for licence in NAMES]
    return notices + tags + [(licence, text) for licence, texts in TEXTS.items() for text in texts]


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = DICE) -> DataFrame:
    """Licence notices in every whole text of ``doc_id, text``.

    Returns a row a document: ``doc_id, licence`` (of the likest notice; null if there is none), ``dice``
    (its coefficient, 0.0 if none), ``n_notices`` and ``notices``, an array of (first_line, n_lines, licence,
    dice, first_word, n_words) by place. A notice may share its line with other text. A row without an id is scanned as any other. Null and empty texts have none; repeated rows are scanned each; other columns are not
    read; an empty table gives no rows.
    """
    given = standard_templates() if templates is None else templates
    notice = pa.struct([("first_line", pa.int32()), ("n_lines", pa.int32()), ("licence", pa.string()), ("dice", pa.float64()), ("first_word", pa.int32()), ("n_words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given, threshold)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            best = [max(f, key=lambda x: (x[3], -x[0])) if f else (0, 0, None, 0.0) for f in found]
            notices = [[dict(zip(("first_line", "n_lines", "licence", "dice", "first_word", "n_words"), x, strict=True)) for x in f] for f in found]
            columns = [batch.column(0), pa.array([b[2] for b in best], pa.string()), pa.array([b[3] for b in best], pa.float64()), pa.array([len(f) for f in found], pa.int32()), pa.array(notices, pa.list_(notice))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "licence", "dice", "n_notices", "notices"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, licence string, dice double, n_notices int, notices array<struct<first_line: int, n_lines: int, licence: string, dice: double, first_word: int, n_words: int>>")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))
