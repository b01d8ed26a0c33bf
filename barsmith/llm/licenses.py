"""Licence scans: normalised text against templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Least Dice coefficient of a match.
LEAST = 0.8

#: Public licence texts and the notices by which works name them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
)
#: Whole licence texts, one file each, named by the licence.
TEMPLATES += tuple((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licences").glob("*.txt")))
#: Words that make another licence of a like text: a stretch must hold just those of its template.
MODIFIERS = {"lesser", "affero", "noncommercial", "sharealike", "noderivatives", "nc", "sa", "nd"}
#: Numbers in templates of at most so many words are versions, which a stretch must hold; longer ones number their clauses.
NOTICE = 120
#: Templates of more bigrams are whole licences, whose bigrams are sought only in texts that hold enough of their words.
LONG = 400
_WORD = re.compile(r"[^\W_]+")


def normal_words(text: str) -> list[str]:
    """Lower-case words of letters and digits; everything else separates."""
    return _WORD.findall(text.lower())


def versions(words: list[str]) -> set[str]:
    """The version numbers that a template's words name."""
    return {w for w in words if w.isdigit()} if len(words) <= NOTICE else set()


class Scanner:
    """Finds, for each template, the stretch of a text with the largest Dice coefficient of word bigrams."""

    def __init__(self, templates: tuple = TEMPLATES, least: float = LEAST):
        self.least = least
        self.words: dict[str, int] = {}
        self.templates, self.marks = [], []
        for name, text in templates:
            held = normal_words(text)
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in held]
            self.templates.append((name, ids))
            self.marks.append((versions(held), MODIFIERS & set(held)))
        self.base = len(self.words) + 1
        self.templates = [(name, Counter(a * self.base + b for a, b in zip(ids, ids[1:], strict=False))) for name, ids in self.templates]
        self.sizes = [bag.total() for _, bag in self.templates]
        self.keys = [np.array(sorted(bag), np.int64) for _, bag in self.templates]
        self.codes = [np.unique(np.concatenate([k for k, n in zip(self.keys, self.sizes, strict=True) if (n > LONG) == long] or [np.zeros(0, np.int64)])) for long in (False, True)]

    def scan(self, text: str | None) -> list[tuple[float, int, int, int]]:
        """(Dice, first word, words, template) of each template's best stretch, if it reaches ``least``.

        A stretch of n bigrams can reach it only if n lies between b*least/(2-least) and b*(2-least)/least for a template
        of b, and shares least*(n+b)/2 of them or more: templates and stretches outside these bounds are left out, and a
        best stretch starts and ends with a shared bigram, so nothing else is lost. A stretch must hold its template's
        version numbers and just its modifiers.
        """
        words = normal_words(text or "")
        if len(words) < 2:
            return []
        get = self.words.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        codes = np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] * self.base + ids[1:], -1)
        known = np.flatnonzero(codes >= 0)
        places = known[np.isin(codes[known], self.codes[0])]
        whole = None
        out = []
        for t, (_, bag) in enumerate(self.templates):
            b = bag.total()
            low, high = int(np.ceil(b * self.least / (2 - self.least) - 1e-9)), int(b * (2 - self.least) / self.least + 1e-9)
            need = int(np.ceil(self.least * (low + b) / 2 - 1e-9))
            at = places
            if b > LONG:
                if len(known) < need:
                    continue
                at = whole = known[np.isin(codes[known], self.codes[1])] if whole is None else whole
            if len(at) < need:
                continue
            mine = at[np.isin(codes[at], self.keys[t])]
            if len(mine) < need:
                continue
            ends = np.searchsorted(mine, mine + high, side="left")
            best, (numbers, modifiers) = None, self.marks[t]
            for k in np.flatnonzero(ends - np.arange(len(mine)) >= need).tolist():
                most = min(b, int(ends[k]) - k)
                if best and 2 * most / (most + b) <= best[0]:
                    continue  # no stretch from here can be better
                left, shared = dict(bag), 0
                for j in range(k, int(ends[k])):
                    c = int(codes[mine[j]])
                    if left[c]:
                        left[c] -= 1
                        shared += 1
                    n = int(mine[j] - mine[k]) + 1
                    if n >= low and (dice := 2 * shared / (n + b)) >= self.least and (best is None or dice > best[0]):
                        held = set(words[int(mine[k]) : int(mine[k]) + n + 1])
                        if numbers <= held and MODIFIERS & held == modifiers:
                            best = (dice, int(mine[k]), n + 1, t)
            if best:
                out.append(best)
        return out


def told_apart(found: list[tuple], names: list[str], sizes: list[int]) -> list[tuple]:
    """The matches, best first (larger Dice, then longer template, then first), without those of another licence that lie
    by over half in the stretch of a better one: a licence's siblings match its text too, only worse."""
    out: list[tuple] = []
    for x in sorted(found, key=lambda x: (-x[0], -sizes[x[3]], x[3])):
        over = lambda y: min(x[1] + x[2], y[1] + y[2]) - max(x[1], y[1])  # noqa: E731, B023
        if not any(names[y[3]] != names[x[3]] and 2 * over(y) > min(x[2], y[2]) for y in out):
            out.append(x)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(id, license, dice, first_word, n_words, licenses): a row per input row, nulls and no licences where nothing matches.

    ``license`` is the template of the largest Dice coefficient over the whole text, ties to the longer; ``licenses``
    names every licence that matches where no other matches better, sorted. Texts stream through; nothing is shuffled; null and empty
    texts match nothing; repeated rows stay; other columns are not read.
    """

    def work(batches):
        scanner = Scanner(templates, least)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                found = told_apart(scanner.scan(t.as_py()), [n for n, _ in templates], scanner.sizes)
                top = found[0] if found else None
                names = sorted({templates[x[3]][0] for x in found})
                rows.append((templates[top[3]][0], round(top[0], 6), top[1], top[2], names) if top else (None, None, None, None, names))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [id_col, "license", "dice", "first_word", "n_words", "licenses"])

    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {dict(docs.dtypes)[id_col]}, license string, dice double, first_word long, n_words long, licenses array<string>")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence, if it holds one."""
    return scan(read(spark, sf_dir, "documents")).withColumn("licenses", F.array_join("licenses", ","))
