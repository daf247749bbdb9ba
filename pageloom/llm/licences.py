"""Licence passages by the Dice coefficient of their word bigrams with licence templates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.frames import slices, table

LEAST = 0.8

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software."""
_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE."""


def _gnu(name: str, version: str) -> str:
    """The notice that the GNU licences ask programs to carry."""
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as
published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of
the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""


# Whole texts of short public licences, and of long ones the notices that they ask works to carry.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
    "MIT": f"{_MIT_GRANT} {_MIT_DISCLAIMER}",
    "MIT-grant": _MIT_GRANT,
    "ISC": f"{_ISC_GRANT} {_ISC_DISCLAIMER}",
    "ISC-grant": _ISC_GRANT,
    "BSD-2-Clause": f"{_BSD_GRANT} {_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{_BSD_GRANT} {_BSD_THIRD} {_BSD_DISCLAIMER}",
    "BSD-grant": _BSD_GRANT,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            f"granted. {_ISC_DISCLAIMER}",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "GPL-2.0": _gnu("General Public License", "2"),
    "GPL-3.0": _gnu("General Public License", "3"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights
to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a
copy of the CC0 Public Domain Dedication along with this software. If not, see
<http://creativecommons.org/publicdomain/zero/1.0/>.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license
grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all
derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN
NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the
benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR
A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
}

_WORD = re.compile(r"[^\W_]+")


def normal_words(text: str) -> list[str]:
    """Words in lower case, without punctuation."""
    return [w.lower() for w in _WORD.findall(text)]


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Matcher:
    """Licence templates with their size bounds and numbered words and bigrams."""

    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        grams = {name: g for name, text in templates.items() if (g := bigrams(normal_words(text)))}
        self.names = list(grams)
        words = sorted({w for g in grams.values() for pair in g for w in pair})
        self.words = {w: i for i, w in enumerate(words)}
        pairs = sorted({p for g in grams.values() for p in g})
        # Number of each bigram of any template, by its two words; -1 for all others.
        self.pair = np.full((len(words) + 1, len(words) + 1), -1, np.int32)
        for k, (a, b) in enumerate(pairs):
            self.pair[self.words[a], self.words[b]] = k
        self.counts = np.array([[g[p] for p in pairs] for g in grams.values()], np.int32).reshape(len(grams), len(pairs))
        self.sizes = self.counts.sum(1)
        # 2 |a & b| / (|a| + |b|) >= least needs a size within these bounds, and so many bigrams in common.
        self.low, self.high = self.sizes * least / (2 - least), self.sizes * (2 - least) / least
        self.shared = np.ceil(self.low - 1e-9).astype(int)

    def passages(self, text: str) -> list[tuple[str, int, int, float]]:
        """Best word windows for the licences: name, place in code points, place behind, Dice coefficient.

        A window that no other beats begins and ends with bigrams of the template. So windows between such bigrams are
        compared whose size is within the template's bounds, from places behind which enough of them follow. Of
        windows that overlap, of any licence, the one that shares most bigrams counts, then the better and the earlier.
        """
        low = text.lower()
        found = _WORD.findall(low) if len(low) == len(text) else normal_words(text)
        ids = np.fromiter(map(self.words.get, found, repeat(-1)), np.int32, len(found))
        grams = self.pair[ids[:-1], ids[1:]] if len(ids) > 1 else ids[:0]
        at = np.flatnonzero(grams >= 0)
        if not len(at):
            return []
        grams = grams[at]
        in_template = self.counts[:, grams] > 0
        windows: list[tuple] = []
        for t in np.flatnonzero(in_template.sum(1) >= self.shared):
            windows += self._windows(int(t), at[in_template[t]], grams[in_template[t]])
        taken: list[tuple[int, int]] = []
        out = []
        for shared, value, a, b, t in sorted(windows, key=lambda w: (-w[0], -w[1], w[2], w[3], w[4])):
            if all(b < x or a > y for x, y in taken):
                taken.append((a, b))
                out.append((self.names[t], a, b, value))
        if not out:
            return []
        spans = [m.span() for m in _WORD.finditer(low if len(low) == len(text) else text)]
        return sorted([(n, spans[a][0], spans[b][1], v) for n, a, b, v in out], key=lambda x: (x[1], x[0]))

    def _windows(self, t: int, at: np.ndarray, grams: np.ndarray) -> list[tuple]:
        """For each place where a window can begin, its best one: shared bigrams, Dice, first and last word, template."""
        high, own, size = self.high[t], self.counts[t], int(self.sizes[t])
        follow = np.searchsorted(at, at + high, "left") - np.arange(len(at))
        out = []
        for i in np.flatnonzero(follow >= self.shared[t]).tolist():
            seen: Counter = Counter()
            shared, best = 0, (0.0, 0, 0)
            for j in range(i, i + int(follow[i])):
                g = int(grams[j])
                if seen[g] < own[g]:
                    seen[g] += 1
                    shared += 1
                    value = 2 * shared / (int(at[j] - at[i]) + 1 + size)
                    if value > best[0] + 1e-12:
                        best = (value, shared, int(at[j]) + 1)
            if best[0] >= self.least - 1e-12:
                out.append((best[1], best[0], int(at[i]), best[2], t))
        return out


def find_licences(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """``doc_id`` and ``licences`` (name, start, end, dice) of every row; places count code points, end exclusive.

    Whole texts are read, whatever their lines: every window of words whose number of bigrams allows a Dice
    coefficient of ``least`` with a template, and that shares enough of them, is compared. Null and empty texts have
    no licence. Templates without bigrams match nothing. Rows, also repeated ones, are treated
    one by one; other columns are ignored; an empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    item = pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("dice", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("licences", pa.list_(item))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, least)
        for part in slices(batches):
            found = [[{"name": n, "start": a, "end": b, "dice": d} for n, a, b, d in matcher.passages(t or "")]
                     for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(item))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        scan, "doc_id long, licences array<struct<name:string,start:long,end:long,dice:double>>")


def licence_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = find_licences(table(spark, folder, "documents"))
    return found.select("doc_id", F.size("licences").cast("long").alias("n_licences"), F.array_join(
        F.transform("licences", lambda x: F.format_string(
            "%s:%d:%d:%.4f", x["name"], x["start"], x["end"], x["dice"])), ",").alias("licences"))
