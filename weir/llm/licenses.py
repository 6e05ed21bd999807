"""License scans by conditional compression, confirmed by exact wording.

Candidate text is all words within REACH words of a word of license language, where REACH is as long as the longest
notice may be with its differing words; what meets is one stretch, over line ends too. In a stretch each notice has blocks:
the words within its reach of the rarest word that names its license, or all, cut into pieces of twice its reach that
overlap by its reach, so that each place lies whole in one. A block's words are compressed alone and with the license's
template as a raw zstandard dictionary, at two levels, as each misses matches of short blocks; the larger saving counts.
Blocks in which the template saves no byte are passed over; of 14 million random blocks that hold a notice with up to as many
differing words as are allowed, none was. In the others the exact wording is compared: the notice is aligned word by word
(anything before and after is free), and a place is confirmed if it differs from the notice in at most ALLOWED of the
notice's words and none of the words that name the license differ. Confirmed places are compressed in the same way. Of
places that overlap, the one of which its license's template saves the most bytes wins, less the length of the differing
words (`wording`), then the one with fewer of them; all places that are left are reported, with their size reduction. The
notices are those of 19 licenses: their names, identifiers, and the usual wording that files carry (`TEXTS`); the long
bodies of licenses that files refer to are no notices.

Result: a row a notice: doc_id, block_start, block_end (code points, with a full stop that follows), license, reduction,
n_diff, wording (the differing words, -missing +added).

Nulls: a null or empty text has no notices. Repeated rows give repeated results. An empty table gives an
empty result. A text of any length is searched whole. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weir.llm.shared import bounded_batches, settle, small
from weir.session import ship

ALLOWED, LEVELS = 0.2, (6, 19)
_ANCHOR = re.compile(r"licen[sc]e|copyright|spdx|warrant(?:y|ies)|permission|redistribut|public\s+domain|unencumbered|creative\s?commons", re.I)
_RUN = re.compile(r"[\w.+-]+")

# Names of licenses and their notices.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "EPL-2.0": ["Eclipse Public License, version 2.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
}
FORMS = ["This work is licensed under the {}.", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Distributed under the terms of the {}."]
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NO_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_FREE = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
_HOPE = "This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."
_DEED = "This work is licensed under the Creative Commons {} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."


def _gnu(what: str, kind: str, mark: str, stop: str, version: str) -> list[str]:
    free = _FREE.format(what, mark, kind, stop, version)
    return [free, f"{free} {_HOPE.format(what, kind)}"]


TEXTS = {
    "MIT": [
        _GRANT,
        f"{_GRANT} THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [_APACHE, f"{_APACHE} See the License for the specific language governing permissions and limitations under the License."],
    "GPL-2.0": _gnu("program", "", ";", ";", "2"),
    "GPL-3.0": _gnu("program", "", ":", ",", "3"),
    "LGPL-2.1": _gnu("library", "Lesser ", ";", ";", "2.1"),
    "LGPL-3.0": _gnu("program", "Lesser ", ":", ",", "3"),
    "AGPL-3.0": _gnu("program", "Affero ", ":", ",", "3"),
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-2-Clause": [_REDISTRIBUTION, f"{_REDISTRIBUTION} {_CLAUSES}", f"{_REDISTRIBUTION} {_CLAUSES} {_DISCLAIMER}"],
    "BSD-3-Clause": [f"{_REDISTRIBUTION} {_CLAUSES} {_NO_NAMES}", f"{_REDISTRIBUTION} {_CLAUSES} {_NO_NAMES} {_DISCLAIMER}"],
    "ISC": [
        _ISC,
        f"{_ISC} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    ],
    "CC-BY-4.0": [_DEED.format("Attribution", "by")],
    "CC-BY-SA-4.0": [_DEED.format("Attribution-ShareAlike", "by-sa")],
    "CC-BY-NC-4.0": [_DEED.format("Attribution-NonCommercial", "by-nc")],
    "CC-BY-ND-4.0": [_DEED.format("Attribution-NoDerivatives", "by-nd")],
    "CC-BY-NC-SA-4.0": [_DEED.format("Attribution-NonCommercial-ShareAlike", "by-nc-sa")],
}


def notices(license_id: str) -> list[str]:
    names = [form.format(name) for name in NAMES[license_id] for form in FORMS]
    return [*names, f"SPDX-License-Identifier: {license_id}", *TEXTS[license_id]]


def places(text: str) -> list[tuple[int, int]]:
    """Start and end of each word: runs of letters, digits, '.', '+' and '-', without such marks at the end."""
    found = ((m.start(), m.start() + len(m[0].rstrip(".+-"))) for m in _RUN.finditer(text))
    return [(a, b) for a, b in found if a < b]


def words(text: str) -> list[str]:
    return [text[a:b].lower() for a, b in places(text)]


class Notice:
    """A notice's words, and those that name its license, which may not differ."""

    def __init__(self, license_id: str, text: str, naming: set[str]):
        self.license, self.words = license_id, words(text)
        self.fixed = [w in naming for w in self.words]
        self.naming = {w for w in self.words if w in naming}
        self.allowed = int(ALLOWED * len(self.words))
        self.never = 2 * len(self.words) + 2  # costs more than any alignment

    def reach(self) -> int:
        return len(self.words) + self.allowed

    def ends(self, block: list[str]) -> list[tuple[int, int]]:
        """(cost, end) where the notice aligns with words of the block that end there, least within reach of each other."""
        row = [0] * (len(block) + 1)
        for w, fixed in zip(self.words, self.fixed):
            lost = self.never if fixed else 1
            prev, row = row, [row[0] + lost]
            for j, x in enumerate(block, 1):
                same = prev[j - 1] + (0 if w == x else lost)
                least = min(prev[j] + lost, row[-1] + 1)
                row.append(same if same < least else least)
        out: list[tuple[int, int]] = []
        for j, cost in enumerate(row):
            if cost <= self.allowed:
                if out and j - last == 1:
                    out[-1] = min(out[-1], (cost, j))
                else:
                    out.append((cost, j))
                last = j
        return out

    def align(self, block: list[str], end: int) -> tuple[int, str]:
        """Start of the alignment with the least cost that ends there, and its edits."""
        first = max(0, end - self.reach())
        part = block[first:end]
        rows = [[0] * (len(part) + 1)]
        for w, fixed in zip(self.words, self.fixed):
            lost, prev, cur = self.never if fixed else 1, rows[-1], [rows[-1][0] + (self.never if fixed else 1)]
            for j, x in enumerate(part, 1):
                cur.append(min(prev[j - 1] + (0 if w == x else lost), prev[j] + lost, cur[-1] + 1))
            rows.append(cur)
        i, j, edits = len(self.words), len(part), []
        while i:
            w, lost = self.words[i - 1], self.never if self.fixed[i - 1] else 1
            if j and rows[i][j] == rows[i - 1][j - 1] + (0 if w == part[j - 1] else lost):
                if w != part[j - 1]:
                    edits.append(f"-{w} +{part[j - 1]}")
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j] + lost:
                edits.append(f"-{w}")
                i -= 1
            else:
                edits.append(f"+{part[j - 1]}")
                j -= 1
        return first + j, " ".join(edits[::-1])


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order of start, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Scanner:
    def __init__(self):
        import zstandard

        self.alone = [zstandard.ZstdCompressor(level=n) for n in LEVELS]
        self.given, self.notices = {}, []
        for k in NAMES:
            own = notices(k)
            raw, self.given[k] = " ".join(" ".join(words(text)) for text in own).encode(), []
            for n in LEVELS:
                template = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                template.precompute_compress(level=n)
                self.given[k].append(zstandard.ZstdCompressor(level=n, dict_data=template))
            naming = {w for name in NAMES[k] for w in words(name)} | {*words(k)}
            self.notices += [Notice(k, text, naming) for text in own]
        self.reach = max(n.reach() for n in self.notices)

    def saved(self, license_id: str, block: list[str]) -> tuple[int, float]:
        """Bytes that the license's template saves in compressing these words, and their share."""
        raw = " ".join(block).encode()
        sizes = [(len(a.compress(raw)), len(b.compress(raw))) for a, b in zip(self.alone, self.given[license_id])]
        return max((alone - given, 1 - given / alone) for alone, given in sizes)

    def blocks(self, notice: Notice, own: list[str], near: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The blocks near the notice's naming words in which its license's template saves bytes, those that meet as one."""
        reach = notice.reach()
        pieces = [(i, min(b, i + 2 * reach)) for a, b in near for i in range(a, max(a + 1, b - reach), reach)]
        return joined([(a, b) for a, b in pieces if self.saved(notice.license, own[a:b])[0] > 0])

    def accepted(self, own: list[str]) -> list[tuple]:
        """(cost, first word, word after the last, edits, notice) of all places in these words; they may overlap."""
        at: dict[str, list[int]] = {}
        for i, w in enumerate(own):
            at.setdefault(w, []).append(i)
        out = []
        for notice in self.notices:
            if not all(w in at for w in notice.naming):
                continue
            rare = min((at[w] for w in notice.naming), key=len, default=None)
            near = [(0, len(own))]
            if rare is not None:
                near = joined([(max(0, i - notice.reach()), min(len(own), i + notice.reach() + 1)) for i in rare])
            for a, b in self.blocks(notice, own, near):
                part = own[a:b]
                have = {*part}
                if sum(w not in have for w in notice.words) > notice.allowed or not notice.naming <= have:
                    continue  # sure to differ in too many words
                for cost, end in notice.ends(part):
                    start, edits = notice.align(part, end)
                    out.append((cost, a + start, a + end, edits, notice))
        return out

    def scan(self, text: str) -> list[tuple]:
        """(start, end, license, reduction, n_diff, wording) of the text's notices."""
        anchors = [m.start() for m in _ANCHOR.finditer(text)]
        if not anchors:
            return []
        spans = places(text)
        starts, own = [a for a, _ in spans], [text[a:b].lower() for a, b in spans]
        near = (bisect_left(starts, x) for x in anchors)
        out = []
        for first, last in joined([(max(0, i - self.reach), min(len(own), i + self.reach)) for i in near]):
            found = []
            for cost, i, j, edits, notice in self.accepted(own[first:last]):
                a, b = spans[first + i][0], spans[first + j - 1][1]
                b += text[b : b + 1] == "."
                less, reduction = self.saved(notice.license, own[first + i : first + j])
                found.append((len(edits) - less, cost, notice.license, a, b, reduction, edits))
            taken: list[tuple[int, int]] = []
            for _, cost, k, a, b, reduction, edits in sorted(found):
                at = bisect_left(taken, (a, b))
                if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < b):
                    continue
                taken.insert(at, (a, b))
                out.append((a, b, k, reduction, cost, edits))
        return sorted(out)


_SCANNER: list[Scanner] = []


def scan_licenses(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "block_start", "block_end", "license", "reduction", "n_diff", "wording"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string()]

    def run(batches):
        settle("licenses", _SCANNER.clear)
        if not _SCANNER:
            _SCANNER.append(Scanner())
        for batch in small(batches, 1):
            rows = [(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for r in _SCANNER[0].scan(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return own.mapInArrow(run, "doc_id long, block_start long, block_end long, license string, reduction double, n_diff long, wording string")
