"""License scans by conditional compression.

A block of text that quotes a license compresses far better when the license is the dictionary. Candidate blocks, the
surroundings of a template's key word that hold enough of its words, are compressed plain and with the template as a raw
zstandard dictionary; a template that saves anything is confirmed by the exact wording differences: the cheapest alignment
of its words around the key, found to both sides of it. A block reaches as far as a find can and no farther, so time grows
with the number of words of a text, and memory with the template. Words that tell licenses apart
(versions, "lesser", "sa", "nc", "not" and the like, and the template's key) may be neither missing nor put in, and a
notice after a "not" is none. Of finds that overlap, the one with most words in place less differences stays, and of equal ones
the one whose template saves most.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.ship import ship

#: The wording of public licenses.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "CC0-1.0 notice": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under CC0 1.0."),
}
#: Names of licenses that notices give, by the identifier.
NAMES = {
    "MIT": "MIT License", "ISC": "ISC License", "BSD": "BSD License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Apache-2.0": "Apache License, Version 2.0", "MPL-2.0": "Mozilla Public License, Version 2.0",
}
#: The GNU licenses, their versions, and the notice of a source file under one of them.
GNU = {"GPL": ("GNU General Public License", ["2.0", "3.0"]), "LGPL": ("GNU Lesser General Public License", ["2.1", "3.0"]), "AGPL": ("GNU Affero General Public License", ["3.0"])}
GNU_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
#: Elements of Creative Commons licenses and their names, the licenses, and their versions.
CC_ELEMENTS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
CC, CC_VERSIONS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"], ["3.0", "4.0"]
for _id, _name in NAMES.items():
    TEMPLATES[f"{_id} notice"] = (f"Licensed under the {_name}.",)
for _id, (_name, _versions) in GNU.items():
    for _v in _versions:
        TEMPLATES[f"{_id}-{_v}"] = (GNU_NOTICE.format(name=_name, version=_v),)
        TEMPLATES[f"{_id}-{_v} notice"] = (f"Licensed under the {_name}, version {_v}.", f"Licensed under version {_v} of the {_name}.")
for _id in CC:
    for _v in CC_VERSIONS:
        TEMPLATES[f"CC-{_id}-{_v} notice"] = (f"Licensed under CC {_id} {_v}.", f"Licensed under a Creative Commons {'-'.join(CC_ELEMENTS[e] for e in _id.split('-'))} {_v} License.")

#: Words that count as one, words that don't count, words that tell licenses apart, and negations. A number tells apart where the template has one.
SAME = {
    "licensed": ["licensed", "licenced", "released", "available", "distributed", "provided", "published", "offered", "shared"],
    "license": ["license", "licence"], "noncommercial": ["noncommercial", "non-commercial"], "noderivatives": ["noderivatives", "noderivs"],
}
OPTIONAL = {"the", "a", "an", "version", "v", "international", "unported", "non"}
APART = {"lesser", "library", "affero", "by", "sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives", "commercial", "clause", "cc0"}
NEGATIONS = {"not", "never", "no", "cannot", "nor", "neither", "isn", "aren", "wasn", "weren", "without"}
#: A template is confirmed if so much of its wording stands in order, and twice the missing words and those put in are twice the rest at most.
COVERED = 0.8
#: So many words before a find are looked at for a negation, as far as its sentence goes.
BEFORE = 3
#: A notice of a few words may have so many others put in.
LEAST = 2
NEVER = 1 << 20
_WORD, _STOP = re.compile(r"\w+(?:\.\w+)*"), re.compile(r"[.!?]\s|\n")
_ONE = {w: k for k, group in SAME.items() for w in group}


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Words that count, in lower case and with one form for those that mean the same, with their places; 2.0, v2 and 2 are one."""
    out = []
    for m in _WORD.finditer(text):
        w = m[0].lower()
        if w in OPTIONAL:
            continue
        if any(c.isdigit() for c in w):
            w = re.sub(r"(?<=\d)\.0\Z", "", re.sub(r"\Av(?=\d)", "", w))
        out.append((_ONE.get(w, w), m.start(), m.end()))
    return out


def _plainly() -> zstandard.ZstdCompressionParameters:
    """Without a code for single characters, so that on blocks of any size only repeated stretches save bytes."""
    return zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=4, hash_log=15, window_log=20, write_content_size=False, write_checksum=False)


@dataclass
class Template:
    name: str
    words: list[str]
    key: str
    covered: float

    @classmethod
    def all_of(cls, texts: dict[str, str | tuple[str, ...]], covered: float = COVERED) -> list[Template]:
        """A template for each form of each license; its key is the word, no number, that fewest forms have, and of such ones the longest."""
        forms = [(n, [w for w, _, _ in words_of(t)]) for n, group in texts.items() for t in ([group] if isinstance(group, str) else group)]
        used = Counter(w for _, words in forms for w in set(words))
        return [cls(n, words, min((w for w in set(words) - SAME.keys() if not w[0].isdigit()), key=lambda w: (used[w], -len(w), w)), covered) for n, words in forms]

    @cached_property
    def compressor(self) -> zstandard.ZstdCompressor:
        own = zstandard.ZstdCompressionDict(" ".join(self.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(compression_params=_plainly(), dict_data=own)

    @cached_property
    def may_miss(self) -> int:
        return int((1 - self.covered) * len(self.words) + 1e-9)

    @cached_property
    def limit(self) -> int:
        """Of the cost of differences: 2 for a missing word, 1 for one put in."""
        return max(LEAST, 2 * self.may_miss)

    @cached_property
    def numbered(self) -> bool:
        return any(w[0].isdigit() for w in self.words)

    def tells(self, word: str) -> bool:
        return word in APART or word in NEGATIONS or word == self.key or (self.numbered and word[0].isdigit())

    @cached_property
    def asked(self) -> list[tuple[bool, tuple[str, ...]]]:
        """Each distinct word, the rarer first, with its forms and whether it has to be there."""
        return sorted((not self.tells(w), w != self.key, tuple(SAME.get(w, [w]))) for w in set(self.words))

    def fits(self, lowered: str) -> bool:
        """Whether a text may hold the template: all words that tell apart are somewhere in it, and most others."""
        absent = 0
        for other, _, forms in self.asked:
            if not any(f in lowered for f in forms):
                absent += 1
                if not other or absent > self.may_miss:
                    return False
        return True

    @cached_property
    def reach(self) -> int:
        """A find lies within so many words to either side of its key."""
        return len(self.words) + self.limit

    @cached_property
    def need(self) -> Counter:
        return Counter(self.words)

    @cached_property
    def splits(self) -> list[tuple[int, list[str], list[str]]]:
        """(place, words before it backwards, words after it) for each place of the key."""
        return [(p, self.words[:p][::-1], self.words[p + 1 :]) for p, w in enumerate(self.words) if w == self.key]

    def align(self, words: list[str], anchor: int) -> tuple[int, list[tuple[int, int]]] | None:
        """Cost and pairs (word of the template, word of the block) of the cheapest alignment in which the block's word at anchor is the key; None beyond the limit."""
        best = None
        before, after = words[:anchor][::-1], words[anchor + 1 :]
        for place, head, tail in self.splits:
            left = self._side(head, before[: len(head) + self.limit])
            right = left and self._side(tail, after[: len(tail) + self.limit])
            if left and right and left[0] + right[0] <= self.limit and (best is None or left[0] + right[0] < best[0]):
                pairs = [(place - 1 - a, anchor - 1 - b) for a, b in reversed(left[1])] + [(place, anchor)] + [(place + 1 + a, anchor + 1 + b) for a, b in right[1]]
                best = (left[0] + right[0], pairs)
        return best

    def _side(self, own: list[str], words: list[str]) -> tuple[int, list[tuple[int, int]]] | None:
        """Cost and pairs of the cheapest alignment of own words with a beginning of the words."""
        put_in = np.concatenate([[0], np.cumsum([NEVER if self.tells(w) else 1 for w in words])]).astype(np.int64)
        leave_out = [NEVER if self.tells(w) or not self.may_miss else 2 for w in own]
        block, rows = np.array(words, object), [put_in]
        for word, cost in zip(own, leave_out, strict=True):
            row = rows[-1] + cost
            row[1:] = np.where(block == word, np.minimum(row[1:], rows[-1][:-1]), row[1:])
            rows.append(put_in + np.minimum.accumulate(row - put_in))
            if rows[-1].min() > self.limit:
                return None
        i, j = len(own), int(rows[-1].argmin())
        total, pairs = int(rows[-1][j]), []
        while i:
            if j and words[j - 1] == own[i - 1] and rows[i - 1][j - 1] == rows[i][j]:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif rows[i - 1][j] + leave_out[i - 1] == rows[i][j]:
                i -= 1
            else:
                j -= 1
        return total, pairs[::-1]


def anchors(words: list[str], template: Template) -> list[int]:
    """Places of the template's key whose surroundings hold enough of its words. One walk over the text keeps count."""
    need, least, have, held, out, begin, end = template.need, len(template.words) - template.may_miss, Counter(), 0, [], 0, 0
    for at, word in enumerate(words):
        if word != template.key:
            continue
        low, high = max(0, at - template.reach), min(len(words), at + template.reach + 1)
        if low >= end:
            have, held, begin, end = Counter(), 0, low, low
        while end < high:
            w = words[end]
            if w in need:
                have[w] += 1
                held += have[w] <= need[w]
            end += 1
        while begin < low:
            w = words[begin]
            if w in need:
                held -= have[w] <= need[w]
                have[w] -= 1
            begin += 1
        if held >= least:
            out.append(at)
    return out


def _negated(text: str, words: list[tuple[str, int, int]], first: int) -> bool:
    before = [w for w in words[max(0, first - BEFORE) : first] if not _STOP.search(text, w[2], words[first][1])]
    return any(w in NEGATIONS for w, _, _ in before)


def scan(text: str | None, templates: list[Template]) -> list[dict]:
    """Licenses in a text, each with its place, sizes, coverage and wording differences; overlapping finds keep the best."""
    lowered = (text or "").lower()
    able = [t for t in templates if t.fits(lowered)]
    if not able:
        return []
    plain = zstandard.ZstdCompressor(compression_params=_plainly())
    placed, found = words_of(text), []
    words = [w for w, _, _ in placed]
    for t in able:
        taken: list[tuple[int, int]] = []  # stretches of this template's finds, in order

        def aligned(at: int, low: int, high: int, t: Template = t) -> tuple[int, int, int, list[tuple[int, int]]] | None:
            low, high = max(low, at - t.reach), min(high, at + t.reach + 1)
            best = t.align(words[low:high], at - low)
            return best and (best[0], low + best[1][0][1], at, [(a, low + b) for a, b in best[1]])

        saved: dict[int, tuple[int, int]] = {}
        for at in anchors(words, t):
            data = " ".join(words[max(0, at - t.reach) : at + t.reach + 1]).encode()
            saved[at] = (len(plain.compress(data)), len(t.compressor.compress(data)))
        queue = [x for at, (size, own) in saved.items() if own < size and (x := aligned(at, 0, len(words)))]
        heapq.heapify(queue)
        while queue:  # the cheapest first, of equals the leftmost; what overlaps it is aligned again beside it
            cost, first, at, pairs = heapq.heappop(queue)
            last = pairs[-1][1] + 1
            i = bisect.bisect(taken, (at, len(words)))
            low, high = taken[i - 1][1] if i else 0, taken[i][0] if i < len(taken) else len(words)
            if at < low:
                continue
            if first < low or last > high:
                if x := aligned(at, low, high):
                    heapq.heappush(queue, x)
                continue
            taken.insert(i, (first, last))
            if not _negated(text, placed, first):
                kept_a, kept_b = {a for a, _ in pairs}, {b for _, b in pairs}
                found.append({
                    "license": t.name, "start": placed[first][1], "end": placed[last - 1][2], "plain_size": saved[at][0], "size": saved[at][1], "coverage": len(pairs) / len(t.words), "exact": not cost,
                    "missing": [w for x, w in enumerate(t.words) if x not in kept_a], "added": [words[x] for x in range(first, last) if x not in kept_b], "worth": len(pairs) - cost,
                })
    found.sort(key=lambda f: (-f["worth"], f["start"], f["end"], f["size"] - f["plain_size"], f["license"]))
    out: list[dict] = []
    spans: list[tuple[int, int]] = []
    for f in found:
        i = bisect.bisect(spans, (f["start"], f["end"]))
        if (not i or spans[i - 1][1] <= f["start"]) and (i == len(spans) or spans[i][0] >= f["end"]):
            spans.insert(i, (f["start"], f["end"]))
            out.append(f)
    return sorted(out, key=lambda f: f["start"])


def find_licenses(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text", covered: float = COVERED) -> DataFrame:
    """A row for each license found in each row's whole text.

    A text with many licenses gives a row for each, in time that grows with its length.
    Returns id, license, start, end (characters), plain_size and size (bytes of the block compressed without and with
    the template), coverage (share of the template's words that the text has in order), exact (whether nothing is
    missing or put in), missing and added words. Texts without the key word of any template, null and empty ones give
    no rows; repeated rows give theirs again; null ids stay null; other columns are not read.
    """
    ship(docs.sparkSession)
    known = TEMPLATES if templates is None else templates
    kind = dict(docs.select(id_col).dtypes)[id_col]
    sizes = pa.schema([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain_size", pa.int32()), ("size", pa.int32()), ("coverage", pa.float64()), ("exact", pa.bool_()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Template.all_of(known, covered)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [scan(t, own) for t in part.column(1).to_pylist()]
                of = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                rows = pa.Table.from_pylist([{c: x[c] for c in sizes.names} for f in found for x in f], sizes)
                yield pa.record_batch([part.column(0).take(of), *[c.combine_chunks() for c in rows.columns]], ["id", *sizes.names])

    keys = {re.escape(t.key) for t in Template.all_of(known, covered)}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(f"(?i)(?<![a-z0-9])(?:{'|'.join(sorted(keys))})"))
    return rows.mapInArrow(find, f"id {kind}, license string, start long, end long, plain_size int, size int, coverage double, exact boolean, missing array<string>, added array<string>").withColumnRenamed("id", id_col)
