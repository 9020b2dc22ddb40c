"""License scans by conditional compression: which license template makes a block of text cheapest to compress."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public license notices and the short forms in which texts name a license.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause OR BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "All-rights-reserved": ["All rights reserved."],
}
#: Licenses that share wording, and what tells which of them a text means, if only one of these is confirmed in it.
SHARED = {"BSD-2-Clause OR BSD-3-Clause": ("BSD-3-Clause", "BSD-2-Clause")}
#: Words that decide: one of them missing, added or another never confirms a notice, nor does any number of a version.
NEGATIONS = frozenset("no not non never neither nor without cannot isn't aren't doesn't don't won't mustn't".split())
NAMES = frozenset(
    "gnu lesser affero library apache mozilla boost eclipse mit bsd isc zlib unlicense cc cc0 by-sa by-nc by-nd by-nc-sa by-nc-nd creative commons attribution attribution-sharealike "
    "attribution-noncommercial attribution-noderivatives sharealike noncommercial non-commercial noderivatives 2-clause 3-clause 4-clause".split()
)
VERSION = re.compile(r"v?\d{1,2}(?:\.\d{1,2})*|[ivx]{1,4}")
#: Texts with one of these words are looked through for notices that are not confirmed, too.
TRIGGER = r"(?i)licen[sc]e|copyright|permission|permitted|public\W+domain|all\W+rights\W+reserved|software"
#: What is compared of a text: from the first to the last letter or digit of what stands between white space.
WORD = re.compile(r"[^\W_](?:\S*[^\W_])?")
#: Words that mark a comment when a line begins with them.
MARKS = frozenset(("dnl", "rem"))
MARK = re.compile(r"(?m)^[\W_]*(?:dnl|rem)(?![^\W_])")
#: What ends a sentence or clause, right behind a word.
STOPS = frozenset(".!?;:")
#: Words that templates share with any English prose: a place is looked at for the other words of a template.
COMMON = frozenset("a above all an and any are as at be by can for from has have in is it its may no nor not of on or permit provided shall that the their this to under use was will with without you your".split())
SCHEMA = "doc_id long, block long, start_word long, end_word long, license string, reduction double, runner_up string, missing_words long, added_words long, differences array<string>, confirmed boolean"


def words_of(text: str) -> list[str]:
    """Words for comparison: lower case, without punctuation and comment marks at their ends."""
    return WORD.findall(text.lower())


def placed_words(text: str) -> tuple[list[str], list[int], list[int], list[bool]]:
    """(words, the line of each, its place in the line, whether a sentence or clause ends with it) of a text; words that mark a line as a comment are left out."""
    words, lines, places, stops = [], [], [], []
    for n, line in enumerate(text.split("\n")):
        line = line.lower()
        own = [(m.group(), line[m.end() : m.end() + 1] in STOPS) for m in WORD.finditer(line)]
        skip = 1 if own and own[0][0] in MARKS else 0
        words += [w for w, _ in own[skip:]]
        stops += [s for _, s in own[skip:]]
        lines += [n] * (len(own) - skip)
        places += range(skip, len(own))
    return words, lines, places, stops


def decides(word: str) -> bool:
    return word in NEGATIONS or word in NAMES or VERSION.fullmatch(word) is not None


class Spaced(dict):
    """A table for str.translate: whatever is no letter or digit becomes a space."""

    def __missing__(self, code: int) -> str:
        self[code] = found = chr(code) if chr(code).isalnum() else " "
        return found


def in_spaces(text: str, table: Spaced) -> str:
    """The letters and digits of a text in lower case, one space between runs of them and at both ends; words that mark a line as a comment are left out."""
    text = text.lower()
    if any(m in text for m in MARKS):
        text = MARK.sub(" ", text)
    return f" {' '.join(text.translate(table).split())} "


class Scanner:
    """Templates as raw-content dictionaries: a compressor for each, and one without; and what to look for of each in a text.

    A form of n words is confirmed with ``slack`` * n words missing or added. So many edits leave one of as many pieces and one more
    whole, so a text that holds none of the pieces of a form does not hold the form, and each piece found is a place to align it.
    """

    def __init__(self, templates: dict[str, list[str]], level: int, slack: float):
        self.forms = [(name, words) for name, forms in templates.items() for form in forms if (words := words_of(form))]
        self.plain = zstandard.ZstdCompressor(level=level)
        self.given = [
            zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(" ".join(words).encode() * 2, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for _, words in self.forms
        ]
        self.edits = [int(slack * len(words) + 1e-9) for _, words in self.forms]
        self.pieces, self.rare, self.shape, self.least_rare = {}, {}, [], []
        self.table, self.spotter = Spaced(), ahocorasick.Automaton()
        for f, (_, words) in enumerate(self.forms):
            n = len(words)
            parts = min(n, self.edits[f] + 1)
            for k in range(parts):
                at, to = k * n // parts, (k + 1) * n // parts
                anchor = max(range(at, to), key=lambda j: (words[j] not in COMMON, len(words[j])))
                self.pieces.setdefault(words[anchor], []).append((f, at, words[at:to], anchor - at))
                self.spotter.add_word(in_spaces(" ".join(words[at:to]), self.table), f)
            own = [k for k, w in enumerate(words) if w not in COMMON] or list(range(n))
            self.least_rare.append((frozenset(words[k] for k in own), (len({words[k] for k in own}) + 1) // 2))
            for w in {words[k] for k in own}:
                self.rare.setdefault(w, []).append(f)
            # the longest step between rarer words, the words before the first and after the last, how many make a look
            self.shape.append((max([y - x for x, y in zip(own, own[1:], strict=False)], default=1) + 3, own[0], n - 1 - own[-1], min(2, len({words[k] for k in own}))))

        self.spotter.make_automaton()

    def spots(self, text: str) -> bool:
        """Whether a piece of any form stands whole in the text: without one no form is confirmed there."""
        return next(self.spotter.iter(in_spaces(text, self.table)), None) is not None

    def sure(self, words: list[str], a: int, z: int, form: int, stops: list[bool]) -> bool:
        """Whether no word that decides is missing or added, and no negation of the same clause stands up to three words before."""
        _, lost, new = self.differences(words[a:z], form)
        if any(map(decides, lost)) or any(map(decides, new)):
            return False
        for k in range(a - 1, max(-1, a - 4), -1):
            if stops[k]:
                break
            if words[k] in NEGATIONS:
                return False
        return True

    def saving(self, words: list[str], form: int) -> tuple[int, float]:
        """The bytes of the compressed size that the template saves, and their share of it."""
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        saved = alone - len(self.given[form].compress(data))
        return saved, saved / alone

    def runner_up(self, words: list[str], name: str) -> str | None:
        """The other license whose template saves most."""
        data = " ".join(words).encode()
        return min(((len(c.compress(data)), k) for k, c in enumerate(self.given) if self.forms[k][0] != name), default=(0, None))[1]

    def align(self, words: list[str], form: int) -> tuple[int, int, int] | None:
        """(edits, first, end) of the words that the form aligns with by fewest words missing and added, the longest stretch of equal ones; None if too many."""
        want, most = self.forms[form][1], self.edits[form]
        row = [(0, j) for j in range(len(words) + 1)]
        for w in want:
            last, row = row, [(row[0][0] + 1, row[0][1])]
            for j, x in enumerate(words):
                cost, first = min(last[j + 1], row[j])
                row.append(min(last[j], (cost + 1, first)) if x == w else (cost + 1, first))
        cost, first, end = min(((c, a, j) for j, (c, a) in enumerate(row)), key=lambda c: (c[0], c[1] - c[2]))
        return (cost, first, end) if cost <= most and end > first else None

    def match(self, words: list[str], form: int) -> tuple[int, int, list[str], int, int]:
        """(first, end, differences, template words missing, others added) of the words that the form aligns with."""
        want = self.forms[form][1]
        blocks = [b for b in SequenceMatcher(None, want, words, autojunk=False).get_matching_blocks() if b.size]
        if not blocks:
            return 0, 0, [], len(want), 0
        a, z = blocks[0].b, blocks[-1].b + blocks[-1].size
        return a, z, *self.compare(words[a:z], form)

    def compare(self, words: list[str], form: int) -> tuple[list[str], int, int]:
        """(differences, template words missing, others added) between the form and all of ``words``, by fewest of them."""
        said, lost, new = self.differences(words, form)
        return said, len(lost), len(new)

    def differences(self, words: list[str], form: int) -> tuple[list[str], list[str], list[str]]:
        want = self.forms[form][1]
        n, m = len(want), len(words)
        left = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                left[i][j] = left[i + 1][j + 1] + 1 if want[i] == words[j] else max(left[i + 1][j], left[i][j + 1])
        said, i, j, lost, new = [], 0, 0, [], []
        while i < n or j < m:
            a, b = i, j
            while (i < n or j < m) and not (i < n and j < m and want[i] == words[j]):
                if j == m or (i < n and left[i + 1][j] >= left[i][j + 1]):
                    i += 1
                else:
                    j += 1
            if i > a or j > b:
                said.append(f"-{' '.join(want[a:i])} +{' '.join(words[b:j])}")
                lost += want[a:i]
                new += words[b:j]
            while i < n and j < m and want[i] == words[j]:
                i, j = i + 1, j + 1
        return said, lost, new

    def near(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(first, end, form) of candidate blocks around the places where a piece of a form stands."""
        seen = set()
        for k, w in enumerate(words):
            for f, at, piece, anchor in self.pieces.get(w, ()):
                start = k - anchor - at
                if words[max(0, k - anchor) : k - anchor + len(piece)] == piece and (f, start) not in seen:
                    seen.add((f, start))
                    yield max(0, start - self.edits[f]), min(len(words), start + len(self.forms[f][1]) + self.edits[f]), f

    def confirmed(self, words: list[str], least: float, stops: list[bool]) -> list[tuple[int, int, int]]:
        """(first, end, form) of the winners, those that save most bytes first: candidate blocks are compressed with the template, those of
        which it saves ``least`` are aligned with it word by word, and what the wording confirms is compressed again without its neighbours."""
        found = set()
        for lo, hi, f in self.near(words):
            hit = self.align(words[lo:hi], f) if self.saving(words[lo:hi], f)[1] >= least else None
            if hit and self.sure(words, lo + hit[1], lo + hit[2], f, stops):
                cost, a, z = hit[0], lo + hit[1], lo + hit[2]
                found.add((-self.saving(words[a:z], f)[0], cost, -len(self.forms[f][1]), a, z, f))
        return [(a, z, f) for *_, a, z, f in sorted(found)]

    def looks(self, words: list[str], taken: bytearray) -> Iterator[tuple[int, int, int]]:
        """(first, end, form) of places for a form that is not confirmed: where its rarer words stand as close as in itself, of 1.5 times its
        words at most and half of them on for the next, so they grow with the text and a notice lies whole in one."""
        hits = {}
        for k, w in enumerate(words):
            for f in self.rare.get(w, ()) if not taken[k] else ():
                hits.setdefault(f, []).append(k)
        for f, at in hits.items():
            step, before, after, least = self.shape[f]
            n = len(self.forms[f][1])
            size, i = max(3, (3 * n + 1) // 2), 0
            while i < len(at):
                j = i
                while j + 1 < len(at) and at[j + 1] - at[j] <= step and at[j + 1] - at[i] < size:
                    j += 1
                lo, hi = at[i], at[j] + 1
                if len({words[k] for k in at[i : j + 1]}) >= least:
                    while lo > max(0, at[i] - before) and not taken[lo - 1]:
                        lo -= 1
                    while hi < min(len(words), at[j] + 1 + after) and not taken[hi]:
                        hi += 1
                    if not any(taken[lo:hi]):
                        yield lo, hi, f
                if j + 1 < len(at) and at[j + 1] - at[j] <= step:
                    start = at[i] + max(1, n // 2)
                    while i < j + 1 and at[i] < start:
                        i += 1
                else:
                    i = j + 1

    def scan(self, words: list[str], least: float, stops: list[bool], loose: bool = True) -> list[tuple]:
        """The rows of a text: winners that the wording confirms, then, if ``loose``, of the rest what a template saves ``least`` of and what holds half of its rarer words, both without overlaps."""
        taken, out = bytearray(len(words)), []
        for a, z, f in self.confirmed(words, least, stops):
            if not any(taken[a:z]):
                taken[a:z] = b"\1" * (z - a)
                out.append(self.row(words, a, z, f, a, z, self.compare(words[a:z], f), True))
        for shared, own in SHARED.items():
            said = [name for name in own if any(r[2] == name for r in out)]
            if len(said) == 1:
                out = [(*r[:2], said[0], *r[3:]) if r[2] == shared else r for r in out]
        ranked = sorted((-saved, a, z, f) for a, z, f in (self.looks(words, taken) if loose else ()) if z - a > 1 and self.enough(words[a:z], f) for saved, share in [self.saving(words[a:z], f)] if share >= least)
        for _, a, z, f in ranked:
            if not any(taken[a:z]):
                taken[a:z] = b"\1" * (z - a)
                x, y, *rest = self.match(words[a:z], f)
                out.append(self.row(words, a, z, f, a + x, a + y, rest, False))
        return out

    def enough(self, words: list[str], form: int) -> bool:
        rare, least = self.least_rare[form]
        return len(rare.intersection(words)) >= least

    def row(self, words: list[str], a: int, z: int, form: int, first: int, end: int, rest: tuple, ok: bool) -> tuple:
        name, (said, missing, added) = self.forms[form][0], rest
        other = self.runner_up(words[a:z], name)
        return first, end, name, self.saving(words[a:z], form)[1], None if other is None else self.forms[other][0], missing, added, said, ok


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.2, slack: float = 0.1, level: int = 19) -> DataFrame:
    """One row for each notice that a text of ``docs`` seems to hold, on one line or over several, with what its wording differs in.

    Texts in which a piece of a form stands whole are candidates, over line breaks and comment marks, in prose as on a line of its own. Each block around such a piece
    is compressed alone and with the template as a zstandard raw dictionary; where that saves at least ``least`` of the size, the
    wording is compared, and confirms the notice if words missing and added are at most ``slack`` of the form's own, none of them decides (names of licenses,
    numbers of versions, negations), and no negation of the same clause goes before. Winners are ranked by
    the bytes saved of their own words, then fewest differences, then the longest form; of overlapping ones the first counts. Wording that licenses share has the names of all, unless
    something else in the text tells which is meant (SHARED). In what is
    left of texts with a trigger word, blocks with two rarer words of a form as close together as in it, up to 1.5 times as long as the form, are compressed and ranked
    in the same way; those with half of its rarer words are unconfirmed notices. ``reduction`` is the share that the template saves, ``runner_up`` the other license that
    saves most. ``block`` is the line where the notice begins, start_word its place in the words of that line, and end_word
    that and the notice's words, which may go on over the next lines; ``differences`` says what the template has (-) and the text has (+).

    Null and empty texts and those without a notice give no rows, nor does an empty table; repeated rows give repeated results; a null doc_id is carried. Texts
    of any length are read whole, in time in proportion to their length. Columns of other names play no part.
    """
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, level, slack)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_()]
        for batch in batches:
            out = []
            for doc_id, text, loose in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("loose").to_pylist(), strict=True):
                text = text.as_py()
                if loose or scanner.spots(text):
                    words, lines, places, stops = placed_words(text)
                    for a, z, *rest in scanner.scan(words, least, stops, loose):
                        out.append((doc_id, lines[a], places[a], places[a] + z - a, *rest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("text").rlike(TRIGGER).alias("loose")).filter(F.length("text") > 0)
    return found.mapInArrow(run, SCHEMA)
