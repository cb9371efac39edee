"""License scans by conditional compression.

Templates are whole license texts and the usual notices. A document's candidate blocks are its stretches of words that hold
runs of three words of a template (or a notice's sentence of two): runs at most APART words from each other make one block, whatever the lines and
paragraphs, with MARGIN words around. No other block can hold a notice, as a notice has such a run. Each block is compressed by zstandard
alone and with each template that it shares a run with as raw dictionary; templates that make it no smaller are out. The others are
tried by falling size reduction and confirmed by exact wording: the block's words are aligned with the template's, and of the
alignment the densest stretch is the notice, so that prose around it doesn't count. It must agree with the template in AGREE of its words, and hold
AGREE of the words of a sentence that names the license, with all of its naming words (name, version), or of any sentence of LONG words
or more. No naming word may be added in it (one for each SLACK words of a whole text) or follow it. It is `exact` if it is a run of
the template's words, else `modified`, with the words added and missing. A block's other notices stand beside it, none over another.

Cases: null or empty texts have no blocks. Very long texts are read whole; a block may be the whole text. Of several templates the one
with the heaviest stretch is named, then that with the larger size reduction, then the first by name. Years and holders name nothing;
"All rights reserved" beside a license text belongs to its copyright line and is no finding of its own. Repeated rows are scanned
alike; an empty table gives an empty table; doc_id may be null or repeat; other columns are ignored, whatever their names. Spans are
in code points of the text, the end exclusive.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, texts

APART, MARGIN, AGREE, LEAST, LONG, SLACK, BESIDE, NEIGHBOURS = 60, 6, 0.6, 4, 20, 60, 16, 50
WORD = re.compile(r"[\w.+-]*\w")
#: The usual notices of common licenses.
NOTICES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This work is licensed under the GNU Affero General Public License, version 3.",
    "All-Rights-Reserved": "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License. Released under the BSD License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Released under CC0 1.0. Dedicated to the public domain.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License. This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License. Licensed under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose.",
}
#: Whole texts of short licenses, without their copyright lines.
FULL = {
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}
FULL["BSD-3-Clause"] = FULL["BSD-2-Clause"].replace("THIS SOFTWARE IS", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS")
#: Whole texts of long licenses: files of a folder that only the driver reads. Licenses without a file are known by their notices.
FOLDER = "/usr/share/common-licenses"
FILES = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
#: Words that tell one license from another; a block must not differ in them.
NAMING = re.compile(r"^(?:affero|[al]?gpl(?:[v\d.-].*)?|apache(?:-.*)?|bsd(?:-.*)?|by|by-nc|by-nd|by-sa|by-nc-.*|cc|cc-.*|cc0.*|isc|lesser|mit|mozilla|mpl(?:-.*)?|unlicense|noncommercial|noderivatives|sharealike|attribution\S*)$")
#: A number is a version, and so names a license, after one of these words; years are none.
NUMBER, VERSIONED, YEAR = re.compile(r"^v?[0-9][\w.+-]*$"), re.compile(r"^(?:v|version|versions|licen[cs]e|international|generic|unported|public|zero)$"), re.compile(r"^(?:19|20)\d\d(?:-(?:19|20)?\d\d)?$")
SENTENCE = re.compile(r"(?<=[.!?;])\s+(?=[^\sa-z0-9])")


def names(words: list[str], i: int) -> bool:
    """Whether word i tells one license from another."""
    if NUMBER.match(words[i]):
        return not YEAR.match(words[i]) and (words[i][0] == "v" or i > 0 and bool(VERSIONED.match(words[i - 1]) or NAMING.match(words[i - 1])))
    return bool(NAMING.match(words[i]))


def templates(folder: str | None = FOLDER) -> dict[str, list[str]]:
    """Texts by license: its notices with the identifiers of SPDX, its whole text."""
    out: dict[str, list[str]] = defaultdict(list)
    for name, text in NOTICES.items():
        ids = [] if name == "All-Rights-Reserved" else [name, *([f"{name}-only", f"{name}-or-later"] if "GPL" in name else [])]
        out[name].append(" ".join([text, *(f"SPDX-License-Identifier: {i}." for i in ids)]))
    for name, text in FULL.items():
        out[name].append(text)
    for name, file in FILES.items():
        if folder and os.path.exists(path := f"{folder}/{file}"):
            with open(path, encoding="utf-8") as f:
                out[name].append(f.read())
    return dict(out)


def lower_words(text: str) -> list[str]:
    """The words of a text, lower-cased one by one."""
    return "\0".join(WORD.findall(text)).lower().split("\0") if text else []


class Template:
    """Words of one text, the places of its runs of three, its sentences."""

    def __init__(self, name: str, text: str, options: dict) -> None:
        self.name, self.words = name, lower_words(text)
        known = zstandard.ZstdCompressionDict(" ".join(text.lower().split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=options["level"])
        self.compress = zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False).compress
        self.runs: dict[tuple, list[int]] = defaultdict(list)
        for i in range(len(self.words) - 2):
            self.runs[tuple(self.words[i : i + 3])].append(i)
        self.sentences, at = [], 0  # (first word, end, naming words)
        for sentence in SENTENCE.split(text):
            end = at + len(WORD.findall(sentence))
            self.sentences.append((at, end, {i for i in range(at, end) if names(self.words, i)}))
            if end - at == 2:
                self.runs[tuple(self.words[at:end])].append(at)
            at = end
        self.starts, self.ends = {s for s, _, _ in self.sentences}, {e for _, e, _ in self.sentences}
        self.named = any(naming for *_, naming in self.sentences)

    def shared(self, own: list[str]) -> list[tuple[int, int, int]]:
        """Runs (place in own, place here, words) that stand in both, the longest at each place of own, of equal ones that which is a sentence here or one's beginning or end, then that nearest the diagonal."""
        found, i, diagonal = [], 0, 0
        while i < len(own) - 1:
            places = self.runs.get(tuple(own[i : i + 3])) or self.runs.get(tuple(own[i : i + 2]))
            if not places:
                i += 1
                continue
            best = (0, 0, 0, 0)
            for b in places:
                n = 2
                while i + n < len(own) and b + n < len(self.words) and own[i + n] == self.words[b + n]:
                    n += 1
                best = max(best, (n, (b in self.starts) + (b + n in self.ends), -abs(b - i - diagonal), b))
            found.append((i, best[3], best[0]))
            i, diagonal = i + best[0], best[3] - i
        return found

    def stretches(self, own: list[str]) -> list[tuple[float, int, int, float, list[str], list[str]]]:
        """Weight, first word, end, agreement, words added and missing of the dense stretches of own that this text confirms.

        Runs are chained in the order of both texts. A word of a run weighs 1 - AGREE, a word added between runs -AGREE, a word of the template missing
        there AGREE - 1 (2 * LONG of them at most).
        """
        found = self.shared(own)
        weights, before = [], []
        for x, (a, b, n) in enumerate(found):
            best, of = 0.0, -1
            for y in range(x - 1, max(-1, x - NEIGHBOURS - 1), -1):
                p = found[y]
                if p[1] + p[2] <= b:
                    w = weights[y] - AGREE * (a - p[0] - p[2]) - (1 - AGREE) * min(b - p[1] - p[2], 2 * LONG)
                    if w > best + 1e-9:
                        best, of = w, y
            weights.append(best + (1 - AGREE) * n)
            before.append(of)
        out, free = [], [True] * len(found)
        for x in sorted(range(len(found)), key=lambda x: (-weights[x], x)):
            parts = []
            while x >= 0 and free[x]:
                parts.append(found[x])
                free[x] = False
                x = before[x]
            if parts and (confirmed := self._confirmed(own, parts[::-1])):
                out.append(confirmed)
        return out

    def _confirmed(self, own: list[str], parts: list[tuple[int, int, int]]) -> tuple[float, int, int, float, list[str], list[str]] | None:
        start, end = parts[0][0], parts[-1][0] + parts[-1][2]
        same, used = {a + i for a, _, n in parts for i in range(n)}, {b + i for _, b, n in parts for i in range(n)}
        strange = sum(names(own, i) for i in range(start, end) if i not in same) + (end < len(own) and names(own, end))
        agree = len(same) / (end - start)
        if strange * SLACK > (len(same) if len(same) > SLACK else 0) or agree < AGREE:
            return None
        low, high = min(used), max(used) + 1
        for s, e, naming in self.sentences:
            if s >= high or e <= low:
                continue
            held = sum(i in used for i in range(s, e))
            names_it = naming <= used and (naming or not self.named) and e - s > 1 and held >= max(AGREE * (e - s), min(LEAST, e - s))
            if names_it or held >= max(LONG, AGREE * (e - s)):
                added, missing = [own[i] for i in range(start, end) if i not in same], [self.words[i] for i in range(low, high) if i not in used]
                return (1 - AGREE) * len(same) - AGREE * len(added) - (1 - AGREE) * min(len(missing), 2 * LONG), start, end, agree, added, missing
        return None


class Scanner:
    """Finds candidate blocks, compresses them with templates as dictionaries and confirms by wording."""

    def __init__(self, known: dict[str, list[str]]) -> None:
        options = {"level": 3, "write_content_size": False, "write_checksum": False}
        self.alone = zstandard.ZstdCompressor(**options)
        self.templates = [Template(n, t, options) for n, all_ in sorted(known.items()) for t in all_]
        self.by_run: dict[tuple, set[int]] = defaultdict(set)
        for k, t in enumerate(self.templates):
            for run in t.runs:
                self.by_run[run].add(k)
        self.pairs = {r for r in self.by_run if len(r) == 2}

    def blocks(self, words: list[str]) -> list[tuple[int, int, set[int]]]:
        """(first word, end, templates that share a run) of the candidate blocks."""
        runs = self.by_run
        hits = [i for i, run in enumerate(zip(words, words[1:], words[2:], strict=False)) if run in runs]
        if self.pairs:
            hits = sorted({*hits, *(i for i, run in enumerate(zip(words, words[1:], strict=False)) if run in self.pairs)})
        out: list[tuple[int, int, set[int]]] = []
        for i in hits:
            shared = runs.get(tuple(words[i : i + 3]), set()) | (runs.get(tuple(words[i : i + 2]), set()) if self.pairs else set())
            if out and i - out[-1][1] <= APART:
                out[-1] = (out[-1][0], i + 3, out[-1][2] | shared)
            else:
                out.append((i, i + 3, set(shared)))
        # margins of blocks may not overlap
        return [(max(s - MARGIN, 0), min(e + MARGIN, len(words)), k) for s, e, k in out]

    def reductions(self, block: str, among: set[int] | None = None) -> list[tuple[float, int]]:
        """(reduction, template), the largest first."""
        raw = " ".join(block.lower().split()).encode()
        plain = len(self.alone.compress(raw))
        return sorted(((1 - len(self.templates[k].compress(raw)) / plain, k) for k in (range(len(self.templates)) if among is None else among)), key=lambda r: (-r[0], r[1]))

    def notices(self, text: str, at: list[tuple[int, int]], own: list[str], first: int, end: int, among: set[int] | None = None) -> list[tuple[int, int, tuple]]:
        """(first word, end, (license, verdict, reduction, agreement, added, missing)) of the notices between two words, by place."""
        ranked, words = [], own[first:end]
        for reduction, k in self.reductions(text[at[first][0] : at[end - 1][1]], among):
            if reduction > 0:
                name = self.templates[k].name
                for weight, start, stop, agree, added, missing in self.templates[k].stretches(words):
                    ranked.append((-round(weight, 6), -reduction, name, first + start, first + stop, (name, "modified" if added or missing else "exact", round(reduction, 4), round(agree, 4), added, missing)))
        out: list[tuple[int, int, tuple]] = []
        for *_, start, stop, match in sorted(ranked, key=lambda r: r[:5]):
            i = bisect_left(out, stop, key=lambda o: o[0])
            if i == 0 or out[i - 1][1] <= start:
                out.insert(i, (start, stop, match))
        return out

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, tuple]]]:
        """How many candidate blocks a text has, and its notices by place, in code points."""
        own = lower_words(text)
        blocks = self.blocks(own)
        if not blocks:
            return 0, []
        at = [m.span() for m in WORD.finditer(text)]
        found = [n for s, e, among in blocks for n in self.notices(text, at, own, s, e, among)]
        return len(blocks), self.placed(text, at, found)

    @staticmethod
    def placed(text: str, at: list[tuple[int, int]], found: list[tuple[int, int, tuple]]) -> list[tuple[int, int, tuple]]:
        """Notices in code points, without those that are another's copyright line."""
        beside = lambda n: any(o[2][0] != n[2][0] and (0 <= o[0] - n[1] <= BESIDE or 0 <= n[0] - o[1] <= BESIDE) for o in found)
        left = [n for n in found if n[2][0] != "All-Rights-Reserved" or not beside(n)]
        return [(at[s][0], (e_ := at[e - 1][1]) + (text[e_ : e_ + 1] == "."), m) for s, e, m in left]


def scan(docs: DataFrame, known: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, blocks (how many were candidates) and found: an array of license, verdict, start, end, reduction, agreement, added, missing. No shuffle.

    known: texts by license, those of templates() else; they are the caller's list and go to each task.
    """
    kind, chosen = docs.schema["doc_id"].dataType.simpleString(), known or templates()

    def make():
        scanner = Scanner(chosen)

        def step(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch.column("doc_id"), "blocks": [], "found": []}
            for text in texts(batch):
                n, found = scanner.scan(text)
                out["blocks"].append(n)
                out["found"].append([dict(zip(("license", "verdict", "start", "end", "reduction", "agreement", "added", "missing"), (m[0], m[1], s, e, *m[2:4], " ".join(m[4]), " ".join(m[5])), strict=True)) for s, e, m in found])
            return out

        return step

    found = "array<struct<license:string,verdict:string,start:int,end:int,reduction:double,agreement:double,added:string,missing:string>>"
    return mapped(docs.select("doc_id", F.col("text").cast("string").alias("text")), make, f"doc_id {kind}, blocks int, found {found}")
