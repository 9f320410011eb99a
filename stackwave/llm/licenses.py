"""License scans: winnowed fingerprints of templates, an inverted index, and banded alignment.

Terms are lower-cased runs of letters and digits.  Of each template's ``GRAM``-term hashes the least of every ``WINDOW`` in a row is a
fingerprint, so any ``GRAM + WINDOW - 1`` terms in a row of the template hold one.  Templates of up to ``SHORT`` terms are indexed by all grams of the
length that every text with ``COVERAGE`` of their terms in order must hold, so no change that the alignment accepts hides them.  Every
document gram that is in the inverted index names a template and a diagonal.  Near diagonals of one template are aligned together in
a band (local alignment: equal terms +2, exchanged, missing or added terms -1); the alignment gives the terms matched, their share of the template
(coverage), the edits and the span in the document.

A span is reported when its coverage is ``COVERAGE`` or more and nothing speaks for another license: all terms of the template that tell
licenses apart (``MARKS``: names, versions, conditions) are matched, and no such term of another license stands unmatched in the span.  Where spans
of several templates overlap, that with the most matched terms less edits stays.

Null and empty texts have no spans; texts are scanned whole; repeated rows get equal results; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import masked_hashes
from .textkit import SEPARATORS, HashTable, Words, lowered, row_slices, string_buffers

GRAM, WINDOW, COVERAGE, SHORT = 4, 3, 0.8, 40

#: Public license texts and notices.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = "provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_GNU = "This {thing} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{stop2} either version {version} of the License, or (at your option) any later version."
_GNU_WARRANTY = "This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
#: Phrases that name a license.
_PHRASES = ("Released under the {}", "Licensed under the {}", "This project is licensed under the {}", "This work is licensed under the {}", "Distributed under the {}")


def _named(*names: str) -> tuple[str, ...]:
    return tuple(p.format(n) for p in _PHRASES for n in names)


def _gnu(name: str, version: str) -> tuple[str, ...]:
    things = ("program", "library") if "Lesser" in name else ("program",)
    notices = [_GNU.format(thing=t, name=name, version=version, stop=":", stop2=",") for t in things]
    return (*notices, *(f"{n} {_GNU_WARRANTY.format(thing=t, name=name)}" for n, t in zip(notices, things, strict=True)), *_named(f"GNU {name}, version {version}", f"GNU {name} v{version}"))


def _creative(code: str, name: str) -> tuple[str, ...]:
    full = f"Creative Commons {name} 4.0 International License"
    return (f"Licensed under CC {code} 4.0", f"This work is licensed under CC {code} 4.0", f"Licensed under a {full}", f"This work is licensed under a {full}. To view a copy of this license, visit http://creativecommons.org/licenses/{code.lower()}/4.0/", f"This work is licensed under a {full}")


TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (_GRANT, f"{_GRANT} {_MIT_WARRANTY}", *_named("MIT License")),
    "Apache-2.0": (_APACHE, *_named("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License")),
    "GPL-3.0": _gnu(_GPL, "3"),
    "GPL-2.0": _gnu(_GPL, "2"),
    "LGPL-3.0": _gnu(_LGPL, "3"),
    "LGPL-2.1": _gnu(_LGPL, "2.1"),
    "AGPL-3.0": _gnu(_AGPL, "3"),
    "BSD-2-Clause": (f"{_BSD_START} {_BSD_WARRANTY}", *_named("BSD 2-Clause License", "Simplified BSD License")),
    "BSD-3-Clause": (f"{_BSD_START} {_BSD_NAMES} {_BSD_WARRANTY}", f"{_BSD_START} {_BSD_NAMES}", *_named("BSD 3-Clause License", "New BSD License")),
    "MPL-2.0": (_MPL, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", *_named("Mozilla Public License, version 2.0", "Mozilla Public License 2.0")),
    "ISC": (f"{_ISC_GRANT}, {_ISC_NOTICE}", f"{_ISC_GRANT}, {_ISC_NOTICE} {_ISC_WARRANTY}", *_named("ISC License")),
    "0BSD": (f"{_ISC_GRANT}. {_ISC_WARRANTY}",),
    "Zlib": (_ZLIB, *_named("zlib License")),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", _UNLICENSE),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", *_named("CC0 1.0 Universal License")),
    "CC-BY-4.0": _creative("BY", "Attribution"),
    "CC-BY-SA-4.0": _creative("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _creative("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-ND-4.0": _creative("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _creative("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _creative("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "proprietary": ("All rights reserved",),
}
#: Terms that tell licenses apart: names and conditions, which no span of another license may hold unmatched, and versions.
MARKS = frozenset("mit apache gpl lgpl agpl lesser library affero bsd mozilla mpl isc zlib cc0 by sa nc nd attribution sharealike noncommercial noderivatives simplified new clause".split())
_VERSION = re.compile(r"v?\d{1,2}")
#: Marks that are common words, and so count in templates only.
_COMMON = frozenset("library by new clause".split())


def from_folder(folder: str) -> dict[str, tuple[str, ...]]:
    """Templates from the files of a folder of the driver's, one full license text each, by file name."""
    return {f.name: (f.read_text("utf-8", "replace"),) for f in sorted(Path(folder).iterdir()) if f.is_file() and not f.is_symlink()}


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash (the last of equals) of every ``window`` in a row."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.zeros(0, int)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(1))


def grams(marks: np.ndarray) -> tuple[int, np.ndarray]:
    """Length and places of the grams of a short template (``marks``: its marked terms) of which every accepted text holds one.

    A text with ``COVERAGE`` of n terms in order holds some run of (n - missing) / (missing + 1) terms.  When one term may be missing, that isn't a mark, the
    run with a mark in it is at least as long as the shorter of the parts up to the mark and from the mark on.
    """
    n = len(marks)
    missing = n - math.ceil(COVERAGE * n - 1e-9)
    size = max(1, min(GRAM, -(-(n - missing) // (missing + 1))))
    at = np.flatnonzero(marks)
    places = np.arange(max(0, n - size + 1))
    if missing == 1 and len(at):
        reach = np.minimum(at + 1, n - at)
        mark, longest = int(at[reach.argmax()]), min(GRAM, int(reach.max()))
        if longest >= size:
            size, places = longest, np.arange(max(0, mark - longest + 1), min(mark, n - longest) + 1)
    return size, places


def align(document: np.ndarray, template: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Local alignment on diagonals low to high (document place less template place): matched places of the template, those of the document, edits."""
    width, n = high - low + 1, len(document)
    index, score, best, end = np.arange(width), np.zeros(width, np.int64), 0, (0, 0)
    steps = np.zeros((len(template), width), np.int8)
    for i, term in enumerate(template):
        j = index + i + low
        inside = (j >= 0) & (j < n)
        same = np.zeros(width, bool)
        same[inside] = document[j[inside]] == term
        diagonal, up = score + np.where(same, 2, -1), np.append(score[1:], 0) - 1
        base = np.where(inside, np.maximum(np.maximum(diagonal, up), 0), 0)
        new = np.where(inside, np.maximum.accumulate(base + index) - index, 0)
        steps[i] = np.where(new <= 0, 0, np.where(new > base, 3, np.where(diagonal == base, 1, 2)))
        score = new
        if (top := int(new.max())) > best:
            best, end = top, (i, int(new.argmax()))
    i, d, edits = *end, 0
    mine, theirs = [], []
    while best and i >= 0 and (step := steps[i, d]):
        if step == 1:
            if document[i + low + d] == template[i]:
                mine.append(i)
                theirs.append(i + low + d)
            else:
                edits += 1
            i -= 1
        elif step == 2:
            edits, i, d = edits + 1, i - 1, d + 1
        else:
            edits, d = edits + 1, d - 1
        if d >= width or d < 0:
            break
    return np.array(mine[::-1], np.int64), np.array(theirs[::-1], np.int64), edits


class LicenseIndex:
    """Templates and the inverted index of their fingerprints."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]]):
        flat = [(name, text) for name, texts in templates.items() for text in dict.fromkeys(texts)]
        self.names = [n for n, _ in flat]
        words, spelled = self._words(pa.array([t for _, t in flat], pa.string()))
        self.terms = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        named = [np.array([w in MARKS or bool(_VERSION.fullmatch(w)) for w in s], bool) for s in spelled]
        short = [len(t) <= SHORT for t in self.terms]
        self.marks = [m if s else np.zeros(len(m), bool) for m, s in zip(named, short, strict=True)]
        self.foreign = np.unique(self._words(pa.array([" ".join(sorted(MARKS - _COMMON))]))[0].hash)
        index: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        wanted = [grams(m) if s else (GRAM, None) for m, s in zip(self.marks, short, strict=True)]
        for size in sorted({w[0] for w in wanted}):
            at, hashes = masked_hashes(words, "1" * size)
            for t, (own, places) in enumerate(wanted):
                if own != size:
                    continue
                mine = np.flatnonzero(words.row[at] == t)
                mine = mine[winnow(hashes[mine])] if places is None else mine[np.isin(at[mine] - words.first[t], places)]
                for k in mine:
                    index[size][int(hashes[k])].append((t, int(at[k] - words.first[t])))
        self.index = []
        for size, entries in index.items():
            keys = np.array(list(entries), np.uint64)
            self.index.append((size, HashTable(keys), list(entries.values())))

    @staticmethod
    def _words(texts: pa.Array) -> tuple[Words, list[list[str]]]:
        raw, offs = string_buffers(lowered(texts))
        words = Words(raw, offs, SEPARATORS)
        data = raw[offs[0] : offs[-1]].tobytes()
        spelled = [data[a:b].decode() for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]
        return words, [spelled[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[str, int, int, int, float]]]]:
        """(row, [(license, first term, end term, matched terms, coverage)]) of rows with a license."""
        raw, offs = string_buffers(lowered(texts))
        for lo, hi in row_slices(offs):
            words = Words(raw, offs[lo : hi + 1], SEPARATORS)
            starts: dict[tuple[int, int], set[int]] = defaultdict(set)
            for size, table, entries in self.index:
                at, hashes = masked_hashes(words, "1" * size)
                found, key = table.find(hashes)
                for p, k in zip(at[found].tolist(), key.tolist(), strict=True):
                    row = int(words.row[p])
                    for t, place in entries[k]:
                        starts[row, t].add(p - place - int(words.first[row]))
            rows: dict[int, list[tuple[str, int, int, int, float, int]]] = defaultdict(list)
            for (row, t), diagonals in starts.items():
                rows[row] += self._spans(words.hash[words.first[row] : words.first[row + 1]], t, sorted(diagonals))
            for row in sorted(rows):
                if spans := _without_overlaps(rows[row]):
                    yield lo + row, spans

    def _spans(self, document: np.ndarray, t: int, diagonals: list[int]) -> list[tuple[str, int, int, int, float, int]]:
        template = self.terms[t]
        band, out, k = max(2, len(template) // 10), [], 0
        while k < len(diagonals):
            e = k + 1
            while e < len(diagonals) and diagonals[e] - diagonals[k] <= band:
                e += 1
            low, high = diagonals[k] - band, diagonals[e - 1] + band
            base = max(0, low)
            part = document[base : max(base, high + len(template))]
            k, there = e, np.isin(template, part)
            if there.sum() < COVERAGE * len(template) or not there[self.marks[t]].all():
                continue  # whatever the alignment, too few terms or a mark would be missing
            mine, theirs, edits = align(part, template, low - base, high - base)
            if len(mine) >= COVERAGE * len(template) and self._sure(part, t, mine, theirs):
                out.append((self.names[t], int(theirs[0]) + base, int(theirs[-1]) + 1 + base, len(mine), len(mine) / len(template), edits))
        return out

    def _sure(self, part: np.ndarray, t: int, mine: np.ndarray, theirs: np.ndarray) -> bool:
        marks = self.marks[t].copy()
        marks[mine] = False
        between = np.ones(int(theirs[-1] + 1 - theirs[0]), bool)
        between[theirs - theirs[0]] = False
        return not marks.any() and not np.isin(part[theirs[0] : theirs[-1] + 1][between], self.foreign).any()


def _without_overlaps(spans: list[tuple[str, int, int, int, float, int]]) -> list[tuple[str, int, int, int, float]]:
    kept: list[tuple[str, int, int, int, float]] = []
    for s in sorted(set(spans), key=lambda s: (s[5] - s[3], -s[4], s)):
        if all(s[2] <= k[1] or s[1] >= k[2] for k in kept):
            kept.append(s[:5])
    return sorted(kept, key=lambda s: (s[1], s[0]))


_FIELDS = ("license", "first", "end", "matched", "coverage")
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())]))


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """Per row of ``docs``: doc_id, licenses (distinct, sorted), spans (license, terms first to end, matched terms, coverage)."""
    index = LicenseIndex(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans: list[list] = [[] for _ in range(b.num_rows)]
            for row, found in index.scan(b.column(1)):
                spans[row] = found
            rows = [[dict(zip(_FIELDS, s, strict=True)) for s in x] for x in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted({s[0] for s in x}) for x in spans], pa.list_(pa.string())), pa.array(rows, _ARROW)], names=["doc_id", "licenses", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, licenses array<string>, spans array<struct<license:string,first:long,end:long,matched:long,coverage:double>>")
