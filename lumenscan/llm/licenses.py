"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

A text is normalised (lower case, words of letters and digits, copyright clauses left out) and turned into word bigrams.
Its windows of every place and size are scored as multisets against each template; per template the best window is taken,
then the best that doesn't overlap it, and so on. A line, a paragraph and the whole text are such windows too. With sizes
a and b no score can exceed 2 min(a, b) / (a + b), so a window of score s shares at least a s / (2 - s) bigrams with a
template of size a and has at most a (2 - s) / s: templates the text shares fewer with are pruned before any window is
scored, and windows start only where so many shared bigrams lie near enough. Nothing that reaches ``min_score`` is lost.

One narrow pass, whole texts, nothing shuffled; the templates (a fixed list) travel with the function.

Edge cases: null, empty and wordless texts match nothing and give a row with n_matches 0. Ties between templates go to
the first by name. Repeated rows are scanned each on its own. Very long texts are scanned whole. An empty table gives no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenscan.llm._common import text_chunks

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_UNLICENSE_REST = """ In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org/"""
_CC = "Licensed under CC {x} 4.0."
_CC_LONG = "This work is licensed under a Creative Commons {x} 4.0 International License."
_CC_NAMES = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: (licence, text) of the full notices and of the one-line statements in use.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", _BSD2),
    ("GPL-2.0-or-later", _GPL.format(v=2)),
    ("GPL-3.0-or-later", _GPL.format(v=3)),
    ("LGPL-3.0-or-later", _GPL.replace("General Public", "Lesser General Public").format(v=3)),
    ("AGPL-3.0-or-later", _GPL.replace("General Public", "Affero General Public").format(v=3)),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    *[(f"CC-{x}-4.0", _CC.format(x=x)) for x in _CC_NAMES],
    *[(f"CC-{x}-4.0", _CC_LONG.format(x=n)) for x, n in _CC_NAMES.items()],
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]
_TEXTS = Path(__file__).parent / "license_texts"
_BSD3_FULL = (_TEXTS / "BSD-3-Clause.txt").read_text("utf-8")
#: The full texts, each in a file named by its licence, and BSD with two clauses, which is the one with three without the third.
TEMPLATES += [(f.stem, f.read_text("utf-8")) for f in sorted(_TEXTS.glob("*.txt"))]
TEMPLATES += [("BSD-2-Clause", re.sub(r"(?s)3\. Neither.*?permission\.", "", _BSD3_FULL)), ("Unlicense", _UNLICENSE + _UNLICENSE_REST)]
_WORD = re.compile(r"[^\W_]+(?:[.][0-9]+)*")
#: A copyright clause: to the end of its sentence or line, or to the words that start a statement of licence.
_COPYRIGHT = re.compile(r"(?:copyright[ \t]+(?:\(c\)|©|[0-9]{4})|©)[^\n]*?(?=[.;](?:\s|$)|\W(?:licensed|released|distributed|available|permission|redistribution|this|under|spdx)\b|$)(?:[.;]?[ \t]*all rights reserved)?", re.M)


@dataclass(frozen=True)
class LicenseOptions:
    min_score: float = 0.85
    templates: tuple = tuple(TEMPLATES)


def _plain(text: str) -> str:
    """Lower case, copyright clauses blanked: as long as text.lower()."""
    low = text.lower()
    return _COPYRIGHT.sub(lambda m: " " * len(m[0]), low) if "copyright" in low or "©" in low else low


def normalised(text: str) -> list[str]:
    return _WORD.findall(_plain(text))


class Scanner:
    def __init__(self, o: LicenseOptions):
        self.o, self.names, self.bigrams, self.words = o, [], [], []
        self.ids: dict[tuple[str, str], int] = {}
        for name, text in sorted(o.templates):
            words = normalised(text)
            grams = Counter(zip(words, words[1:]))
            for g in grams:
                self.ids.setdefault(g, len(self.ids))
            self.names.append(name), self.bigrams.append(grams), self.words.append(words)
        #: How often each bigram is in each template.
        self.caps = np.zeros((len(self.ids), len(self.names)), np.int32)
        for t, grams in enumerate(self.bigrams):
            for g, n in grams.items():
                self.caps[self.ids[g], t] = n
        self.sizes = self.caps.sum(0)
        # With b bigrams of which m are shared, 2 m / (a + b) >= s needs m >= a s / (2 - s), as b >= m, and b <= a (2 - s) / s, as m <= a
        s = o.min_score
        self.need = np.maximum(1, np.ceil(self.sizes * s / (2 - s) - 1e-9)).astype(int)
        self.most = np.floor(self.sizes * (2 - s) / s + 1e-9).astype(int)
        self._parts: dict[int, set[int]] = {}

    def best(self, segment: str) -> tuple[str, float] | None:
        """The licence of the best template for a whole segment, if it reaches min_score."""
        words = normalised(segment)
        n = len(words) - 1
        grams, found = Counter(zip(words, words[1:])), None
        for t in np.flatnonzero((self.need <= n) & (n <= self.most)).tolist() if n > 0 else ():
            own = self.bigrams[t]
            score = 2 * sum(min(c, own[g]) for g, c in grams.items() if g in own) / (n + int(self.sizes[t]))
            if score >= self.o.min_score and (found is None or score > found[1]):
                found = (self.names[t], score)
        return found

    def _candidates(self, words: list[str]) -> list[tuple[float, int, int, int]]:
        """(score, template, start, end) of the best windows of each template, disjoint within one, in numbers of bigrams."""
        ids, pairs = self.ids, list(zip(words, words[1:]))
        at = [p for p, g in enumerate(pairs) if g in ids]
        if len(at) < self.need.min():
            return []
        grams, places = np.fromiter((ids[pairs[p]] for p in at), np.int64, len(at)), np.array(at, np.int64)
        known, count = np.unique(grams, return_counts=True)
        shared = np.minimum(self.caps[known], count[:, None]).sum(0)
        return [(*w[:1], t, *w[1:]) for t in np.flatnonzero(shared >= self.need).tolist() for w in self._windows(t, grams, places)]

    def _windows(self, t: int, grams: np.ndarray, places: np.ndarray) -> list[tuple[float, int, int]]:
        """(score, start, end): the best window of all sizes, then the best of those that don't overlap it, and so on."""
        own = self.caps[grams, t] > 0
        g, at, size, need, most = grams[own], places[own], int(self.sizes[t]), int(self.need[t]), int(self.most[t])
        starts = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < most)
        if not len(starts):
            return []
        # A bigram counts in a window as often as in the template: where the one so many occurrences before lies ahead of the window
        order = np.argsort(g, kind="stable")
        back = np.arange(len(g)) - self.caps[g[order], t]
        same = (back >= 0) & (g[order][np.maximum(back, 0)] == g[order])
        before = np.full(len(g), -1)
        before[order[same]] = at[order[back[same]]]

        def window(k: int, limit: int) -> None:
            i = int(at[k])
            to = int(np.searchsorted(at, min(i + most, limit)))
            score = 2 * np.cumsum(before[k:to] < i) / (at[k:to] - i + 1 + size)
            e = int(np.argmax(score))
            if score[e] >= self.o.min_score:
                heapq.heappush(heap, (-float(score[e]), i, int(at[k + e]) + 1, k))

        heap: list[tuple[float, int, int, int]] = []
        for k in starts.tolist():
            window(k, 1 << 62)
        taken: list[tuple[int, int]] = []
        found = []
        while heap:
            score, i, end, k = heapq.heappop(heap)
            n = bisect.bisect_right(taken, (i, 1 << 62))
            if n and taken[n - 1][1] > i:
                continue
            if n < len(taken) and taken[n][0] < end:
                if at[k] < taken[n][0]:
                    window(k, taken[n][0])
                continue
            taken.insert(n, (i, end))
            found.append((-score, i, end))
        return found

    def parts(self, t: int) -> set[int]:
        """The templates found in the text of a longer one, as the notice to apply at the end of a licence."""
        if t not in self._parts:
            self._parts[t] = {u for _, u, _, _ in self._candidates(self.words[t]) if self.sizes[u] < self.sizes[t]}
        return self._parts[t]

    def windows(self, words: list[str]) -> list[tuple[str, float, int, int]]:
        """(licence, score, first word, last word). Of windows that cover the same half of one another the best stays, the longer of equal ones."""
        found = sorted(self._candidates(words), key=lambda f: (-f[0], f[2] - f[3], f[1]))
        if not found:
            return []
        covered, kept, by = np.zeros(len(words), bool), [], {}
        for score, t, i, j in found:
            if 2 * int(covered[i:j].sum()) < j - i:
                covered[i:j] = True
                kept.append((score, t, i, j))
                by.setdefault(t, np.zeros(len(words), bool))[i:j] = True
        inside = lambda t, i, j: any(u != t and 2 * int(by[u][i:j].sum()) >= j - i and t in self.parts(u) for u in by)
        return [(self.names[t], score, i, j) for score, t, i, j in kept if not inside(t, i, j)]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, score, start, end) of every window that matches, in order; the longer first at one place."""
        if not text:
            return []
        plain = _plain(text)
        found = self.windows(_WORD.findall(plain))
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(plain)]
        at = range(len(text) + 1)
        if len(plain) != len(text):  # some letters are longer in lower case
            at = [n for n, x in enumerate(text) for _ in x.lower()] + [len(text)]
        return sorted(((name, score, at[spans[i][0]], at[spans[j][1] - 1] + 1) for name, score, i, j in found), key=lambda f: (f[2], -f[3]))


@functools.cache
def _scanner(o: LicenseOptions) -> Scanner:
    return Scanner(o)


def scan_documents(docs: DataFrame, o: LicenseOptions = LicenseOptions(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_matches, licenses (distinct, sorted), best (highest score) and matches of every document."""
    schema = "doc_id long, n_matches long, licenses array<string>, best double, matches array<struct<license:string,score:double,start:long,end:long>>"
    kind = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(o)
        for batch in batches:
            for b in text_chunks(batch, "text"):
                found = [scanner.scan(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array([sorted({x[0] for x in f}) for f in found], pa.list_(pa.string())),
                        pa.array([max((x[1] for x in f), default=0.0) for f in found], pa.float64()),
                        pa.array([[dict(zip(("license", "score", "start", "end"), x)) for x in f] for f in found], kind),
                    ],
                    names=["doc_id", "n_matches", "licenses", "best", "matches"],
                )

    return docs.selectExpr(f"cast(`{key}` as long) doc_id", f"`{text}` text").mapInArrow(run, schema)
