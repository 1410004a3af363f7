r"""License scans by patience alignment.

A license template and a stretch of text are aligned as word sequences: equal words at both ends are
matched, the words that occur exactly once in the text stretch and exactly once in the template are
anchors, the longest increasing subsequence of the anchors is kept, and the gaps between them are aligned in
the same way. Coverage is the share of the template's words that are matched.

Where to align: an occurrence of a template is a stretch that begins with one of its words, is one of `SIZES`
times as long as the template, has coverage of at least `least`, and in which each of the template's marks (the
words that tell it from its relatives, such as a version) is matched. Every such stretch is looked at: a stretch
with that coverage holds a known number of the template's distinct signal words (those not in the list of common
words) and has that many words in common with it, both necessary, so only stretches that fail these are not
aligned. From left to right, of the stretches that begin before the first one found ends, the one with the highest
coverage is the occurrence (the first of equals); the search goes on behind it, so repeated notices are found each.

Where occurrences of several templates overlap, the one that explains the most words stays (then the higher
coverage, then the name): a whole text hides the line that it holds, and a license hides one that shares words
with it.

Defined results: words are runs of ASCII letters and digits with inner dots or dashes, lower-cased, and other
letters; null or empty text has no words and no match; repeated rows each give a row; other columns are
ignored. `licenses` lists every match as name:first word:end word:coverage in percent, by first word.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barline.llm.common import batch, bounded_batches, documents, strings, table

# Notices and texts of public licenses, each with its marks.
TEMPLATES = {
    "Apache-2.0-line": ("Licensed under the Apache License, Version 2.0.", "apache"),
    "MIT-line": ("Released under the MIT License.", "mit"),
    "BSD-line": ("Released under the BSD License.", "bsd"),
    "CC-BY-4.0-line": ("Licensed under CC BY 4.0.", "cc by 4.0"),
    "CC-BY-SA-4.0-line": ("Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    "CC-BY-NC-4.0-line": ("Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    "GPL-2.0-line": ("This work is licensed under the GNU General Public License, version 2.", "gnu 2"),
    "GPL-3.0-line": ("This work is licensed under the GNU General Public License, version 3.", "gnu 3"),
    "LGPL-3.0-line": ("This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    "AGPL-3.0-line": ("This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    "Apache-2.0": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
        "apache",
    ),
    "MIT": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
        "sublicense",
    ),
    "MIT-grant": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions""",
        "sublicense",
    ),
    "BSD-2-Clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        "redistribution",
    ),
    "BSD-3-Clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior
        written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        "redistribution endorse",
    ),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        "fee",
    ),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions""",
        "alter",
    ),
    "GPL-2.0": (
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
        "gnu 2",
    ),
    "GPL-3.0": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
        "gnu 3",
    ),
    "LGPL-2.1": (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
        (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU Lesser General Public License for more details.""",
        "gnu lesser 2.1",
    ),
    "LGPL-3.0": (
        """This library is free software: you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU Lesser General Public License for more details.""",
        "gnu lesser 3",
    ),
    "AGPL-3.0": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU Affero General Public License for more details.""",
        "gnu affero 3",
    ),
    "MPL-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        "mozilla 2.0",
    ),
    "EPL-2.0": (
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License
        2.0 which is available at http://www.eclipse.org/legal/epl-2.0""",
        "eclipse 2.0",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "unencumbered"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "waived"),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "attribution 4.0"),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "attribution-sharealike 4.0"),
}
#: How long a stretch may be, as shares of the template's length.
SIZES = (0.8, 0.9, 1.0, 1.1, 1.25, 1.5)
# Common words that don't signal a license.
_COMMON = frozenset("a above all an and any are as at be by can for form from if in including is it its may more not of on one or other shall that the this to under was will with without work you your".split())
_WORD = re.compile(r"[^\W_](?:[^\W_]|[.-](?=[^\W_]))*")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence (patience piles with back pointers)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, v in enumerate(values):
        p = bisect_left(tops, v)
        back.append(at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v), at.append(k)
        else:
            tops[p], at[p] = v, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched (index in a, index in b), increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[k]: k for k in range(b0, b1) if in_b[b[k]] == 1}
        anchors = [(k, place[a[k]]) for k in range(a0, a1) if in_a[a[k]] == 1 and a[k] in place]
        if not anchors:
            continue
        kept = [anchors[k] for k in longest_increasing([y for _, y in anchors])]
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        work += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Template:
    """Of `text` may be lost: `loss` words. need: distinct signal words that every occurrence holds."""

    def __init__(self, name: str, text: str, marks: str, least: float):
        self.name, self.words, self.marks = name, words(text), frozenset(words(marks))
        self.least, n = least, len(self.words)
        self.counts = Counter(self.words)
        self.signals = sorted(set(self.words) - _COMMON)
        loss = int((1 - least) * n + 1e-9)
        self.need = len(self.signals) - loss
        if self.need < 1 or not self.marks <= set(self.words):
            raise ValueError(f"{name}: too few signal words, or marks that it doesn't hold")
        self.least_pairs = n - loss
        self.sizes = sorted({max(1, round(x * n)) for x in SIZES})

    def starts(self, ws: list[str], at: list[tuple[int, str]], begin: int) -> Iterator[int]:
        """Places from `begin` on of a word of the template where the longest stretch holds enough distinct
        signals; at: all signals with their places."""
        longest, last, seen, low = self.sizes[-1], 0, Counter(), begin
        for p, w in at:
            # stretches whose first signal is at p begin behind the signal before it; they reach the signals up to
            # the one that completes the number if they begin at `reach` or later
            while last < len(at) and len(seen) < self.need and at[last][0] < p + longest:
                seen[at[last][1]] += 1
                last += 1
            if len(seen) >= self.need:
                for k in range(max(low, at[last - 1][0] - longest + 1), p + 1):
                    if ws[k] in self.counts:
                        yield k
            low = max(low, p + 1)
            seen[w] -= 1
            if seen[w] <= 0:
                del seen[w]

    def best(self, ws: list[str], k: int) -> tuple[int, int, int, int] | None:
        """Of the stretches that begin at k the one with the most matched words, the shortest of equals, as
        (matched words, first, end, words of the stretch); None without an occurrence."""
        found = None
        for size in self.sizes:
            part = ws[k : k + size]
            common = Counter(part) & self.counts
            if common.total() < self.least_pairs or not self.marks <= common.keys():
                continue
            pairs = patience(part, self.words)
            if len(pairs) >= self.least_pairs and self.marks <= {self.words[j] for _, j in pairs} and (found is None or len(pairs) > found[0]):
                found = (len(pairs), k + pairs[0][0], k + pairs[-1][0] + 1)
                if len(pairs) == len(self.words):
                    break
        return found

    def occurrences(self, ws: list[str], at: list[tuple[int, str]]) -> Iterator[tuple[int, int, int]]:
        """(matched words, first, end), from left to right, without overlap."""
        top = None
        begin = 0
        for k in self.starts(ws, at, 0):
            if top is not None and k >= top[2]:
                yield top
                begin, top = top[2], None
            if k < begin or (top is not None and top[0] == len(self.words)):
                continue
            if (found := self.best(ws, k)) is not None and (top is None or found[0] > top[0]):
                top = found
        if top is not None:
            yield top


def settled(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of overlapping (matched words, first, end, name, coverage) those that explain the most, by place."""
    out: list[tuple[int, int, str, float]] = []
    for _, a, b, name, c in sorted(found, key=lambda x: (-x[0], -x[4], x[3], x[1])):
        k = bisect_left(out, (a, b, name, c))
        if (k == 0 or out[k - 1][1] <= a) and (k == len(out) or b <= out[k][0]):
            out.insert(k, (a, b, name, c))
    return out


class Scanner:
    """templates: name -> text, or (text, marks)."""

    def __init__(self, templates: dict[str, str | tuple[str, str]], least: float = 0.8):
        self.templates = [Template(k, *((t, "") if isinstance(t, str) else t), least) for k, t in templates.items()]
        self.signals: dict[str, list[int]] = {}
        for k, t in enumerate(self.templates):
            for w in t.signals:
                self.signals.setdefault(w, []).append(k)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str, float]]]:
        """Number of words; matches as (first word, end word, name, coverage), by place."""
        ws = words(text)
        places: dict[int, list[tuple[int, str]]] = {}
        for k in np.flatnonzero(np.fromiter((w in self.signals for w in ws), dtype=bool, count=len(ws))).tolist():
            for t in self.signals[ws[k]]:
                places.setdefault(t, []).append((k, ws[k]))
        found = []
        for t, at in places.items():
            one = self.templates[t]
            if len(at) >= one.need and len({w for _, w in at}) >= one.need:
                found += [(n, a, b, one.name, n / len(one.words)) for n, a, b in one.occurrences(ws, at)]
        return len(ws), settled(found)


_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_matches", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("licenses", pa.string())])


def _scan(batches: Iterable[pa.RecordBatch], scanner: Scanner) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, found = zip(*(scanner.scan(t) for t in strings(b["text"])), strict=True) if b.num_rows else ((), ())
        best = [max(((c, e - s, name) for s, e, name, c in x), default=(0.0, 0, None)) for x in found]
        yield batch(_FOUND, doc_id=b["doc_id"], n_words=list(n), n_matches=[len(x) for x in found], license=[x[2] for x in best], coverage=[x[0] for x in best], licenses=[",".join(f"{name}:{s}:{e}:{round(100 * c)}" for s, e, name, c in x) for x in found])


def scan_licenses(docs: DataFrame, *, templates: dict[str, str | tuple[str, str]] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_matches, the best license (coverage, then length) and all matches.
    templates: name -> text or (text, marks), TEMPLATES if none are given."""
    bounded_batches(docs.sparkSession)
    scanner = Scanner(templates or TEMPLATES, least)
    return documents(docs, id_col, text_col).mapInArrow(lambda it: _scan(it, scanner), "doc_id long, n_words long, n_matches long, license string, coverage double, licenses string")


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
