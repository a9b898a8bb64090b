"""License scans by patience alignment of texts with license notices."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.decontam import bench_words
from quarry.llm.text import kept_by, slices, text_bytes, values

#: Customary notices of public licenses, by SPDX name.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
}

#: Texts and file headers of public licenses.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "BSD-3-Clause": """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any
        later version.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
        option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
}

#: Share of a notice's words that must align.
COVERAGE = 0.85


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, ordered by the first number, whose second numbers rise."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tops, j)
        before[k] = at[n - 1] if n else -1
        tops[n : n + 1] = [j]
        at[n : n + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience_align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched places of two word lists.

    Words unique to both anchor the alignment, those of the longest rising chain stay, and the gaps between
    them are aligned in the same way; what a gap's ends share is matched first.
    """
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, i_end, j, j_end = stack.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {w: p for p, w in enumerate(b[j:j_end], j) if in_b[w] == 1}
        anchors = _increasing([(p, place[w]) for p, w in enumerate(a[i:i_end], i) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        for p, q in [*anchors, (i_end, j_end)]:
            stack.append((i, p, j, q))
            i, j = p + 1, q + 1
        out += anchors
    return sorted(out)


class LicenseScanner:
    """Coverage of each notice by a text.

    A notice may stand in any window that starts with one of its words and is half as long again as the notice.
    No alignment matches more words than window and notice have in common, counted with their repeats; that
    number is kept while the window moves, and where it is enough the window is aligned.
    """

    def __init__(self, notices: Iterable[tuple[str, str]] | dict[str, str], coverage: float):
        self.notices = []
        for name, text in notices.items() if isinstance(notices, dict) else notices:
            words = bench_words(text.encode())
            if words:
                self.notices.append((name, words, Counter(words), math.ceil(coverage * len(words) - 1e-9)))

    def scan(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """Notices that reach the coverage: name, coverage, and the word range of the best place (first if tied)."""
        words = bench_words(text)
        have = set(words)
        found: dict[str, tuple] = {}
        for name, notice, counts, least in self.notices:
            if sum(n for w, n in counts.items() if w in have) < least:
                continue  # even with every word in place, too little would align
            best, start, end = 0, 0, 0
            for low, high in self._windows(words, counts, least, len(notice) + len(notice) // 2):
                matched = patience_align(words[low:high], notice)
                if len(matched) > best:
                    best, start, end = len(matched), low + matched[0][0], low + matched[-1][0] + 1
                    if best == len(notice):
                        break
            if best >= max(least, 1):
                found[name] = max(found.get(name, (0.0,)), (best / len(notice), len(notice), -start, -end))
        order = sorted(found.items(), key=lambda f: (-f[1][0], -f[1][1], f[0]))
        return [(name, coverage, -start, -end) for name, (coverage, _, start, end) in order]

    @staticmethod
    def _windows(words: list[bytes], counts: Counter, least: int, size: int) -> Iterator[tuple[int, int]]:
        """Windows that start with a word of the notice and have ``least`` words in common with it."""
        at = [p for p, w in enumerate(words) if w in counts]
        inside: dict[bytes, int] = dict.fromkeys(counts, 0)
        common = n = 0
        for first in at:
            while n < len(at) and at[n] < first + size:
                w = words[at[n]]
                common += inside[w] < counts[w]
                inside[w] += 1
                n += 1
            if common >= least:
                yield first, min(first + size, len(words))
            w = words[first]
            inside[w] -= 1
            common -= inside[w] < counts[w]


def license_scan(docs: DataFrame, *, notices: Iterable[tuple[str, str]] | dict[str, str] | None = None, coverage: float = COVERAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, license string, coverage double, licenses array<string>, start long, end long`` of every whole text.

    ``licenses`` are the notices of whose words at least ``coverage`` align with the text, most coverage first,
    then most words, then by name (of several notices of one name, the best counts); ``license``, ``coverage`` and the word range are the first's, null (0.0, null) if there is
    none. Words are runs of letters and digits, A-Z lower-cased. A null or empty text has none. One row for each
    input row, repeated rows and null ids included, in no shuffle; other columns are left out, whatever their
    names.
    """
    chosen = [*NOTICES.items(), *TEXTS.items()] if notices is None else notices if isinstance(notices, dict) else list(notices)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("licenses")
        scanner = LicenseScanner(chosen, coverage)
        for whole in batches:
            for batch in slices(whole, "__text"):
                found = [scanner.scan(t) for t in values(batch.column(1))]
                first = [f[0] if f else (None, 0.0, None, None) for f in found]
                columns = [pa.array([f[k] for f in first], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))]
                names = pa.array([[x[0] for x in f] for f in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0), columns[0], columns[1], names, columns[2], columns[3]], names=["doc_id", "license", "coverage", "licenses", "start", "end"])

    schema = f"doc_id {kind}, license string, coverage double, licenses array<string>, start long, end long"
    return docs.select(F.col(doc_id).alias("__id"), text_bytes(docs, text).alias("__text")).mapInArrow(run, schema)
