"""License scan: winnowed fingerprints propose, banded alignment decides (operator 7).

The words of every template are hashed in runs of ``GRAM``; of each ``WINNOW``
neighbouring hashes the least is a fingerprint.  An inverted index maps
fingerprints to template and position.  All runs of a document are looked up in
it, so any passage of at least ``GRAM + WINNOW - 1`` words in common with a template is
found.  Hits of a template on about the same diagonal are one candidate, which
is aligned word by word within a band (matches +1, gaps and changes -1, best
local alignment; of equally good ones the one that begins first).  The candidates of a template are aligned side by side in numpy,
and equal passages once.  Reported are the matched words, their share of the template,
and the span in the document, whatever the share, from ``MIN_MATCHED`` matched words on
(of shorter templates from ``SHORT_COVERAGE`` on).  What a report covers is taken out of the text, and the rest is aligned again until
nothing is left to report.  Of overlapping reports the one with more matched
words stays, then the one of higher coverage, then the one that begins first.

A narrow map over whole texts: templates are constants, nothing is shuffled.

Defined results: a null or empty text, or one without words, has no reports.  Spans count characters,
the end exclusive.  Repeated rows each give their reports; a template that a
document repeats is reported for each place, however long the text.  Without templates nothing is found, and an empty table gives
no rows.  Only ``doc_id`` is carried along; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import mix, pieces, raw, relax, words
from ._util import documents

GRAM, WINNOW = 3, 3
#: The shortest passage that is certain to be found.
MIN_MATCHED = GRAM + WINNOW - 1
#: Share of a template that is reported below ``MIN_MATCHED`` words.
SHORT_COVERAGE = 0.75
#: Share of a template that is asked for besides; consumers can filter by coverage.
MIN_COVERAGE = 0.0
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE '
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
    ),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        "(the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
        "third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. "
        "This software is distributed without any warranty.",
    ),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
)


def _grams(h: np.ndarray) -> np.ndarray:
    """Hash of each run of GRAM words."""
    if len(h) < GRAM:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        x = np.zeros(len(h) - GRAM + 1, np.uint64)
        for j in range(GRAM):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - GRAM + 1 + j])
    return x


def winnowed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the fingerprints of a sequence of word hashes: the last least of each window."""
    g = _grams(h)
    at: set[int] = set()
    for i in range(max(1, len(g) - WINNOW + 1) if len(g) else 0):
        part = g[i : i + WINNOW]
        at.add(i + len(part) - 1 - int(np.argmin(part[::-1])))
    pos = np.array(sorted(at), np.int64)
    return g[pos], pos


class Index:
    """Word hashes of the templates and the inverted index of their fingerprints."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.names = [n for n, _ in templates]
        self.words = [words(pa.array([t]))[0] for _, t in templates]
        #: By how much an alignment may leave its diagonal.
        self.band = np.array([3 + len(h) // 8 for h in self.words], np.int64)
        marks, owner, place = [], [], []
        for t, h in enumerate(self.words):
            g, p = winnowed(h)
            marks.append(g)
            owner.append(np.full(len(g), t))
            place.append(p)
        flat = np.concatenate(marks) if marks else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.marks = flat[order]
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]


#: A cell of an alignment is one number: score, matched words and how early it begins, each in bits of its own.
_BITS, _SCORE = 21, 42
_STEP = np.int64(1 << _SCORE)


def align_many(a: np.ndarray, windows: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matched, begin, end) of the best local alignment of ``a`` with each row of ``windows``, whose word i + w may match the i-th of ``a`` for 0 <= w < its ``reach``."""
    n, band = len(windows), int(reach.max())
    inside = np.arange(band) < reach[:, None]
    row = np.zeros((n, band), np.int64)
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    slope = np.arange(band, dtype=np.int64) << _SCORE
    every, mask = np.arange(n), (1 << _BITS) - 1
    for i, x in enumerate(a):
        hit = (windows[:, i : i + band] == x) & inside
        begin = np.where(row > 0, row, mask - np.arange(i, i + band, dtype=np.int64))
        cell = np.where(hit, begin + _STEP + (1 << _BITS), row - _STEP)
        np.maximum(cell[:, :-1], row[:, 1:] - _STEP, out=cell[:, :-1])
        cell = np.maximum.accumulate(cell + slope, 1) - slope
        cell[cell < _STEP] = 0  # a score of 0
        row = cell
        good = np.where(hit, cell, 0)
        at = good.argmax(1)
        top = good[every, at]
        new = top >> _BITS > best >> _BITS
        best[new] = top[new]
        end[new] = at[new] + i + 1
    return best >> _BITS & mask, mask - (best & mask), end


def align(a: list[int], b: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched, begin, end): best local alignment of ``a`` with the part of ``b`` where position j - i is within ``band`` of ``diagonal``."""
    a, b = np.asarray(a, np.uint64), np.asarray(b, np.uint64)
    window = _windows(b, np.array([diagonal - band]), np.array([0]), np.array([len(b)]), len(a) + 2 * band)
    matched, lo, hi = align_many(a, window, np.array([2 * band + 1]))
    return (int(matched[0]), int(lo[0]) + diagonal - band, int(hi[0]) + diagonal - band) if matched[0] else (0, 0, 0)


_NO_WORD = np.uint64(0)  #: the hash of no word, but for one case in 2**64


def _windows(h: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` words from each ``start`` on, _NO_WORD outside of [lo, hi)."""
    at = start[:, None] + np.arange(size)
    ok = (at >= lo[:, None]) & (at < hi[:, None])
    return np.where(ok, h[np.clip(at, 0, len(h) - 1)], _NO_WORD)


def candidates(index: Index, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(template, documents, first and last diagonals) of the candidates in the documents whose word hashes begin at ``first``."""
    g = _grams(h)
    if not len(g) or not len(index.marks):
        return
    lo = np.searchsorted(index.marks, g, "left")
    n = np.searchsorted(index.marks, g, "right") - lo
    at = np.flatnonzero(n)
    doc = np.searchsorted(first, at, "right") - 1
    whole = at + GRAM <= first[doc + 1]
    at, doc = at[whole], doc[whole]
    if not len(at):
        return
    cum = np.concatenate([[0], np.cumsum(n[at])])
    ref = np.repeat(lo[at] - cum[:-1], n[at]) + np.arange(cum[-1])
    doc, owner = np.repeat(doc, n[at]), index.owner[ref]
    diagonal = np.repeat(at, n[at]) - index.place[ref]
    order = np.lexsort((diagonal, doc, owner))
    owner, doc, diagonal = owner[order], doc[order], diagonal[order]
    band = index.band[owner]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]) | (diagonal[1:] - diagonal[:-1] > band[1:])
    run = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    nth = (diagonal - diagonal[run]) // (2 * band + 1)  # runs that drift farther are cut
    new[1:] |= nth[1:] != nth[:-1]
    last = diagonal[np.append(np.flatnonzero(new)[1:], len(new)) - 1]
    owner, doc, diagonal = owner[new], doc[new], diagonal[new]
    for t in np.unique(owner).tolist():
        mine = owner == t
        yield t, doc[mine], diagonal[mine], last[mine]


def reports(index: Index, h: np.ndarray, first: np.ndarray, min_coverage: float = MIN_COVERAGE) -> list[tuple[int, int, int, float, int, int]]:
    """(document, template, matched, coverage, first word, end word) of the documents whose word hashes begin at ``first``, in order."""
    weight = mix(np.arange(1, 4096, dtype=np.uint64))
    # candidates with the part of the document that they may lie in
    todo = [(t, doc, low, high, first[doc], first[doc + 1]) for t, doc, low, high in candidates(index, h, first)]
    kept: dict[int, list] = {}  # (begin, end, report) of each document, in order and apart
    while todo:
        found: dict[int, set] = {}
        again = []
        for t, doc, low, high, begin, end in todo:
            words_, band = index.words[t], int(index.band[t])
            size = len(words_)
            reach = high - low + 2 * band + 1
            width, more = int(reach.max()), np.zeros(len(doc), bool)
            for i in range(0, len(doc), 2048):
                d, start = doc[i : i + 2048], low[i : i + 2048] - band
                w = _windows(h, start, begin[i : i + 2048], end[i : i + 2048], size + width)
                with np.errstate(over="ignore"):
                    mark = reach[i : i + 2048].astype(np.uint64) + sum((w[:, j : j + 4095] * weight[: w[:, j : j + 4095].shape[1]]).sum(1) * np.uint64(2 * j + 1) for j in range(0, w.shape[1], 4095))
                _, one, back = np.unique(mark, return_index=True, return_inverse=True)
                matched, lo, hi = (x[back.ravel()] for x in align_many(words_, w[one], reach[i : i + 2048][one]))
                ok = (matched > 0) & (matched >= min_coverage * size) & ((matched >= MIN_MATCHED) | (matched >= SHORT_COVERAGE * size))
                more[i : i + 2048] = ok
                for k in np.flatnonzero(ok).tolist():
                    found.setdefault(int(d[k]), set()).add((t, int(matched[k]), round(int(matched[k]) / size, 4), int(start[k] + lo[k]), int(start[k] + hi[k])))
            if more.any():
                again.append((t, doc[more], low[more], high[more], begin[more], end[more]))
        for d, some in found.items():
            mine = kept.setdefault(d, [])
            for r in sorted(some, key=lambda r: (-r[1], -r[2], r[3], r[0])):
                at = bisect.bisect_left(mine, (r[3],))
                if (at == len(mine) or mine[at][0] >= r[4]) and (at == 0 or mine[at - 1][1] <= r[3]):
                    mine.insert(at, (r[3], r[4], r))
        # candidates that had anything are aligned again with what the reports leave of their part
        todo = []
        for t, doc, low, high, begin, end in again:
            size, band = len(index.words[t]), int(index.band[t])
            rest = []
            for k, (d, lo, hi) in enumerate(zip(doc.tolist(), np.maximum(begin, low - band).tolist(), np.minimum(end, high + band + size).tolist(), strict=True)):
                mine = kept[d]
                at = max(0, bisect.bisect_left(mine, (lo,)) - 1)
                while at < len(mine) and mine[at][0] < hi:
                    if mine[at][0] > lo:
                        rest.append((k, lo, mine[at][0]))
                    lo = max(lo, mine[at][1])
                    at += 1
                if lo < hi:
                    rest.append((k, lo, hi))
            rest = [x for x in rest if x[2] - x[1] >= min(MIN_MATCHED, SHORT_COVERAGE * size)]
            if rest:
                k, lo, hi = (np.array(x, np.int64) for x in zip(*rest, strict=True))
                todo.append((t, doc[k], low[k], high[k], lo, hi))
    return [(d, *r) for d in sorted(kept) for _, _, r in kept[d]]


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license, template, matched, coverage, begin, stop): one row for each place of a license in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        index = Index(templates)
        for b in batches:
            for i, part in pieces(b["text"], 4 << 20):
                low = pc.utf8_lower(part.fill_null(""))
                data, off = raw(low)
                h, start, end, first = words(low)
                out: list[tuple] = []
                chars: tuple[int, np.ndarray] = (-1, np.zeros(1, np.int64))
                for d, t, matched, cover, a, z in reports(index, h, first, min_coverage):
                    if chars[0] != d:  # characters before each byte of the text
                        chars = d, np.concatenate([[0], np.cumsum((data[off[d] : off[d + 1]] & 0xC0) != 0x80)])
                    out.append((d + i, index.names[t], t, matched, cover, int(chars[1][start[a] - off[d]]), int(chars[1][end[z - 1] - off[d]])))
                cols = list(zip(*out, strict=True)) if out else [()] * 7
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(arrays[0]), *arrays[1:]], ["doc_id", "license", "template", "matched", "coverage", "begin", "stop"])
            relax()

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {key}, license string, template int, matched int, coverage double, begin int, stop int")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a license in every document."""
    return scan(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_licenses": op7_licenses}
