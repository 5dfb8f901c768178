"""License scans: winnowed fingerprints in an inverted index, then banded alignment.

Templates are cut into words; hashes of GRAM words in a row are winnowed (the smallest hash of
every WINDOW in a row is kept), and an inverted index maps a fingerprint to its places in the
templates. A document's winnowed fingerprints pick candidates: any match of GRAM + WINDOW - 1
words in a row shares one. Around the diagonal of the hits, a banded alignment finds how many of
the template's words are matched in order, and where.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import table

GRAM, WINDOW, BAND = 3, 2, 8
#: Least share of a template's words for a report.
COVERAGE = 0.8

# Names and texts of the templates (whole licence texts, headers for files and short notices in common use).
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE"
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE"
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE"
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        'written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS '
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
    ),
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License"
    ),
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details"
    ),
}
#: Notices that differ from others by one word; only whole ones are looked for.
NOTICES = {
    "bsd-notice": "Released under the BSD License.",
    **{f"cc-{x.lower()}-4.0-notice": f"Licensed under CC {x.upper()} 4.0." for x in ("by", "by-sa", "by-nd", "by-nc-sa", "by-nc-nd")},
}
#: Templates of fewer words are notices, which the query wants whole: their one telling word may be the one that differs.
NOTICE = 20


def long_texts() -> dict[str, str]:
    """The long licences, by file name, read on the driver."""
    return {p.stem: p.read_text() for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of runs of letters and digits, and each text's first (one more at the end)."""
    inside = _WORD[data]
    start, end = inside.copy(), inside.copy()
    if data.size:
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = offs[(offs > 0) & (offs < data.size)]
        start[cut] = inside[cut]
        end[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return tk.span_hashes(data, s, e), s, e, np.searchsorted(s, offs)


def winnow(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of one sequence of word hashes: (hash, place of its first word); of equal minima the last counts."""
    if len(h) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[: len(h) - GRAM + 1].copy()
    for k in range(1, GRAM):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - GRAM + 1 + k]
    g = tk.mix(g)
    if len(g) < WINDOW:
        k = np.array([int(np.argmin(g))])
        return g[k], k
    view = np.lib.stride_tricks.sliding_window_view(g, WINDOW)[:, ::-1]
    at = np.unique(np.arange(len(view)) + WINDOW - 1 - view.argmin(axis=1))
    return g[at], at


class Index:
    """Inverted index of the templates' fingerprints; its size is that of the templates."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = []
        rows = []
        for t, name in enumerate(self.names):
            data, offs = tk.buffers(pa.array([templates[name]]))
            h = words(data, offs)[0]
            self.words.append(h)
            rows += [(int(g), t, int(p)) for g, p in zip(*winnow(h))]
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)

    def hits(self, g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, place in the document, place in the template) of every fingerprint found."""
        lo, hi = np.searchsorted(self.keys, g), np.searchsorted(self.keys, g, "right")
        n = hi - lo
        row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.template[row], np.repeat(at, n), self.place[row]


def align(doc: np.ndarray, template: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Most words matched in order within ``band`` of the diagonal doc = template + shift; with (first, last + 1) matched places of the document. Of equal matches the one that starts last counts."""
    width = 2 * band + 1
    best = np.zeros(width + 2, np.int64)  # one cell of margin on either side
    first = np.full(width + 2, -1, np.int64)
    last = np.full(width + 2, -1, np.int64)
    for i, w in enumerate(template):
        nb, nf, nl = np.zeros_like(best), np.full_like(first, -1), np.full_like(last, -1)
        for c in range(1, width + 1):
            j = i + shift + c - 1 - band
            # A template word left out moves one cell to the right in the row before; a document word left out is the cell to the left.
            top, left = best[c + 1], nb[c - 1]
            nb[c], nf[c], nl[c] = (top, first[c + 1], last[c + 1]) if (top, first[c + 1]) >= (left, nf[c - 1]) else (left, nf[c - 1], nl[c - 1])
            if 0 <= j < len(doc) and doc[j] == w:
                start = first[c] if best[c] else j
                if (best[c] + 1, start) > (nb[c], nf[c]):
                    nb[c], nf[c], nl[c] = best[c] + 1, start, j
        best, first, last = nb, nf, nl
    k = max(range(len(best)), key=lambda c: (best[c], first[c], -last[c]))
    return int(best[k]), int(first[k]), int(last[k]) + 1


def most(doc: np.ndarray, template: np.ndarray, shift: int, band: int) -> int:
    """At least what ``align`` can match: the template's words that stand anywhere within the band."""
    i = np.arange(len(template))
    found = np.zeros(len(template), bool)
    for k in range(-band, band + 1):
        a, b = max(0, -shift - k), min(len(template), len(doc) - shift - k)
        if a < b:
            found[a:b] |= template[i[a:b]] == doc[a + shift + k : b + shift + k]
    return int(found.sum())


def find(h: np.ndarray, index: Index, coverage: float, band: int, notice: float | None = None) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, last word + 1) of each occurrence in a document; occurrences of one template do not overlap.

    With ``notice``, templates below NOTICE words need that coverage and stand without other words between.
    """
    t, d, p = index.hits(*winnow(h))
    out = []
    for template in np.unique(t):
        own = t == template
        words = index.words[template]
        size = len(words)
        near = min(band, max(2, size // 4))
        strict = notice is not None and size < NOTICE
        least = (notice if strict else coverage) * size
        taken = 0
        shifts = np.unique((d - p)[own])
        # No more words can match than the document has around the diagonal.
        room = np.minimum(len(h), shifts + size + near) - np.maximum(0, shifts - near)
        for shift in shifts[room >= least].tolist():
            # What the last occurrence holds is not matched again.
            rest = h[taken:]
            if most(rest, words, shift - taken, near) < least:
                continue
            n, a, b = align(rest, words, shift - taken, near)
            if n >= least and not (strict and b - a > size):
                out.append((int(template), n, taken + a, taken + b))
                taken += b
    return out


SCANNED = "doc_id long, license string, matched_words int, template_words int, coverage double, start long, end long"


def _scan(templates: dict[str, str], coverage: float, band: int, notice: float | None):
    def run(it):
        index = Index(templates)
        for batch in it:
            for b in tk.pieces(batch, "text"):
                data, offs = tk.buffers(b.column("text"))
                h, s, e, first = words(data, offs)
                doc, rows = b.column("doc_id").to_pylist(), []
                for i in range(len(doc)):
                    w = h[first[i] : first[i + 1]]
                    for t, n, x, y in find(w, index, coverage, band, notice):
                        lo, hi = int(s[first[i] + x] - offs[i]), int(e[first[i] + y - 1] - offs[i])
                        head = data[offs[i] : offs[i] + hi]
                        chars = np.concatenate([[0], np.cumsum((head & 0xC0) != 0x80)])
                        size = len(index.words[t])
                        rows.append((doc[i], index.names[t], n, size, n / size, int(chars[lo]), int(chars[hi])))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in SCANNED.split(", ")])

    return run


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE, band: int = BAND, notice: float | None = None) -> DataFrame:
    """A row per occurrence of a template: share of its words matched, and the span in characters of the text.

    Case and punctuation do not count. Whole texts are read; documents are independent of each other, so nothing
    is shuffled. Null and empty texts have no occurrence. Rows that repeat are scanned as often as they come, rows
    without a doc_id not at all. Templates below GRAM words cannot be found. Templates below NOTICE words
    need ``coverage`` like others, or ``notice`` and no other word between where that is given. Other columns are ignored.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scan(templates or TEMPLATES | long_texts(), coverage, band, notice), SCANNED)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), templates=TEMPLATES | NOTICES | long_texts(), notice=1.0)


ORACLE: dict[str, str] = {}
