"""Operator 6: licence notices in documents.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z folded.  The word k-grams of every template are winnowed (the
smallest hash of each ``WINDOW`` neighbours stays) into an inverted index hash -> (template, place); templates too short for
one window are indexed whole.  Every k-gram of a document is looked up, so a run of KGRAM + WINDOW - 1 words of a
template is always hit.  Hits of one template on neighbouring diagonals are a candidate, which is aligned word by word within
a band around the diagonals (match 1, mismatch, gap -1; free ends in the document).  Reported are alignments whose matched words
are at least ``COVERAGE`` of the template, the best one where several overlap: most matched less missing words, so that a whole
text goes before its opening (ties: higher coverage, longer template, name).

Templates are one-line notices, file headers, openings (named so) and whole licence texts; the long ones are read from
``license_texts``.  Coverage and span are those of the named template.  A long template is aligned only where the words of the
document, each as often as it stands there, can reach ``COVERAGE``; this bound loses nothing.

Null and empty texts have no notices; a template without words is never found; repeated rows are scanned each.
Other columns are ignored.

Scale.  Documents are read once, never shuffled; only the templates, a parameter, are sent to the tasks.
"""

from __future__ import annotations

from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.exprs import q
from .arrays import ALNUM, Members, U, lean, runs, shingles, texts, word_hashes, words

KGRAM, WINDOW, BAND, COVERAGE = 3, 4, 8, 0.8

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
_MIT_OPENING = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
                "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so")
_ISC_OPENING = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
                "copyright notice and this permission notice appear in all copies")
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = (": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
            "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
              "prior written permission. ")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
            "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
            "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
            "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
            "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _gnu(name: str, version: str) -> str:
    """The header of a file under version 3 of a GNU licence."""
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version "
            f"{version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
            f"warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. "
            "If not, see <https://www.gnu.org/licenses/>.")


def _gnu_before(name: str, version: str) -> str:
    """The header of a file under version 2 or 2.1 of a GNU licence."""
    return (f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} "
            "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
            f"of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program; if not, "
            "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")


# Wording of public licence notices.
TEMPLATES = {
    "All rights reserved": "All rights reserved.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0 whole header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
                               "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
                               "for the specific language governing permissions and limitations under the License.",
    "MIT notice": "Released under the MIT License.",
    "MIT opening": _MIT_OPENING,
    "MIT": f"{_MIT_OPENING}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
           f"Software. {_AS_IS}AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
           "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1 notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                  "the Free Software Foundation",
    "GPL-2.0 header": _gnu_before("General Public License", "2"),
    "GPL-3.0 header": _gnu("General Public License", "3"),
    "LGPL-2.1 header": _gnu_before("Lesser General Public License", "2.1"),
    "LGPL-3.0 header": _gnu("Lesser General Public License", "3"),
    "AGPL-3.0 header": _gnu("Affero General Public License", "3"),
    "BSD": _BSD_OPENING,
    "BSD-2-Clause": _BSD_OPENING + _BSD_TWO + _BSD_END,
    "BSD-3-Clause": _BSD_OPENING + _BSD_TWO + _BSD_THIRD + _BSD_END,
    "BSD notice": "Released under the BSD License.",
    "ISC opening": _ISC_OPENING,
    "ISC": f"{_ISC_OPENING}. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
           "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
           "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
                      "https://mozilla.org/MPL/2.0/.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    **{f"CC-{kind.replace(' ', '-')}-4.0 notice": f"Licensed under CC {kind.replace(' ', '-')} 4.0." for kind in ("BY", "BY SA", "BY NC", "BY ND", "BY NC SA", "BY NC ND")},
    **{f"CC-{kind}-4.0 sentence": f"This work is licensed under a Creative Commons {name} 4.0 International License."
       for kind, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                          ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
    "Unlicense opening": "This is free and unencumbered software released into the public domain.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
                 "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
                 "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to "
                 "the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
                 f"under copyright law. {_AS_IS}AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
                 "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    **{f.stem: f.read_text("utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))},
}


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names, self.words = sorted(templates), []
        column = pa.array([templates[n] for n in self.names], pa.large_string())
        entries = defaultdict(list)
        for _, _, raw, offsets in runs(column, 1 << 40):
            start, end, first = words(raw, offsets, ALNUM)
            hashes = word_hashes(raw, start, end)
            for t in range(len(self.names)):
                own = hashes[first[t]:first[t + 1]]
                self.words.append(own)
                grams = shingles(own, np.array([0, len(own)]), min(KGRAM, max(len(own), 1)))[0]
                if len(grams) <= WINDOW:
                    chosen = range(len(grams))
                else:
                    chosen = sorted({i + int(grams[i:i + WINDOW].argmin()) for i in range(len(grams) - WINDOW + 1)})
                for i in chosen:
                    entries[int(grams[i])].append((t, i))
        self.counts = [np.unique(w, return_counts=True) for w in self.words]
        self.widths = sorted({min(KGRAM, len(w)) for w in self.words if len(w)})
        self.members = Members(np.array(sorted(entries), U))
        self.posts = [entries[int(v)] for v in self.members.values]


def align(template: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first, end) of the best alignment of the whole template with a part of ``doc``, on diagonals (place in
    the document less place in the template) from ``low`` to ``high``."""
    width = high - low + 1
    worst = -(1 << 20)
    score = np.zeros(width, np.int64)  # before the template's first word: free start
    match, begin = np.zeros(width, np.int64), np.arange(low, high + 1)
    outside = (begin < 0) | (begin > len(doc))
    score[outside] = worst
    steps = np.arange(width)
    for i, word in enumerate(template.tolist()):
        at = low + i + steps  # the document word compared on each diagonal
        inside = (at >= 0) & (at < len(doc))
        equal = np.zeros(width, bool)
        equal[inside] = doc[at[inside]] == U(word)
        diagonal = np.where(inside, score + np.where(equal, 1, -1), worst)
        skip = np.append(score[1:] - 1, worst)  # the template word is left out
        use = skip > diagonal
        new = np.where(use, skip, diagonal)
        new_match = np.where(use, np.append(match[1:], 0), match + equal)
        new_begin = np.where(use, np.append(begin[1:], 0), begin)
        # words of the document left out: the best from the left, one lost per step
        best = np.maximum.accumulate(new + steps) - steps
        source = np.maximum.accumulate(np.where(new + steps == np.maximum.accumulate(new + steps), steps, -1))
        score, match, begin = best, new_match[source], new_begin[source]
    end = low + len(template) + steps
    ok = (end >= 0) & (end <= len(doc))
    if not ok.any():
        return 0, 0, 0
    order = np.lexsort((end, -match, -np.where(ok, score, worst)))
    k = int(order[0])
    return int(match[k]), int(begin[k]), int(end[k])


def reach(counts: tuple[np.ndarray, np.ndarray], part: np.ndarray) -> int:
    """At most so many words of a template, given as (words, times), can be matched in ``part``."""
    values, times = counts
    at = np.minimum(np.searchsorted(values, part), len(values) - 1)
    held = np.bincount(at[values[at] == part], minlength=len(values))
    return int(np.minimum(held, times).sum())


def _candidates(places: list[tuple[int, int]]):
    """Hits (document place, template place) of one template in groups of near diagonals: (low, high)."""
    diagonals = sorted({d - t for d, t in places})
    group = [diagonals[0]]
    for d in diagonals[1:]:
        if d - group[-1] > BAND:
            yield group[0], group[-1]
            group = []
        group.append(d)
    yield group[0], group[-1]


def find(index: Index, doc: np.ndarray, hits: dict[int, list[tuple[int, int]]], coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, end word) of the notices of one document."""
    found = []
    for t, places in hits.items():
        template, rest = index.words[t], doc
        least = coverage * len(template) - 1e-9
        if len(doc) < least or reach(index.counts[t], doc) < least:
            continue
        while places:
            more = []
            for low, high in _candidates(places):
                if reach(index.counts[t], rest[max(low - BAND, 0):max(high + BAND + len(template), 0)]) < least:
                    continue
                n, first, end = align(template, rest, low - BAND, high + BAND)
                if n and n >= least and end > first:
                    found.append((t, n, first, end))
                    rest = rest.copy() if rest is doc else rest
                    rest[first:end] = 0  # the same words are not found again
                    more += [p for p in places if low <= p[0] - p[1] <= high and not first <= p[0] < end]
            places = more
    found.sort(key=lambda f: (len(index.words[f[0]]) - 2 * f[1], -f[1] / len(index.words[f[0]]), -len(index.words[f[0]]), index.names[f[0]], f[2]))
    taken: list[tuple[int, int, int, int]] = []
    for f in found:
        if all(f[3] <= k[2] or f[2] >= k[3] for k in taken):
            taken.append(f)
    return sorted(taken, key=lambda f: f[2])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per notice: key, ``license``, ``matched`` and ``n_words`` of the template, ``coverage``, ``first`` and ``last``
    (characters of the document, end exclusive), ``notice`` (the text of the span)."""
    held = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))
    base = docs.select(q(key).alias("k"), q(text).alias("t"))
    kind = base.schema["k"].dataType.simpleString()

    def run(batches):
        index: Index = held.value
        for batch in batches:
            out = []
            for at, _, raw, offsets in runs(texts(batch.column(1))):
                start, end, first = words(raw, offsets, ALNUM)
                hashes = word_hashes(raw, start, end)
                hits: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
                for width in index.widths:
                    grams, before = shingles(hashes, first, width, whole_short=False)
                    where, value = index.members.find(grams)
                    row = np.searchsorted(before, where, "right") - 1
                    for r, w, v in zip(row.tolist(), where.tolist(), value.tolist()):
                        for t, place in index.posts[v]:
                            if min(KGRAM, len(index.words[t])) == width:
                                hits[r][t].append((w - int(before[r]), place))
                for r in sorted(hits):
                    for t, n, lo, hi in find(index, hashes[first[r]:first[r + 1]], hits[r], coverage):
                        body = raw[offsets[r]:offsets[r + 1]].tobytes()
                        a, b = int(start[first[r] + lo] - offsets[r]), int(end[first[r] + hi - 1] - offsets[r])
                        notice = body[a:b].decode("utf-8", "replace")
                        before_it = len(body[:a].decode("utf-8", "replace"))
                        out.append((at + r, index.names[t], n, len(index.words[t]), before_it, before_it + len(notice), notice))
            if out:
                row, name, n, size, lo, hi, notice = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(name), pa.array(n, pa.int64()), pa.array(size, pa.int64()),
                                                  pa.array([a / b for a, b in zip(n, size)]), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(notice)],
                                                 ["k", "license", "matched", "n_words", "coverage", "first", "last", "notice"])

    return base.mapInArrow(lean(run), f"k {kind}, license string, matched long, n_words long, coverage double, first long, last long, notice string").withColumnRenamed("k", key)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
