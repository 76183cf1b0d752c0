"""Licence notices in texts: Dice coefficients of word bigrams against templates."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .cluster import lean

_AS_IS_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
# Licence names and the public wording of their notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the terms of the Apache License 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of '
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
        'is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
        "governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in '
        "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        'permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one "
        "at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-2-Clause", _BSD + _AS_IS_BSD),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission. " + _AS_IS_BSD,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
        'this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_FOUND = "doc_id long, license string, dice double, start_word long, end_word long, n_licenses long, n_notices long"


def bigrams(column):
    """(hashes, bounds, word bounds): the bigram of each two neighbouring words; letters and digits make words, without case."""
    data, offsets = wordhash.utf8(column)
    for lo, hi in wordhash.chunks(offsets):
        h, bounds = wordhash.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], gaps=wordhash.IS_MARK, value=wordhash.FOLDED_VALUE)
        pair = np.zeros(len(h), np.uint64)
        pair[:-1] = wordhash.mix(h[:-1] * wordhash.STEP[0] + h[1:] * wordhash.STEP[1])
        # the last word of a text begins no bigram
        pair[bounds[1:][np.diff(bounds) > 0] - 1] = 0
        yield lo, hi, pair, bounds


class Templates:
    """The bigrams of the templates: of each how often it is there (`count`), by template (`owner`) and place among all bigrams (`grams`)."""

    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        sets = []
        for _, _, pair, bounds in bigrams(pa.array([t for _, t in templates], pa.large_string())):
            sets += [np.unique(pair[bounds[i] : max(bounds[i], bounds[i + 1] - 1)], return_counts=True) for i in range(len(bounds) - 1)]
        self.sizes = np.array([n.sum() for _, n in sets])
        self.keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s for s, _ in sets)]))
        grams = np.concatenate([np.zeros(0, np.int64), *(np.searchsorted(self.keys, s) for s, _ in sets)]).astype(np.int64)
        count = np.concatenate([np.zeros(0, np.int64), *(n for _, n in sets)])
        owner = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
        order = np.lexsort((owner, grams))
        self.grams, self.owner, self.count = grams[order], owner[order], count[order]


def windows(places: np.ndarray, grams: np.ndarray, often: np.ndarray, size: int, least: float) -> list[tuple[float, int, int]]:
    """(Dice, first bigram, last bigram) of runs of bigrams against a template of `size` bigrams, `least` or more, the best first; none overlaps a better one.

    `places` are those of bigrams that the template has, `often` times each. Bigrams count as often as they are there, on either side. For
    each first bigram the best last one is a candidate. Runs over (2 - least) / least times the template can't reach `least`.
    """
    most = int(size * (2 - least) / least + 1e-9)
    places, grams, often = places.tolist(), grams.tolist(), often.tolist()
    found = []
    for i, first in enumerate(places):
        seen: dict = {}
        both, best = 0, (0.0, 0, 0)
        for j in range(i, len(places)):
            wide = places[j] - first + 1
            if wide > most:
                break
            g = grams[j]
            seen[g] = seen.get(g, 0) + 1
            both += seen[g] <= often[j]
            dice = 2 * both / (size + wide)
            if dice > best[0] + 1e-12:
                best = (dice, first, places[j])
        if best[0] >= least:
            found.append(best)
    return _apart(sorted(found, key=lambda r: (-r[0], r[1])), lambda r: (r[1], r[2] + 2))


def _apart(runs: list, span) -> list:
    """The runs, in their order, whose words (span: first, end) are in none taken before."""
    taken, begins, ends = [], [], []
    for r in runs:
        low, high = span(r)
        at = bisect.bisect_left(begins, low)
        if (at == 0 or ends[at - 1] <= low) and (at == len(begins) or high <= begins[at]):
            begins.insert(at, low)
            ends.insert(at, high)
            taken.append(r)
    return taken


def scan_licenses(documents: DataFrame, least: float = 0.8, templates=TEMPLATES) -> DataFrame:
    """(doc_id, license, dice, start_word, end_word, n_licenses, n_notices) for every document.

    Texts and templates are normalised to words of letters and digits without case. Every run of a text's words is a candidate, its value
    the Dice coefficient of the word bigrams with a template's, each counted as often as it is there; runs from `least` on are notices. Those that
    share words with a better one (ties to the longer template, then the first listed, then the earlier run) are left out. license is that of the best, its place is
    counted in words, end exclusive, n_licenses counts the different licences and n_notices all notices. A template of n bigrams
    is left out where the whole text has fewer than least * n / (2 - least) of them: no run could reach `least`. Null and empty texts
    and texts without a notice have a null license, dice 0.0 and null places. Repeated rows are scanned alike; other columns are ignored; a null doc_id stays
    null; no documents give no rows.
    """

    def run(batches):
        t = Templates(templates)
        need = np.ceil(least * t.sizes / (2 - least) - 1e-9)
        for b in batches:
            out = [[None, 0.0, None, None, 0, 0] for _ in range(b.num_rows)]
            for lo, hi, pair, bounds in bigrams(b.column("text")):
                at = np.minimum(np.searchsorted(t.keys, pair), len(t.keys) - 1)
                hit = np.flatnonzero(t.keys[at] == pair)
                doc = np.searchsorted(bounds, hit, "right") - 1
                gram = at[hit]
                # each hit once for every template that has the bigram
                first, last = np.searchsorted(t.grams, gram), np.searchsorted(t.grams, gram, "right")
                n = last - first
                which = np.repeat(np.arange(len(hit)), n)
                entry = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(hit) else np.zeros(0, np.int64)
                owner, often = t.owner[entry], t.count[entry]
                pairs = doc[which] * len(t.sizes) + owner
                distinct, one = np.unique(pairs * len(t.keys) + gram[which], return_index=True)
                group, of = np.unique(distinct // len(t.keys), return_inverse=True)
                # no run shares more with the template than all its bigrams that the text has
                count = np.bincount(of, often[one], len(group))
                group = group[count >= need[group % len(t.sizes)]]
                order = np.argsort(pairs, kind="stable")
                starts, ends = np.searchsorted(pairs[order], group), np.searchsorted(pairs[order], group, "right")
                found: dict = {}
                for g, s, e in zip(group.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    d, k = divmod(g, len(t.sizes))
                    rows = which[order[s:e]]
                    for dice, i, j in windows(hit[rows] - bounds[d], gram[rows], often[order[s:e]], int(t.sizes[k]), least):
                        found.setdefault(d, []).append((-dice, -int(t.sizes[k]), k, i, j + 2))
                for d, runs in found.items():
                    taken = _apart(sorted(runs), lambda r: r[3:])
                    dice, _, k, i, j = taken[0]
                    out[lo + d] = [t.names[k], -dice, i, j, len({t.names[x[2]] for x in taken}), len(taken)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.string(), pa.float64(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in _FOUND.split(", ")])

    lean(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FOUND)
