"""License scans: MinHash bands over overlapping windows, then exact containment.

Templates and texts are shingles of five words. Templates are grouped by size:
class ``s`` (a power of two) has those with more than ``s / 2`` and at most ``s``
shingles. Texts are cut into windows of ``1.5 s`` every ``s / 2``, so a run of
``s`` shingles lies within one window whatever its place. Each window has
``BANDS`` minima, bands of one row, and fetches the templates that share one.

A template of which a window holds the share c has Jaccard similarity of at
least ``c t / (1.5 s + (1 - c) t)`` with it, and ``t > s / 2``: for c = 0.8 at
least 0.25. The chance that all ``BANDS = 48`` minima differ is then at most
1e-6, for a whole template (c = 1) 4e-9. Class 1 compares shingle by shingle.

A fetched template is verified: the share of its distinct shingles among those
of the window, widened by ``s`` on both sides, must be at least ``THRESHOLD``.
The hits are then cut where the template begins anew: each run in its order
that reaches the threshold is a match, so copies next to each other stay apart.
Where none does, as when paragraphs have moved, the hits of the window are one
match. Matches of one template that overlap are one.

Cases: a null or empty text, or one under five words, has no match. Rows
repeated, or with a null id, are scanned like any other. An empty table gives
an empty result. Other columns, whatever their names, are not read. Very long
texts are scanned in stretches that overlap, so minima need bounded memory.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshnet.llm.near_dedup import _ODD, _WORD, _mix, shingles, words_of
from meshnet.plans.scratch import bound_arrow_batches
from meshnet.plans.tables import read_table

#: Words of a shingle; near-duplicates have a width of their own.
SHINGLE = 5
THRESHOLD = 0.8
BANDS = 48
#: Shingles of a text whose minima are taken at once.
STRETCH = 1 << 16

#: Public notices and license texts.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-phrase": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has dedicated all copyright and related and "
    "neighboring rights to this software to the public domain worldwide.",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
    "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
    'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
    "the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
    "your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
    "General Public License for more details.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the "
    "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
    "(at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or "
    "(at your option) any later version.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public "
    "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MIT-disclaimer": 'The software is provided "as is", without warranty of any kind, express or implied, including but not '
    "limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall "
    "the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, "
    "tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "BSD-disclaimer": 'This software is provided by the copyright holders and contributors "as is" and any express or implied '
    "warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose "
    "are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, "
    "special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; "
    "loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in "
    "contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this "
    "software, even if advised of the possibility of such damage.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
    "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for "
    "any purpose, commercial or non-commercial, and by any means.",
}


class Templates:
    """Templates by size class, ready to be fetched by band."""

    def __init__(self, texts: dict[str, str], threshold: float = THRESHOLD, bands: int = BANDS):
        self.threshold = threshold
        self.factors = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _ODD[7]) | np.uint64(1)
        self.bases = np.arange(bands, dtype=np.int64)[:, None] << 16
        self.sets: dict[str, np.ndarray] = {}
        self.places: dict[str, list[list[int]]] = {}  # of each shingle of a set, ascending
        self.classes: dict[int, list[str]] = defaultdict(list)
        self.by_band: dict[int, dict[tuple[int, int], list[str]]] = defaultdict(lambda: defaultdict(list))
        for name, text in texts.items():
            words = words_of(text)
            if len(words) < SHINGLE:
                raise ValueError(f"template {name} has under {SHINGLE} words")
            own, which = np.unique(shingles(words, SHINGLE), return_inverse=True)
            size = 1 << (len(own) - 1).bit_length()
            self.sets[name], self.places[name] = own, [[] for _ in own]
            for place, i in enumerate(which.tolist()):
                self.places[name][i].append(place)
            self.classes[size].append(name)
            for band, least in enumerate(self._hashes(own).min(axis=1).tolist()):
                self.by_band[size][band, least].append(name)
        self.largest = max(self.classes, default=1)
        # A bit for each value of the high 16 bits that some template's minimum has, by class and band.
        self.maybe = {}
        for size, found in self.by_band.items():
            table = np.zeros((bands, 1 << 16), bool)
            for band, least in found:
                table[band, least >> 48] = True
            self.maybe[size] = table.ravel()

    def _hashes(self, kmers: np.ndarray) -> np.ndarray:
        return kmers[None, :] * self.factors[:, None]  # k-mers are mixed already, so a factor reorders them

    def _fetch(self, kmers: np.ndarray) -> Iterator[tuple[str, int, int, int]]:
        """Template, first and last shingle of a window that shares a band with it, and the class."""
        least, width = self._hashes(kmers), 1  # minima of blocks of ``width`` shingles
        for size in sorted(self.classes):
            block = max(1, size // 2)
            while width < block:
                if least.shape[1] % 2:
                    least = np.concatenate([least, least[:, -1:]], axis=1)
                least, width = np.minimum(least[:, 0::2], least[:, 1::2]), width * 2
            window = least if size > 1 else least[:1]  # equal shingles agree in every band
            if size > 1:  # three blocks from each on; windows are shorter at the end
                window = least.copy()
                for step in (1, 2):
                    np.minimum(window[:, :-step], least[:, step:], out=window[:, :-step])
            high = (window >> np.uint64(48)).view(np.int64) + self.bases[: len(window)]
            hit = self.maybe[size].take(high)
            if not hit.any():
                continue
            seen = set()
            for band, at in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
                for name in self.by_band[size].get((band, int(window[band, at])), ()):
                    if (name, at) not in seen:
                        seen.add((name, at))
                        yield name, at * block, at * block + (3 * block if size > 1 else 1), size

    def _copies(self, name: str, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int, float]]:
        """First word, end word and share of each run of ``hits`` (shingle of the text, of the set) in the template's order."""
        begin, last = 0, -1
        for i in range(len(hits) + 1):
            place = next((p for p in self.places[name][hits[i][1]] if p > last), None) if i < len(hits) else None
            if place is None and i > begin:
                share = len({at for _, at in hits[begin:i]}) / len(self.sets[name])
                if share >= self.threshold:
                    yield hits[begin][0], hits[i - 1][0] + SHINGLE, share
                if i < len(hits):
                    begin, place = i, self.places[name][hits[i][1]][0]
            last = place

    def matches(self, kmers: np.ndarray) -> list[tuple[str, int, int, float]]:
        """``template, first word, end word, containment``, sorted; overlapping ones are one."""
        spans: dict[str, list[tuple[int, int, float]]] = defaultdict(list)
        loose: dict[str, list[tuple[int, int, float]]] = defaultdict(list)
        step = STRETCH
        for begin in range(0, max(1, len(kmers)), step):
            part = kmers[begin : begin + step + 3 * self.largest]
            if not len(part):
                break
            for name, lo, hi, size in self._fetch(part):
                lo, hi = max(0, begin + lo - size), min(len(kmers), begin + hi + size)
                own = self.sets[name]
                at = np.searchsorted(own, kmers[lo:hi])
                at[at == len(own)] = 0
                inside = np.flatnonzero(own[at] == kmers[lo:hi])
                share = len(np.unique(at[inside])) / len(own)
                if share >= self.threshold:
                    hits = list(zip((lo + inside).tolist(), at[inside].tolist(), strict=True))
                    if copies := list(self._copies(name, hits)):
                        spans[name] += copies
                    else:
                        loose[name].append((hits[0][0], hits[-1][0] + SHINGLE, share))
        out = []
        for name in spans.keys() | loose.keys():
            copies = _joined(spans[name])
            # A window with less than a copy of its own may see parts of copies beside it.
            rest = [x for x in _joined(loose[name]) if not any(x[0] < hi and lo < x[1] for lo, hi, _ in copies)]
            out += [(name, *span) for span in copies + rest]
        return sorted(out, key=lambda m: (m[1], m[0]))


def _joined(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Spans in order, overlapping ones as one of the largest share."""
    out: list[tuple[int, int, float]] = []
    for lo, hi, share in sorted(spans):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]), max(share, out[-1][2]))
        else:
            out.append((lo, hi, share))
    return out


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per match: ``doc_id, license, first_word, end_word, containment, matched``."""
    bound_arrow_batches(docs.sparkSession)
    texts = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(texts, threshold)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
        names = ["doc_id", "license", "first_word", "end_word", "containment", "matched"]
        for batch in batches:
            rows = []
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                if len(words) < SHINGLE:
                    continue
                found = known.matches(shingles(words, SHINGLE))
                if found:
                    low = text.lower()
                    at = [m.span() for m in _WORD.finditer(low)]
                    rows += [(i, name, lo, hi, share, low[at[lo][0] : at[hi - 1][1]]) for name, lo, hi, share in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, license string, first_word long, end_word long, containment double, matched string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))


SQL = None
