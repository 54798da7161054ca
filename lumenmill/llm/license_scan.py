"""License scans: MinHash bands over overlapping windows find templates, exact containment verifies.

Words are runs of letters and digits, A-Z in lower case; everything else separates. Templates and
texts are compared by shingles of five words. Templates fall into classes by their length (powers
of two); a class has windows of twice its greatest length, a quarter of that apart, so that any
stretch of one and a half times the length lies whole in a window.

A window and a template meet if they agree in one of ``BANDS`` single-row MinHash bands. A window
of w shingles that holds 80 % of a template's t shingles resembles it by at least
0.8 * t / (w + 0.2 * t), so all bands miss with probability below (1 - that) ** BANDS. A template for
which this exceeds ``MISS`` (one with few shingles for its window) is not looked for by bands:
every shingle of the text is compared with its set, and windows that hold enough of them meet it.
Then the template's shingles inside the window are counted exactly: a match has 80 % of them.
Matches of one template that overlap are one span, from the first to the last shingle found.

The templates are few and fixed, a parameter; every window of every whole text is signed, in numpy,
within one Arrow pass without any shuffle.

Defined results: null and empty texts have no match; a template of fewer than five words is one
shingle of all its words; equal templates are each reported; repeated rows each get a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import LOWER, U, blocks, shingles_of, small_batches, span_hashes, text_column

K, BANDS, PERCENT = 5, 64, 80
MISS = 3e-6
BLOCK_BYTES = 1 << 20

# Public license notices, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

IS_BREAK = np.ones(256, bool)
IS_BREAK[48:58] = IS_BREAK[65:91] = IS_BREAK[97:123] = IS_BREAK[128:] = False
_rng = np.random.default_rng(11)
MULTIPLY = _rng.integers(1, 1 << 62, BANDS, dtype=np.int64).astype(U) * U(2) + U(1)


def prepare(data: np.ndarray, off: np.ndarray):
    """Word starts, ends, first word of each row; shingle hashes and first shingle of each row."""
    starts, ends, first = common.words_of(data, off, IS_BREAK)
    grams, at = shingles_of(span_hashes(data, starts, ends, LOWER), first, K)
    return starts, ends, first, grams, at


def minima(grams: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The minimum of every band's hash in the runs of shingles that start at ``cuts``: runs x BANDS."""
    out = np.empty((len(cuts), BANDS), np.uint32)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            out[:, b] = np.minimum.reduceat(((grams * MULTIPLY[b]) >> U(32)).astype(np.uint32), cuts)
    return out


class Library:
    """The templates by class, with their signatures."""

    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        self.sets, self.size, self.signature, self.classes, self.exact = [], [], [], {}, set()
        for i, (_, text) in enumerate(templates):
            raw = np.frombuffer(text.encode(), np.uint8)
            starts, _, _, grams, _ = prepare(raw, np.array([0, len(raw)]))
            self.sets.append(np.unique(grams))
            self.size.append(len(starts))
            self.signature.append(minima(grams, np.array([0]))[0] if len(grams) else None)
            if len(grams):
                size = max(3, int(np.ceil(np.log2(max(len(starts), 1)))))
                self.classes.setdefault(size, []).append(i)
                t, w = len(self.sets[i]), 2 << size
                if (1 - PERCENT * t / (100 * w + (100 - PERCENT) * t)) ** BANDS > MISS:
                    self.exact.add(i)
        self.few = np.unique(np.concatenate([self.sets[i] for i in sorted(self.exact)] or [np.zeros(0, U)]))

    def scan(self, data: np.ndarray, off: np.ndarray, banded: bool = True) -> list[tuple[int, int, int, int, float]]:
        """(row, template, first byte, end byte, containment) of all matches, ordered. Without ``banded`` every window is verified (for tests)."""
        starts, ends, first, grams, at = prepare(data, off)
        n_rows, found = len(off) - 1, []
        if not len(grams):
            return found
        count = np.diff(at)
        # Runs of ``unit`` shingles inside rows; a class's windows are several runs.
        unit = 1 << (min(self.classes) - 1)
        runs = -(-count // unit)
        begin = np.zeros(n_rows + 1, np.int64)
        np.cumsum(runs, out=begin[1:])
        row = np.repeat(np.arange(n_rows), runs)
        cuts = np.repeat(at[:-1], runs) + unit * (np.arange(begin[-1]) - np.repeat(begin[:-1], runs))
        low = minima(grams, cuts)
        # Where the shingles stand that belong to a template without bands.
        places = np.flatnonzero(self.few[np.minimum(np.searchsorted(self.few, grams), len(self.few) - 1)] == grams) if len(self.few) else np.zeros(0, np.int64)
        for size, members in sorted(self.classes.items()):
            step, width = (1 << (size - 1)) // unit, (2 << size) // unit  # in runs
            have = low
            span = 1
            while span < width:  # minima over span runs, doubled; runs past a row's end repeat its last
                nxt = np.minimum(np.arange(len(have)) + span, begin[row + 1] - 1)
                have = np.minimum(have, have[nxt])
                span *= 2
            place = np.arange(len(row)) - begin[row]
            windows = np.flatnonzero(place % step == 0)
            for t in members:
                if not banded:
                    hit = windows
                elif t in self.exact:
                    own = places[np.isin(grams[places], self.sets[t])]
                    stop = np.minimum(cuts[windows] + width * unit, at[row[windows] + 1])
                    hit = windows[100 * (np.searchsorted(own, stop) - np.searchsorted(own, cuts[windows])) >= PERCENT * len(self.sets[t])] if len(own) else windows[:0]
                else:
                    hit = windows[(have[windows] == self.signature[t]).any(1)]
                for w in hit:
                    r = row[w]
                    a, z = cuts[w], min(cuts[w] + width * unit, at[r + 1])
                    inside = np.flatnonzero(np.isin(grams[a:z], self.sets[t]))
                    got = len(np.unique(grams[a + inside]))
                    if 100 * got >= PERCENT * len(self.sets[t]):
                        word = first[r] + a - at[r]
                        last = min(word + inside[-1] + K, first[r + 1]) - 1
                        found.append((int(r), t, int(starts[word + inside[0]]), int(ends[last]), got / len(self.sets[t])))
        return merged(found)


def merged(found: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Overlapping spans of one template in one row become one, with the best containment."""
    out: list[list] = []
    for r, t, a, z, c in sorted(found):
        if out and out[-1][:2] == [r, t] and a < out[-1][3]:
            out[-1][3], out[-1][4] = max(out[-1][3], z), max(out[-1][4], c)
        else:
            out.append([r, t, a, z, c])
    return sorted(((r, t, a, z, c) for r, t, a, z, c in out), key=lambda x: (x[0], x[2], x[1]))


def scan_documents(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id and matches (license, template, start and end in code points, containment) of every row."""

    def run(batches):
        library = Library(templates)
        kind = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("containment", pa.float64())]))
        for b in batches:
            at = 0
            for _, _, data, off in blocks(text_column(b), BLOCK_BYTES):
                n = len(off) - 1
                rows: list[list[dict]] = [[] for _ in range(n)]
                matches = library.scan(data, off)
                if matches:
                    points = np.zeros(len(data) + 1, np.int64)
                    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
                    for r, t, a, z, c in matches:
                        rows[r].append({"license": library.names[t], "template": t, "start": int(points[a] - points[off[r]]), "stop": int(points[z] - points[off[r]]), "containment": round(c, 6)})
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(rows, kind)], names=["doc_id", "matches"])
                at += n

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, matches array<struct<license: string, template: int, start: long, stop: long, containment: double>>")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["stop"].cast("string"))), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"), spans.alias("spans"))
