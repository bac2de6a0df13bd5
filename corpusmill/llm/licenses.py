"""Operator 8: licence scan by MinHash bands over overlapping text windows.

Templates are grouped by length into classes; a class with templates of up to T
words has windows of 1.5 T words whose starts are close enough that every run of
T words lies in one window.  A window and a template are candidates if they agree
in one of the class's bands, each one MinHash value of the word pairs.  The number
of bands is the least with which a window that holds ``CONTAINMENT`` of a template
is a candidate with probability of at least ``RECALL``.  Candidates are verified by
exact containment: the share of the template's shingles that the window has.

TEMPLATES are ten short notices, headers and texts, and the scan covers these only:
a sibling that isn't listed (LGPL, GPL-2, CC BY-NC-ND, ..) is missed, or reported as
the listed one with which it shares ``CONTAINMENT`` of the word pairs.

Cases: null and empty texts, and those of one word, have no shingle and match
nothing; a template of one word is refused; of windows that match the same
template, the one with the highest containment is reported, the first of equals;
repeated rows are reported each; null ids are carried; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lower, mix, slices, small_batches, span_hashes, text_bytes, words

CONTAINMENT = 0.8
RECALL = 0.999
STRETCH = 1.5

TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-notice": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def word_list(text: str) -> list[bytes]:
    data, offs = text_bytes(lower(pa.array([text], pa.string())))
    a, b, _ = words(data, offs)
    raw = data.tobytes()
    return [raw[i:j] for i, j in zip(a.tolist(), b.tolist())]


def shingles(w: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(w, w[1:]))


def _pair_hashes(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def _values(pairs: np.ndarray, band: int) -> np.ndarray:
    """The hash function of a band: 64-bit multiply, upper half."""
    return ((pairs * np.uint64(0xD1342543DE82EF95 + 0x5851F42D4C957F2E * band & 0xFFFFFFFFFFFFFFFF | 1)) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Class:
    names: list[str]
    window: int  # in shingles
    stride: int
    bands: int
    keys: list[tuple[np.ndarray, np.ndarray]]  # per band: sorted MinHash values, template numbers


@dataclass
class Index:
    shingles: dict[str, set[tuple[bytes, bytes]]]
    classes: list[Class]
    containment: float

    @classmethod
    def build(cls, templates: dict[str, str], containment: float = CONTAINMENT, recall: float = RECALL) -> Index:
        w = {k: word_list(v) for k, v in sorted(templates.items())}
        if bad := [k for k, v in w.items() if len(v) < 2]:
            raise ValueError(f"templates of less than two words: {bad}")
        classes = []
        for size in sorted({max(1, math.ceil(math.log2(len(v)))) for v in w.values()}):
            names = [k for k, v in w.items() if max(1, math.ceil(math.log2(len(v)))) == size]
            longest = max(len(w[k]) for k in names) - 1
            window = max(longest + 1, math.ceil(STRETCH * longest))
            # the least Jaccard similarity of a template to a window that holds `containment` of it
            least = min(containment * len(shingles(w[k])) / (window + (1 - containment) * len(shingles(w[k]))) for k in names)
            bands = math.ceil(math.log(1 - recall) / math.log(1 - least))
            mins = []
            for k in names:
                raw = b" ".join(w[k])
                a = np.cumsum([0] + [len(x) + 1 for x in w[k][:-1]])
                p = _pair_hashes(span_hashes(np.frombuffer(raw, np.uint8), a, a + np.array([len(x) for x in w[k]])))
                mins.append([_values(p, b).min() for b in range(bands)])
            keys = []
            for b in range(bands):
                v = np.array([m[b] for m in mins], np.uint32)
                at = np.argsort(v, kind="stable")
                keys.append((v[at], at))
            classes.append(Class(names, window, window - longest + 1, bands, keys))
        return cls({k: shingles(v) for k, v in w.items()}, classes, containment)

    def scan(self, texts: pa.Array) -> list[tuple[int, str, float, int]]:
        """(text number, template, containment, first word of the window): the best window of each template."""
        n = len(texts)
        data, offs = text_bytes(lower(texts))
        a, b, of = words(data, offs)
        if len(a) < 2:
            return []
        pairs = _pair_hashes(span_hashes(data, a, b))
        first = np.searchsorted(of, np.arange(n))  # words and, as a text has one shingle less, its shingles begin here
        count = np.maximum(np.bincount(of, minlength=n) - 1, 0)
        candidates: set[tuple[int, int, int, str]] = set()
        plans = []
        for c in self.classes:
            per = np.where(count > 0, np.maximum(1, -(-(count - c.window) // c.stride) + 1), 0)
            doc = np.repeat(np.arange(n), per)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
            lo = first[doc] + k * c.stride
            hi = np.minimum(lo + c.window, first[doc] + count[doc])
            cuts = np.empty(2 * len(doc), np.int64)
            cuts[::2], cuts[1::2] = lo, hi
            plans.append((c, doc, lo, hi, cuts))
        for band in range(max(c.bands for c in self.classes)):
            values = np.append(_values(pairs, band), np.uint32(0xFFFFFFFF))
            for c, doc, lo, hi, cuts in plans:
                if band < c.bands and len(doc):
                    least = np.minimum.reduceat(values, cuts)[::2]
                    v, which = c.keys[band]
                    left, right = np.searchsorted(v, least, "left"), np.searchsorted(v, least, "right")
                    for x in np.flatnonzero(right > left).tolist():
                        for t in which[left[x] : right[x]].tolist():
                            candidates.add((int(doc[x]), int(lo[x]), int(hi[x]), c.names[t]))
        best: dict[tuple[int, str], tuple[float, int]] = {}
        raw = data.tobytes()
        for d, lo, hi, name in sorted(candidates):
            got = shingles([raw[i:j] for i, j in zip(a[lo : hi + 1].tolist(), b[lo : hi + 1].tolist())])
            share = len(self.shingles[name] & got) / len(self.shingles[name])
            if share >= self.containment and share > best.get((d, name), (0.0, 0))[0]:
                best[d, name] = (share, int(lo - first[d]))
        return [(d, name, share, at) for (d, name), (share, at) in best.items()]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, recall: float = RECALL) -> DataFrame:
    """(doc_id, license, containment, word): each row's templates, and where the best window begins.  No shuffle."""
    small_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(Index.build(TEMPLATES if templates is None else templates, containment, recall))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                if found := sent.value.scan(part.column("text")):
                    ids = part.column("doc_id").to_pylist()
                    d, name, share, at = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in d], pa.int64()), pa.array(name), pa.array(share, pa.float64()), pa.array(at, pa.int64())], names=["doc_id", "license", "containment", "word"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, license string, containment double, word long")
