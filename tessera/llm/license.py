"""License scans: MinHash bands over overlapping windows of words retrieve templates; shingle containment verifies them.

Templates and windows are sets of word shingles (five words; a shorter template: all its words as one). For a template of
s words, windows of s + s // 8 words start every max(1, s // 8) words, so wherever the template stands in a text some
window holds it whole. A window that holds at least 0.8 of a template's shingles has a Jaccard index of at least about
0.6 with it; 16 bands of 2 hashes meet at 0.6 with a chance of 1 - (1 - 0.36)**16 = 0.9992, and several windows overlap.

Windows only retrieve. What counts is any span of up to twice the template's words that holds at least 0.8 of its distinct
shingles, so a notice with words put into its middle is a match too. Each retrieved window is searched with a template's
length of text on both sides; windows that overlap then are searched as one.

A band can only meet a template's where the window holds the shingles that the template's own minima come from, so
signatures are made only for windows with such a shingle: this skips work, not windows that could match.

Scale: texts are read once, nothing is shuffled or sent to the driver; the templates (a fixed library) go with the code.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm.common import prepare

WIDTH, PERMUTATIONS, ROWS, SEED = 5, 32, 2, 11
WORD = re.compile(r"\w+")

# Notices as their licenses word them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def _shingles(words: list[str], width: int) -> list[str]:
    return ["\0".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def _hash(shingles: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(s) for s in shingles], np.uint64)


@lru_cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


def _permuted(h: np.ndarray) -> np.ndarray:
    a, b = _multipliers()
    x = h[:, None] * a[None, :] + b[None, :]
    return x ^ (x >> np.uint64(31))


def _merged(regions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for lo, hi in sorted(regions):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _spans(events: list[tuple[int, str]], width: int, longest: int, n: int, threshold: float):
    """(start, end, share) in words, for every end the span of up to `longest` words with most of the n distinct shingles,
    without repeated ones at its start; those with the threshold or more. events: (place, shingle) in order."""
    count, left = Counter(), 0
    for p, x in events:
        count[x] += 1
        while p + width - events[left][0] > longest or count[events[left][1]] > 1:
            count[events[left][1]] -= 1
            if not count[events[left][1]]:
                del count[events[left][1]]
            left += 1
        if len(count) / n >= threshold:
            yield events[left][0], p + width, len(count) / n


class Library:
    """The templates by window size, with their bands."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold, self.ids, self.groups = threshold, {}, {}
        for name, text in sorted(templates.items()):
            words = WORD.findall(text.lower())
            if not words:
                continue
            width = min(WIDTH, len(words))
            group = self.groups.setdefault((len(words), width), {"bands": {}, "minima": set(), "sets": {}})
            shingles = _shingles(words, width)
            p = _permuted(_hash(shingles))
            for key in self.keys(p.min(axis=0)):
                group["bands"].setdefault(key, set()).add(name)
            group["minima"] |= {shingles[i] for i in set(p.argmin(axis=0).tolist())}
            group["sets"][name] = frozenset(shingles)
            for w in words:
                self.ids.setdefault(w, len(self.ids) + 1)
        for (_, width), g in self.groups.items():
            g["codes"] = self.codes(g["minima"], width)
            g["own"] = {name: self.codes(some, width) for name, some in g["sets"].items()}

    def codes(self, shingles, width: int) -> np.ndarray:
        return np.array(sorted(self.code([[self.ids[w] for w in s.split("\0")] for s in shingles], width)), np.uint64)

    @staticmethod
    def keys(minima: np.ndarray) -> list[tuple]:
        return [(i, *minima[i : i + ROWS].tolist()) for i in range(0, PERMUTATIONS, ROWS)]

    @staticmethod
    def code(ids, width: int) -> np.ndarray:
        a, out = np.asarray(ids, np.uint64).reshape(-1, width), np.uint64(0)
        for i in range(width):
            out = out * np.uint64(1 << 12) + a[:, i]
        return np.atleast_1d(out)

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, start, end, containment): code points of each match; matches of a template don't overlap."""
        words = WORD.findall((text or "").lower())
        ids = np.fromiter((self.ids.get(w, 0) for w in words), np.uint64, len(words))
        found = []
        for (size, width), g in self.groups.items():
            n = len(words) - width + 1
            if n < 1:
                continue
            code, known = np.zeros(n, np.uint64), np.ones(n, bool)
            for i in range(width):
                code = code * np.uint64(1 << 12) + ids[i : i + n]
                known &= ids[i : i + n] != 0
            at = np.flatnonzero(known & np.isin(code, g["codes"]))
            stride = max(1, size // 8)
            window = size + size // 8
            starts = sorted({s for p in at.tolist() for s in range(max(0, -(-(p + width - window) // stride) * stride), p + 1, stride)})
            near = {}
            for s in starts:
                names = set().union(*(g["bands"].get(k, ()) for k in self.keys(_permuted(_hash(_shingles(words[s : s + window], width))).min(axis=0))))
                for name in names:
                    near.setdefault(name, []).append((max(0, s - size), s + window + size))
            for name, regions in near.items():
                for lo, hi in _merged(regions):
                    at = lo + np.flatnonzero(known[lo : hi - width + 1] & np.isin(code[lo : hi - width + 1], g["own"][name]))
                    events = [(i, x) for i, x in ((i, "\0".join(words[i : i + width])) for i in at.tolist()) if x in g["sets"][name]]
                    found += [(name, *m) for m in _spans(events, width, 2 * size, len(g["sets"][name]), self.threshold)]
        if not found:
            return []
        spans = [m.span() for m in WORD.finditer(text.lower())]
        if len(text.lower()) != len(text):  # a letter whose lower case is two: find the words in the text itself
            spans = [m.span() for m in WORD.finditer(text)]
            spans = spans if len(spans) == len(words) else [(0, len(text))] * len(words)
        out, taken = [], {}
        for name, a, z, share in sorted(found, key=lambda x: (-x[3], x[2] - x[1], x[1], x[0])):
            spans_taken = taken.setdefault(name, [])
            i = bisect_left(spans_taken, (a, z))
            if (i == 0 or spans_taken[i - 1][1] <= a) and (i == len(spans_taken) or z <= spans_taken[i][0]):
                spans_taken.insert(i, (a, z))
                out.append((name, spans[a][0], spans[z - 1][1], share))
        return sorted(out, key=lambda x: (x[1], x[0]))


@lru_cache(8)
def library(templates: tuple, threshold: float) -> Library:
    return Library(dict(templates), threshold)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per match: doc_id, license, start, end (code points of the text), containment.

    Null, empty and wordless texts have no match. Null or repeated doc_id: every row is scanned and gives its own
    matches. Very long texts are scanned whole. Empty table: empty result. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    fixed = tuple(sorted((TEMPLATES if templates is None else templates).items()))
    fields = [("license", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("containment", T.DoubleType())]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(*x) for x in fields)])

    def run(batches):
        lib = library(fixed, threshold)
        for b in batches:
            rows = [(i, *m) for i, t in enumerate(b.column(1).to_pylist()) for m in lib.scan(t)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True))], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
