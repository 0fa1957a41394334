"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Words are compared in lower case without punctuation, digits as one sign. Every template's word GRAM-grams are hashed
and winnowed: of each WINDOW neighbouring hashes the smallest goes to an inverted index. All grams of a document are
looked up there, so a shared run of GRAM + WINDOW - 1 words always hits. Templates of under SHORT words are not winnowed,
and those of under TINY words are indexed by pairs of words, so that four of five words still hit. Hits near one diagonal
are one candidate; the template is then aligned with the document inside a band around that diagonal, a quarter of a
short template wide. The coverage is the share of template words that the alignment matches; the words that name the
license (KEYWORDS) must be among them. The span runs from the first matched word to the last.

Defined results: null and empty texts have no match; repeated notices in one text are separate rows; of matches whose
spans overlap the one with more matched words stays, then the one whose license sorts first; repeated rows are scanned
each; long texts are scanned whole; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, split_unique

GRAM, WINDOW, BAND = 3, 4, 12
SHORT, TINY = 20, 10
# fixed values: public notices and license openings
TEMPLATES = {
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "Apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "BSD": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "AGPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0": ["Licensed under CC0 1.0 Universal.", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    # clauses that several licenses share with one family
    "MIT warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "BSD warranty": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "Apache warranty": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
}
# fixed values: short identifiers of licenses, each named in a line of its own
IDENTIFIERS = {
    "GPL": ["GPL-2.0-only", "GPL-2.0-or-later"], "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later"], "AGPL": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "MIT": ["MIT"], "Apache": ["Apache-2.0"], "BSD": ["BSD-3-Clause"], "ISC": ["ISC"], "MPL": ["MPL-2.0"],
    "EPL": ["EPL-2.0"], "Unlicense": ["Unlicense"], "CC0": ["CC0-1.0"], "Zlib": ["Zlib"], "CC-BY": ["CC-BY-4.0"], "CC-BY-SA": ["CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"], "CC-BY-ND": ["CC-BY-ND-4.0"], "CC-BY-NC-SA": ["CC-BY-NC-SA-4.0"], "CC-BY-NC-ND": ["CC-BY-NC-ND-4.0"],
}
for _name, _ids in IDENTIFIERS.items():
    TEMPLATES[_name] = TEMPLATES[_name] + [f"{start} {i}" for i in _ids for start in ("SPDX-License-Identifier:", "Licensed under")]
# fixed values: words that name a license, as normal() leaves them
KEYWORDS = set("gnu lesser mit apache bsd mozilla by bync bysa bynd byncsa byncnd attribution attributionnoncommercial attributionsharealike attributionnoderivatives attributionnoncommercialsharealike attributionnoncommercialnoderivatives".split())
_DROP, _DIGITS, _NUMBER, _WORD = re.compile(r"[^\w#]+|_+"), re.compile(r"[\d.]*\d"), re.compile(r"\d+(?:\.\d+)*"), re.compile(r"[^ \t-\r]+")


def normal(word: str) -> str:
    return _DROP.sub("", _DIGITS.sub("#", word.lower()))


KEYWORDS |= {"affero", "eclipse", "cc#"} | {normal(i) for ids in IDENTIFIERS.values() for i in ids}


def _hash(words: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash for the gram at each place."""
    n = len(words) - gram + 1
    out = np.full(max(0, n), gram, dtype=np.uint64)
    for k in range(gram if n > 0 else 0):
        out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _codes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)


def winnow(hashes: np.ndarray) -> list[int]:
    """Places of the smallest hash of each window, the last one if several are equal; all windows of a short list are one."""
    picked = set()
    for i in range(max(1, len(hashes) - WINDOW + 1)):
        part = hashes[i : i + WINDOW]
        if len(part):
            picked.add(i + len(part) - 1 - int(part[::-1].argmin()))
    return sorted(picked)


def align(template: list[int], words: list[int], shift: int, band: int = BAND) -> list[tuple[int, int]]:
    """Longest common subsequence of template and words within `band` of the diagonal j = i + shift: matched (i, j)."""
    size = 2 * band + 1
    rows, before = [], [0] * (size + 1)
    for i, t in enumerate(template):
        # cell d stands for j = i + shift - band + d; the row above is one further along
        now, step = [0] * (size + 1), [0] * size
        for d in range(size):
            j = i + shift - band + d
            up, left = before[d + 1], now[d - 1] if d else 0
            if 0 <= j < len(words) and words[j] == t and before[d] + 1 > max(up, left):
                now[d], step[d] = before[d] + 1, 1
            elif up >= left:
                now[d], step[d] = up, 2
            else:
                now[d], step[d] = left, 3
        rows.append(step)
        before = now
    i, d, out = len(template) - 1, max(range(size), key=lambda x: (before[x], -abs(x - band))), []
    while i >= 0 and 0 <= d < size:
        s = rows[i][d]
        if s == 1:
            out.append((i, i + shift - band + d))
            i -= 1
        elif s == 2:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return out[::-1]


class Scanner:
    def __init__(self, templates: dict[str, list[str]], coverage: float, keywords: set[str] = frozenset(KEYWORDS)):
        self.coverage = coverage
        self.names, self.codes, self.bands, self.needed = [], [], [], []
        self.index: dict[int, dict[int, list[tuple[int, int]]]] = {GRAM: {}, 2: {}}
        for name, texts in sorted(templates.items()):
            for text in texts:
                words = [w for w in map(normal, text.split()) if w]
                code, needed = _codes(words), {i for i, w in enumerate(words) if w in keywords}
                gram = GRAM if len(words) >= TINY else min(2, len(words))
                h = _hash(code, gram)
                if len(words) >= SHORT:
                    places = winnow(h)
                else:  # of a tiny template, the pairs with its name in them
                    places = [i for i in range(len(h)) if len(words) >= TINY or not needed or needed & set(range(i, i + gram))]
                for at in places:
                    self.index.setdefault(gram, {}).setdefault(int(h[at]), []).append((len(self.names), at))
                self.names.append(name)
                self.codes.append(code.tolist())
                self.bands.append(min(BAND, max(1, len(words) // 4)))
                self.needed.append(needed)
        self.keys = {gram: np.array(sorted(index), dtype=np.uint64) for gram, index in self.index.items() if index}

    def scan(self, texts: pa.Array) -> list[list[tuple]]:
        """For each text its matches: (license, version, coverage, first_char, end_char, first_word, words)."""
        names, index, counts = split_unique(texts)
        plain = [normal(n) for n in names]
        code, some = _codes(plain), np.array([bool(p) for p in plain], dtype=bool)
        words, kept = code[index] if len(names) else code, some[index] if len(names) else some
        ends = np.cumsum(counts)
        of_word = np.repeat(np.arange(len(counts)), counts)[kept]
        nth = (np.arange(len(words)) - np.repeat(ends - counts, counts))[kept]
        words = words[kept]
        found: dict[int, list[tuple]] = {}
        tried: dict[tuple[int, int], list[int]] = {}
        begin = np.searchsorted(of_word, np.arange(len(counts) + 1))
        for gram, keys in self.keys.items():
            grams = _hash(words, gram)
            if not len(grams):
                continue
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            hits = np.flatnonzero((keys[at] == grams) & (of_word[: len(grams)] == of_word[gram - 1 :]))
            for g in hits.tolist():
                text = int(of_word[g])
                lo, hi = int(begin[text]), int(begin[text + 1])
                for t, place in self.index[gram][int(grams[g])]:
                    shift, band = g - lo - place, self.bands[t]
                    near = tried.setdefault((text, t), [])
                    if any(abs(s - shift) <= band // 2 for s in near[-8:]):  # hits come in the order of places
                        continue
                    near.append(shift)
                    start, stop = max(lo, lo + shift - band), min(hi, lo + shift + len(self.codes[t]) + band)
                    pairs = align(self.codes[t], words[start:stop].tolist(), lo + shift - start, band)
                    if pairs and len(pairs) >= self.coverage * len(self.codes[t]) and self.needed[t] <= {i for i, _ in pairs}:
                        a, b = start + pairs[0][1], start + pairs[-1][1]
                        found.setdefault(text, []).append((len(pairs), self.names[t], len(pairs) / len(self.codes[t]), int(nth[a]), int(nth[b])))
        out = []
        for text in range(len(counts)):
            rows = []
            for m, name, share, a, b in sorted(found.get(text, ()), key=lambda x: (-x[0], -x[2], x[1], x[3])):
                if all(b < r[5] or a >= r[5] + r[6] for r in rows):
                    spans = [(w.start(), w.end()) for w in _WORD.finditer(texts[text].as_py())]
                    first, end = spans[a][0], spans[b][1]
                    version = _NUMBER.findall(texts[text].as_py()[first:end])
                    rows.append((name, version[-1] if version else None, share, first, end, a, b - a + 1))
            out.append(sorted(rows, key=lambda r: r[3]))
        return out


def scan(docs: DataFrame, *, templates: dict[str, list[str]] | None = None, coverage: float = 0.8) -> DataFrame:
    """(doc_id, license, version, coverage, first_char, end_char, first_word, n_words): a row per match."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates or TEMPLATES, coverage))  # the templates only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(d, *m) for d, ms in zip(b.column("doc_id").to_pylist(), shared.value.scan(b.column("text")), strict=True) for m in ms]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "license", "version", "coverage", "first_char", "end_char", "first_word", "n_words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, version string, coverage double, first_char long, end_char long, first_word long, n_words long")
