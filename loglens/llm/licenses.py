"""License scans by patience alignment.

A text and a template are anchored on words that are unique in both; the
longest increasing subsequence of the anchors stays; the gaps between anchors
are aligned in the same way, with what is unique there.  A gap without any
such word is matched word by word from both its ends.  The aligned share of
the template's words is its coverage; ``LEAST`` and more of it is a finding
if all of its telling words (names, versions, Affero, Lesser, ShareAlike ...)
are aligned, no other telling word stands within, and not more words of the
text stand within unaligned than may be missing of the template.

Texts are whole: every place with a template's rarer words is a window of up
to twice the template's length, so a license may stand anywhere and more than
once.  A template can't be covered without one of the words that its windows
are sought by (they make up more than 1 - ``LEAST`` of it).

Edge cases: null and empty texts have no findings; of windows of a license
that overlap, the best covered (then first) counts; repeated rows get their
own findings; ids may be null; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import map_arrow, slices, text_or_empty

LEAST = 0.8
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

# Identifiers and notices of common licenses, public texts.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "MIT-text": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD License.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-NC-SA-4.0": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "Apache-1.1": ["Licensed under the Apache License, Version 1.1."],
    "Zlib": ["Licensed under the Zlib License."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "Artistic-2.0": ["Licensed under the Artistic License 2.0."],
    "proprietary": ["All rights reserved."],
}
# SPDX lines: the license each identifier stands for.
SPDX = {x: x for x in TEMPLATES if x not in ("MIT-text", "BSD", "proprietary")} | {"BSD-2-Clause": "BSD", "BSD-3-Clause": "BSD"}
for _id, _license in SPDX.items():
    TEMPLATES[_license] = [*TEMPLATES[_license], f"SPDX-License-Identifier: {_id}"]
# Words that tell licenses apart; so do versions.
TELLING = frozenset(
    "mit apache gpl lgpl agpl gnu lesser library affero mozilla mpl bsd isc cc by sa nc nd attribution sharealike noncommercial noderivatives cc0 zlib boost bsl "
    "eclipse epl artistic unlicense spdx proprietary clause".split()
)
# End of the fixed values.

# Words that stand in many notices or in ordinary prose: windows are sought by others where these don't suffice.
COMMON = frozenset("a all an and any are at be by for from in is it of or that the this to under use with you v version 4.0 3 2".split())


def telling(words: list[str]) -> set[int]:
    """Places of the words that tell a license from others."""
    license = not {"license", "licensed", "licenses", "cc"}.isdisjoint(words)
    return {
        i for i, w in enumerate(words)
        if license and (w in TELLING and (w not in ("by", "library") or words[max(0, i - 1)] in ("cc", "gnu", "identifier")) or (w[0].isdigit() and ("." in w or words[max(0, i - 1)] in ("version", "v", "bsd"))))
    }


def split(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _unique(words: list[str]) -> dict[str, int]:
    count = Counter(words)
    return {w: i for i, w in enumerate(words) if count[w] == 1}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second places increase too: patience piles."""
    tops: list[int] = []
    piles: list[int] = []  # the pair on each pile
    below: list[int] = []
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        below.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[pile], piles[pile] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = below[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of aligned words of a and b, increasing in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = _unique(a[a0:a1]), _unique(b[b0:b1])
        kept = _increasing(sorted((a0 + i, b0 + in_b[w]) for w, i in in_a.items() if w in in_b))
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        if kept:
            gaps += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:])]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, split(text)
        # the rarest looking words, until the rest alone is less than LEAST of all
        count, self.probes, held = Counter(self.words), set(), 0
        for w in sorted(count, key=lambda w: (w in COMMON, -len(w), w)):
            if len(self.words) - held < LEAST * len(self.words):
                break
            self.probes.add(w)
            held += count[w]
        self.telling = telling(self.words)
        self.need = -(-LEAST * len(self.words) // 1)

    def findings(self, words: list[str], at: dict[str, list[int]]) -> Iterator[tuple[int, int, int]]:
        """covered, first and end word of the windows that cover enough of the template."""
        hits = sorted((i, w) for w in self.probes for i in at.get(w, ()))
        size, until = len(self.words), -1
        for hit, word in hits:
            if hit < until:
                continue  # inside a finding
            # the wide window, then those where the word stands as in the template: repeats leave nothing unique in a wide one
            starts = [(hit - size, hit + size), *((hit - q, hit - q + size) for q, w in enumerate(self.words) if w == word)]
            for start, end in starts:
                start = max(0, start)
                pairs = _dense(_tight(align(words[start:end], self.words), size))
                if len(pairs) >= self.need and self._tells(words[start:end], pairs):
                    until = start + pairs[-1][0] + 1
                    yield len(pairs), start + pairs[0][0], until
                    break


    def _tells(self, words: list[str], pairs: list[tuple[int, int]]) -> bool:
        first, end, met = pairs[0][0], pairs[-1][0] + 1, {i for i, _ in pairs}
        if end - first - len(pairs) > len(self.words) - self.need or not self.telling <= {j for _, j in pairs}:
            return False
        # with the word before, which tells by and versions
        return all(i < first or i in met for i in (max(0, first - 1) + j for j in telling(words[max(0, first - 1) : end])))


def _dense(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The run of pairs with the most of them over the words of the text between them."""
    best, best_sum, start, total = (0, 0), 0, 0, 0
    for k, (i, _) in enumerate(pairs):
        if k:
            total -= i - pairs[k - 1][0] - 1
        if total < 0:
            start, total = k, 0
        total += 1
        if total > best_sum:
            best, best_sum = (start, k + 1), total
    return pairs[best[0] : best[1]]


def _tight(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Without words at the ends that lie further off than the template is long."""
    if not pairs:
        return pairs
    middle = pairs[len(pairs) // 2]
    return [p for p in pairs if abs((p[0] - middle[0]) - (p[1] - middle[1])) <= size]


def find_all(text: str, templates: list[Template], probes: frozenset[str]) -> list[tuple[str, int, int, int, int]]:
    """license, first word, end word, covered words and template words of every finding, in order."""
    words = split(text)
    if probes.isdisjoint(words):
        return []
    at: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in probes:
            at.setdefault(w, []).append(i)
    found = []
    for t in templates:
        found += [(t.name, first, end, covered, len(t.words)) for covered, first, end in t.findings(words, at)]
    # of overlapping findings the longer, then the better covered
    found.sort(key=lambda f: (-f[3], -f[3] / f[4], f[1], f[0]))
    kept: list[tuple[str, int, int, int, int]] = []
    for f in found:
        if all(f[2] <= g[1] or g[2] <= f[1] for g in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: (f[1], f[0]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: dict[str, list[str]] | None = None) -> DataFrame:
    """key, license, first_word, end_word, covered, template_words: a row for each finding."""
    templates = [Template(name, t) for name, ts in (texts or TEMPLATES).items() for t in ts]
    probes = frozenset(w for t in templates for w in t.probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, found = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for f in find_all(value, templates, probes):
                    rows.append(i)
                    found.append(f)
            columns = list(zip(*found)) if found else [[]] * 5
            kinds = [pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    names = ["_k", "license", "first_word", "end_word", "covered", "template_words"]
    rows = docs.select(F.col(key).alias("_k"), text_or_empty(text).alias("text"))
    kind = rows.schema["_k"].dataType.simpleString()
    return map_arrow(rows, run, f"_k {kind}, license string, first_word long, end_word long, covered long, template_words long").withColumnRenamed("_k", key)
