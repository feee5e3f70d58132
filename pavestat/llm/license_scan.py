"""License scans: MinHash bands over overlapping windows retrieve templates, exact
shingle containment verifies them.

Text and templates are words of ASCII letters, digits and non-ASCII characters, in
lower case. For a template of n words, windows of 3 n / 2 words every n / 2 words hold
every passage of n words whole, so a full copy has a Jaccard similarity of about 2/3
with some window, and at 4/5 containment about 1/2. With ``BANDS`` bands of ``ROWS``
values a similarity of 1/2 collides in some band with probability
1 - (1 - 1/4)^32 = 0.9999. Windows with too few shingles of templates to hold one are
passed over before hashing. What is retrieved is verified on the window and half a
template to both sides, so that a passage with words put into it is found wherever the
windows fall; the span that is returned runs from its first to its last shingle.

``texts()`` are the whole texts of the long licences, one file each beside this module;
``TEMPLATES`` are short licences, file headers and notices.

Templates of different licences that share most of their shingles are rivals: a hit counts
only if its passage has no more of what only a rival has.

Defined results: null and empty texts match nothing; a template found several times in
a text is one row with its best window; rows that repeat give rows that repeat; rows
without a match give none; extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import small_batches
from .common import arrow_map
from .shingles import _POSITION, _words, mix

WORDS, BANDS, ROWS, CONTAINMENT = 3, 32, 2, 0.8

#: Notices as they stand in public licences.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-notice-licensed": "Licensed under the MIT License",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT-notice-opening": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-notice-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-2.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL-3.0-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
}


#: Attributes of public licences of one family, whose notices differ by them alone: rivals.
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_GNU = {"GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"), "LGPL-2.1": ("Lesser General", "2.1"), "LGPL-3.0": ("Lesser General", "3"), "AGPL-3.0": ("Affero General", "3")}
_NOTICES = {f"CC-{code}-4.0-notice-long": f"This work is licensed under a Creative Commons {name} 4.0 International License." for code, name in _CC.items()}
_NOTICES |= {f"CC-{code}-4.0-notice-short": f"Licensed under CC {code} 4.0." for code in _CC}
_NOTICES |= {f"{code}-notice": f"This work is licensed under the GNU {name} Public License, version {version}." for code, (name, version) in _GNU.items()}
TEMPLATES |= {name: text for name, text in _NOTICES.items() if text not in TEMPLATES.values()}


def texts() -> dict[str, str]:
    """The whole texts of licences, by name."""
    return {p.stem + "-text": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


_PLAIN = np.ones(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_U = np.uint64
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def shingles(text: str | None) -> tuple[np.ndarray, int]:
    """Shingle hashes in order, and the number of words; few words are one shingle."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), 0
    data = np.where(_PLAIN[data], np.uint8(32), data)
    words, _ = _words(data, np.zeros(1, np.int64))
    n = len(words)
    k = min(WORDS, n)
    if not n:
        return np.zeros(0, np.uint64), 0
    rolled = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        rolled = rolled + words[j : n - k + 1 + j] * _POSITION[j]
    return mix(rolled + _U(k)), n


def bands(found: np.ndarray) -> np.ndarray:
    """The hash of each band of the MinHash of a set of shingles."""
    least = mix(found[None, :] ^ _SEEDS[:, None]).min(axis=1).reshape(BANDS, ROWS)
    return mix(least[:, 0] + mix(least[:, 1:]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


class Index:
    """Templates by band."""

    def __init__(self, templates: Mapping[str, str]) -> None:
        self.names = sorted(templates)
        self.sets, self.sizes, self.by_band = [], [], {}
        for k, name in enumerate(self.names):
            found, n = shingles(templates[name])
            own = np.unique(found)
            if not len(own):
                raise ValueError(f"template {name} has no words")
            self.sets.append(own)
            self.sizes.append(n)
            for b in bands(own).tolist():
                self.by_band.setdefault(b, set()).add(k)
        self.least = {n: min(len(x) for x, m in zip(self.sets, self.sizes, strict=True) if m == n) for n in sorted(set(self.sizes))}
        self.table = np.zeros(1 << 16, bool)
        self.table[(np.concatenate(self.sets) & _U(0xFFFF)).astype(np.int64)] = True
        self.all = np.unique(np.concatenate(self.sets))
        # other licences that share at least half the shingles of the smaller template,
        # with the shingles that only this one and only the other has
        licence = [name.split("-notice")[0].removesuffix("-text") for name in self.names]
        self.rivals: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in self.sets]
        for k, own in enumerate(self.sets):
            for r, other in enumerate(self.sets):
                if licence[k] != licence[r] and 2 * np.isin(own, other).sum() >= min(len(own), len(other)):
                    self.rivals[k].append((r, np.setdiff1d(own, other), np.setdiff1d(other, own)))

    def _beaten(self, k: int, found: np.ndarray, a: int, b: int) -> bool:
        """Whether the words ``a`` to ``b`` have more of what only a rival of ``k`` has
        than of what only ``k`` has. Where one holds the other whole, that decides by itself."""
        for r, own, other in self.rivals[k]:
            if not len(own) and not len(other):
                continue
            more = max(0, self.sizes[r] - self.sizes[k]) + WORDS  # a rival may differ in its first or last word
            here = found[max(0, a - more) : max(a + 1, b + more - WORDS + 1)]
            theirs = np.isin(other, here).mean() if len(other) else None
            mine = np.isin(own, here).mean() if len(own) else 1 - theirs
            # a few shingles at the joints of an inserted passage tell nothing by themselves
            if len(own) < WORDS < len(other):
                mine = 1 - theirs
            if theirs is None or len(other) < WORDS < len(own):
                theirs = 1 - mine
            if theirs > mine:
                return True
        return False

    def find(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """Name, containment, first and last word of the best window of each template."""
        found, n = shingles(text)
        maybe = np.flatnonzero(self.table[(found & _U(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.all, found[maybe]), len(self.all) - 1)
        maybe = maybe[self.all[at] == found[maybe]]
        best: dict[int, tuple[float, int, int]] = {}
        if not len(maybe):
            return []
        hits = np.zeros(len(found) + 1, np.int64)
        hits[maybe + 1] = 1
        hits = np.cumsum(hits)
        for size, least in self.least.items():
            if len(maybe) < CONTAINMENT / 2 * least:  # too few in the whole text
                continue
            step, width = max(1, size // 2), size + max(1, size // 2)
            last = max(0, -(-(n - width) // step))
            # windows that hold the shingle at word w begin between w + WORDS - width and w
            low = np.clip(-((width - WORDS - maybe) // step), 0, last)
            high = np.clip(maybe // step, 0, last)
            marks = np.zeros(last + 2, np.int64)
            np.add.at(marks, low, 1)
            np.add.at(marks, high + 1, -1)
            windows = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
            begin = windows * step
            end = np.maximum(begin + 1, np.minimum(n, begin + width) - WORDS + 1)
            # half of the least containment at most is outside a window that a passage lies across
            enough = hits[np.minimum(end, len(found))] - hits[begin] >= CONTAINMENT / 2 * least
            for a, z in zip(begin[enough].tolist(), end[enough].tolist(), strict=True):
                own = np.unique(found[a:z])
                if not len(own):
                    continue
                for k in set().union(*(self.by_band.get(x, ()) for x in bands(own).tolist())):
                    if self.sizes[k] != size:
                        continue
                    around = max(0, a - step)
                    at = np.flatnonzero(np.isin(found[around : z + step], self.sets[k])) + around
                    share = len(np.unique(found[at])) / len(self.sets[k])
                    if share < CONTAINMENT:
                        continue
                    first, stop = int(at[0]), min(n, int(at[-1]) + WORDS)
                    if share > best.get(k, (0.0,))[0] and not self._beaten(k, found, first, stop):
                        best[k] = (float(share), first, stop - 1)
        return [(self.names[k], *best[k]) for k in sorted(best)]


def scan(df: DataFrame, templates: Mapping[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, license, containment, first_word, last_word`` for each match. Without
    ``templates`` all of ``TEMPLATES`` and ``texts()``."""
    index = Index(TEMPLATES | texts() if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in index.find(t)]
            if rows:
                d, name, share, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(name), pa.array(share), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc_id", "license", "containment", "first_word", "last_word"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(rows, run, "doc_id long, license string, containment double, first_word int, last_word int")
