"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

A template is a notice, a file header or the whole text of a short licence, as
shingles of five plain words in lower case (a shorter notice is one shingle as a
whole). An occurrence may be a quarter longer than its template. For each class
of such lengths the text has windows of twice that many words, each half over
the next, so every occurrence of at most that length lies whole in some window. With bands of one row a window at Jaccard similarity
J shares no band with probability (1 - J)**bands. Each length class has BANDS
bands or more, so many that this is at most MISSED for the smallest J of an
accepted occurrence of any of its templates: 1/12 for a notice of five words,
whose windows have 12 shingles. A retrieved pair is verified exactly: the share
of the template's shingles that the window holds must reach CONTAINED. Band keys
are smallest hashes, which are shingles of both sides, so only windows that hold
some template shingle need signatures.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.llm.common import LOWER, PLAIN, gram_hashes, mix64, slices, text_or_empty, word_hashes, word_spans

SHINGLE, BANDS, CONTAINED, MISSED = 5, 64, 0.8, 1e-5

# Public notices, file headers and licence texts.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under a Creative Commons Attribution 4.0 International License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "all-rights": "All rights reserved. No part of this publication may be reproduced",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "GPL-2.0-or-later-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "OFL-1.1-header": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
}


def spanned(words: int) -> int:
    """Words of the longest occurrence of a template that is looked for."""
    return words + max(2, words // 4)


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, PLAIN)
    return word_hashes(low, starts, ends), first


def text_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return plain_words(data, np.array([0, len(data)]))[0]


def row_shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word runs in order; fewer words are one run as a whole."""
    return gram_hashes(words, n) if len(words) >= n else gram_hashes(words, len(words)) if len(words) else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Smallest value of each of the bands' hash functions over the shingles."""
    salts = mix64(np.arange(1, bands + 1, dtype=np.uint64))
    return np.concatenate([mix64(shingles[:, None] ^ salts[None, a : a + 256]).min(0) for a in range(0, bands, 256)])


def least_jaccard(shingles: int, width: int, n: int, contained: float) -> float:
    """Smallest Jaccard similarity of a template to a window that holds an accepted occurrence of it."""
    common = next((k for k in range(1, shingles + 1) if k / shingles >= contained), shingles)
    return common / (2 * width - n + 1 + shingles - common)


def bands_for(jaccard: float, missed: float = MISSED) -> int:
    """Bands of one row, BANDS at least, of which a pair at this similarity shares none with probability ``missed`` at most."""
    return max(BANDS, math.ceil(math.log(missed) / math.log1p(-jaccard))) if jaccard < 1 else BANDS


class Templates:
    """Template shingles, and the table from (band, smallest hash) to templates of each window width."""

    def __init__(self, notices: dict[str, str], n: int = SHINGLE, contained: float = CONTAINED):
        self.n = n
        self.names = sorted(notices)
        self.words = [text_words(notices[name]) for name in self.names]
        self.sets = [np.unique(row_shingles(w, min(n, max(len(w), 1)))) for w in self.words]
        self.table: dict[int, dict[tuple[int, int], set[int]]] = {}
        self.sizes: dict[tuple[int, int], np.ndarray] = {}
        keys = [(1 << max(2, (spanned(len(w)) - 1).bit_length()), min(n, len(w))) for w in self.words]
        self.bands: dict[tuple[int, int], int] = {}
        for key, s in zip(keys, self.sets):
            if len(s):
                self.bands[key] = max(self.bands.get(key, 0), bands_for(least_jaccard(len(s), *key, contained)))
        for i, (key, s) in enumerate(zip(keys, self.sets)):
            if not len(s):
                continue
            own = self.table.setdefault(key, {})
            for b, v in enumerate(signature(s, self.bands[key]).tolist()):
                own.setdefault((b, v), set()).add(i)
            self.sizes[key] = np.unique(np.concatenate((self.sizes.get(key, np.zeros(0, np.uint64)), s)))

    def find(self, words: np.ndarray, contained: float = CONTAINED) -> list[tuple[int, int, int, float]]:
        """(template, first word, end word, containment) of every occurrence, each once, by template and place."""
        out: dict[tuple[int, int], tuple[int, float]] = {}
        for (width, n), table in self.table.items():
            if len(words) < n:
                continue
            shingles = gram_hashes(words, n)
            known = self.sizes[width, n]
            at = np.searchsorted(known, shingles)
            at[at == len(known)] = 0
            hits = np.flatnonzero(known[at] == shingles)
            # windows begin at multiples of the width and span twice as much
            starts = np.unique(np.concatenate((hits // width, hits // width - 1))) * width
            for s in starts[starts >= 0].tolist():
                own = shingles[s : s + 2 * width - n + 1]
                found: set[int] = set()
                for key in enumerate(signature(own, self.bands[width, n]).tolist()):
                    found |= table.get(key, set())
                for i in found:
                    place = np.flatnonzero(np.isin(own, self.sets[i]))
                    share = len(np.unique(own[place])) / len(self.sets[i])
                    if share >= contained:
                        for a, b in self.occurrences(own, place, i, contained):
                            old = out.get((i, s + a))
                            if old is None or old[1] < b[1]:
                                out[i, s + a] = (s + b[0], b[1])
        # neighbouring windows see the same place: of overlapping finds of a template the fullest, then the first, stays
        kept: list[tuple[int, int, int, float]] = []
        for (i, a), (e, share) in sorted(out.items()):
            if kept and kept[-1][0] == i and a < kept[-1][2]:
                if share > kept[-1][3]:
                    kept[-1] = (i, a, e, share)
            else:
                kept.append((i, a, e, share))
        return kept

    def occurrences(self, own: np.ndarray, place: np.ndarray, i: int, contained: float):
        """Runs of a template's shingles within the length of an occurrence, each checked on its own."""
        length = len(self.words[i])
        n = min(self.n, length)
        a = 0
        while a < len(place):
            b = a
            while b + 1 < len(place) and place[b + 1] - place[a] + n <= spanned(length):
                b += 1
            share = len(np.unique(own[place[a : b + 1]])) / len(self.sets[i])
            if share >= contained:
                yield int(place[a]), (int(place[b]) + n, share)
                a = b + 1
            else:
                a += 1


def scan(docs: DataFrame, notices: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """Licence notices in every text: (doc_id, matches array<struct<name, start, end, containment>>).

    ``start`` and ``end`` count plain words (runs of letters, digits,
    underscores and non-ASCII characters). ``notices`` maps names to notice
    texts, held by every task; an empty mapping finds nothing. Null text counts
    as empty; rows repeat as they come, doc_id may be null; columns other than
    doc_id and text are not read; an empty table gives an empty table.
    """
    notices = NOTICES if notices is None else notices
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(notices, contained=contained)
        every = np.unique(np.concatenate([np.zeros(0, np.uint64), *templates.sizes.values()]))
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                words, first = plain_words(data, offsets)
                # rows without any template shingle have no window to look at
                near = np.zeros(b - a, dtype=bool)
                for n in sorted({n for _, n in templates.table}):
                    grams = gram_hashes(words, n)
                    if len(grams) and len(every):
                        at = np.searchsorted(every, grams)
                        at[at == len(every)] = 0
                        near[np.searchsorted(first, np.flatnonzero(every[at] == grams), side="right") - 1] = True
                rows = [[{"name": templates.names[i], "start": s, "end": e, "containment": share} for i, s, e, share in templates.find(words[first[r] : first[r + 1]], contained)] if near[r] else [] for r in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, kind)], names=["doc_id", "matches"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty(F.col("text")).alias("text")).mapInArrow(find, "doc_id long, matches array<struct<name:string,start:int,end:int,containment:double>>")
