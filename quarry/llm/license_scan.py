"""License scans: winnowed fingerprints in an inverted index pick candidates, banded alignment reports coverage and spans.

Words are runs of letters and digits, lower case.  Each template's k-word hashes are winnowed (the smallest of every `window`
neighbours), so a copied run of k + window - 1 words of a template always holds one of its fingerprints.  A text's
fingerprints that stand in the index give template and diagonal; near diagonals are aligned together within a band (longest common
subsequence), and an alignment that matches at least `least` of the template's words is reported with the span it covers.
A band is aligned when it holds one shared fingerprint, and one more for every EVIDENCE words of the template, and when its words,
in any order, could reach `least`.

Returns a row per find: doc_id, license, matched, coverage, start, end (code points, end exclusive).  Null and empty texts find nothing;
an empty table gives none; repeated rows are reported each; of finds of one template, or of one family of templates, that overlap, the one with more matched words stays.
No shuffle: the templates are a fixed, small list.  Whole texts of longer licenses are in the folder licenses (names end in -text).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from .shared import WordHashes, ngram_hashes, rows_of_texts, table, word_array

WORD = re.compile(r"[^\W_]+")
K, WINDOW, BAND = 3, 3, 8
#: Words of a template for each further fingerprint that a band must hold.
EVIDENCE = 200

#: Public licenses and notices; of three licenses also the terms alone, which stand in texts without the disclaimer.
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
MIT_DISCLAIMER = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
ISC_DISCLAIMER = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
BSD_THIRD = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def gnu_notice(name: str, version: str) -> str:
    """The notice for source files of the GNU licenses, which differ in name and version."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    )


TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "mit": MIT + MIT_DISCLAIMER,
    "mit-terms": MIT,
    "isc": ISC + ISC_DISCLAIMER,
    "isc-terms": ISC,
    "bsd-2-clause": BSD + BSD_DISCLAIMER,
    "bsd-3-clause": BSD + BSD_THIRD + BSD_DISCLAIMER,
    "bsd-terms": BSD,
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
        "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-2.0": gnu_notice("General", "2"),
    "gpl-3.0": gnu_notice("General", "3"),
    "lgpl-2.1": gnu_notice("Lesser General", "2.1"),
    "lgpl-3.0": gnu_notice("Lesser General", "3"),
    "agpl-3.0": gnu_notice("Affero General", "3"),
}

#: Of finds of one family that overlap, the one with more matched words stays, then the one with more coverage.
FAMILIES = (
    ("mit", "mit-terms"),
    ("isc", "isc-terms"),
    ("bsd-2-clause", "bsd-3-clause", "bsd-terms"),
    ("cc-by-4.0-notice", "cc-by-sa-4.0-notice"),
    ("gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "gpl-2.0-text", "gpl-3.0-text", "lgpl-2.1-text", "lgpl-3.0-text"),
    ("apache-2.0", "apache-2.0-text"),
    ("mpl-2.0-notice", "mpl-2.0-text"),
)
FAMILY = {x: f[0] for f in FAMILIES for x in f}


def whole_texts() -> dict[str, str]:
    """The licenses that have a file of their own, by name."""
    return {f"{f.stem}-text": f.read_text("utf-8") for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def winnowed(grams: np.ndarray, window: int = WINDOW) -> set[int]:
    """Places of the smallest hash of every window (the last of equals)."""
    if len(grams) <= window:
        return {len(grams) - 1 - int(np.argmin(grams[::-1]))} if len(grams) else set()
    least = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1].argmin(axis=1)
    return set((np.arange(len(least)) + window - 1 - least).tolist())


def aligned(template: list, words: list, shift: int, band: int = BAND) -> list[tuple[int, int]]:
    """Matched (template place, word place) pairs of a longest common subsequence within shift - band ... shift + band."""
    m, wide = len(template), 2 * band + 1
    score = [[0] * (wide + 2) for _ in range(m + 1)]
    for i in range(m - 1, -1, -1):
        row, below, own = score[i], score[i + 1], template[i]
        for d in range(wide - 1, -1, -1):
            j = i + shift - band + d
            best = max(below[d - 1] if d else 0, row[d + 1])
            if 0 <= j < len(words) and words[j] == own:
                best = max(best, 1 + below[d])
            row[d] = best
    out, i, d = [], 0, 0
    while i < m and d < wide:
        j = i + shift - band + d
        if score[i][d] == score[i][d + 1]:
            d += 1
        elif 0 <= j < len(words) and words[j] == template[i] and score[i][d] == 1 + score[i + 1][d]:
            out.append((i, j))
            i += 1
        elif d:
            i, d = i + 1, d - 1
        else:
            i += 1
    return out


class Templates:
    def __init__(self, texts: dict[str, str]):
        cache = WordHashes()
        self.names, self.words, index = list(texts), [], defaultdict(list)
        for t, text in enumerate(texts.values()):
            w = [x.lower() for x in WORD.findall(text)]
            grams = ngram_hashes(word_array([x.encode() for x in w], cache), K)
            self.words.append(w)
            for p in winnowed(grams):
                index[int(grams[p])].append((t, p))
        self.counts = [Counter(w) for w in self.words]
        self.index, self.keys = dict(index), np.array(sorted(index), np.uint64)

    def _may_reach(self, t: int, words: list[str], least: float) -> bool:
        """Whether the words could match so many of the template's, in any order."""
        return len(words) >= least and sum((Counter(words) & self.counts[t]).values()) >= least

    def found(self, text: str | None, least: float, cache: WordHashes) -> list[tuple]:
        words = WORD.findall((text or "").lower())
        if not words or not len(self.keys):
            return []
        grams = ngram_hashes(word_array([w.encode("utf-8", "replace") for w in words], cache), K)
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        spots = np.flatnonzero(self.keys[at] == grams).tolist()
        if not spots:
            return []
        shifts = defaultdict(list)
        for p in spots:
            for t, q in self.index[int(grams[p])]:
                if len(words) >= least * len(self.words[t]):
                    shifts[t].append(p - q)
        if not shifts:
            return []
        places = [(m.start(), m.end()) for m in WORD.finditer(text)]
        if len(places) != len(words):  # lower() may split a letter
            words = [text[s:e].lower() for s, e in places]
        out = []
        for t, own in shifts.items():
            finds, last, size = [], None, len(self.words[t])
            own = np.sort(np.array(own))
            for s in np.unique(own).tolist():
                if last is None or s - last > BAND // 2:
                    last = s
                    in_band = np.searchsorted(own, s + BAND, "right") - np.searchsorted(own, s - BAND, "left")
                    if in_band <= size // EVIDENCE or not self._may_reach(t, words[max(0, s - BAND) : max(0, s + size + BAND)], least * size):
                        continue
                    pairs = aligned(self.words[t], words, s)
                    if pairs and len(pairs) >= least * size:
                        finds.append((-len(pairs), places[pairs[0][1]][0], places[pairs[-1][1]][1]))
            taken: list[tuple] = []
            for n, s, e in sorted(finds):
                if all(e <= a or b <= s for _, a, b in taken):
                    taken.append((n, s, e))
            out += [(self.names[t], -n, -n / size, s, e) for n, s, e in taken]
        kept: list[tuple] = []
        for x in sorted(out, key=lambda x: (-x[1], -x[2])):
            family = FAMILY.get(x[0], x[0])
            if all(x[4] <= y[3] or y[4] <= x[3] for y in kept if FAMILY.get(y[0], y[0]) == family):
                kept.append(x)
        return sorted(kept, key=lambda x: (x[3], x[0]))


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """templates: name -> text; by default the notices and short licenses above and the whole texts of the longer ones."""
    texts = TEMPLATES | whole_texts() if templates is None else templates

    def start():
        own, cache = Templates(texts), WordHashes()
        return lambda batch: ((k, *x) for k, t in enumerate(batch) for x in own.found(t, least, cache))

    return rows_of_texts(docs, "doc_id", "text", "license string, matched long, coverage double, start long, end long", start)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
