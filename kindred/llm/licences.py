"""License notices by conditional compression (operator 4).

A text's candidate blocks are the words around each license cue, as far as the longest template reaches. A block is
compressed by itself and with each template as a zstandard raw dictionary; templates that reduce its size are
confirmed in the order of the reductions, by the alignment with the fewest missing and added words around the cue. Of what
is confirmed at a place, the template that saves most and leaves least of the aligned words' compressed size wins (ties:
fewest differences). A cue's work does not depend on the rest of its text, and equal blocks are worked on once, so
time grows with the number of cues. Texts without a cue cost a few substring searches.

Defined cases: a null or empty text has no finding; a notice that is repeated gives a finding for each place; where
notices overlap (a license's first sentence in its whole text) the winner stays; null ids and repeated
rows are searched like any; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, documents, text_of

#: Wordings of public license notices.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("LGPL-2.1", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("All-Rights-Reserved", "All rights reserved."),
]
#: What a notice has at least one of, in lower case.
CUES = (b"licens", b"licenc", b"copyright", b"permission", b"redistribut", b"rights reserved", b"cc0", b"cc by", b"cc-by", b"creative commons", b"free software")
_CUE = re.compile(b"|".join(re.escape(c) for c in CUES))
#: Templates of more words are searched in blocks of their own size.
SHORT = 45
#: Words of a template that may be missing or added, as a part of its length.
TOLERANCE = 0.2
#: Blocks whose result a worker keeps.
KEPT = 20_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BARE = re.compile(r"[^\w.+-]+|[.]+$")


def _bare(word: str) -> str:
    return _BARE.sub("", word.lower()).strip(".")


def _words(text: str) -> list[str]:
    return [w for w in map(_bare, text.split()) if w]


def _size(words: int) -> int:
    """Words among which a template of so many is aligned."""
    return words + max(1, int(TOLERANCE * words))


class TemplateSet:
    """Compressors with each template as their dictionary."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES):
        import zstandard as z

        options = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.templates = templates
        self.words = [_words(t) for _, t in templates]
        self.pairs = [set(zip(w, w[1:])) for w in self.words]
        self.alone = z.ZstdCompressor(**options)
        self.given = [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT), **options) for _, t in templates]
        groups = [[i for i, w in enumerate(self.words) if (len(w) > SHORT) == long] for long in (False, True)]
        #: (templates, words on either side of a cue that they can reach)
        self.groups = [(g, max(_size(len(self.words[i])) for i in g)) for g in groups if g]
        self.reach = max((r for _, r in self.groups), default=0)
        self.known: dict[tuple[bytes, int], list[tuple]] = {}

    def sizes(self, i: int, block: bytes) -> tuple[int, int]:
        """Compressed sizes of a block by itself and with template i."""
        return len(self.alone.compress(block)), len(self.given[i].compress(block))

    def ranked(self, block: bytes, of: list[int]) -> list[int]:
        """The given templates that make the block smaller, the largest reduction first."""
        whole = len(self.alone.compress(block))
        made = sorted((len(self.given[i].compress(block)), i) for i in of)
        return [i for size, i in made if size < whole]


def _confirmed(own: list[str], words: list[str], cue: int) -> tuple[int, int, int, int] | None:
    """(differences, missing, first word, last word) of a template's alignment with the fewest missing and added words among
    those that cover the cue, if these are within the tolerance. Ties: the shortest."""
    size = _size(len(own))
    lo, hi = max(0, cue - size), min(len(words), cue + size + 1)
    number = {w: k for k, w in enumerate(dict.fromkeys(own))}
    there = np.array([number.get(w, -1) for w in words[lo:hi]])
    # least differences of the template's first words with the words up to each place, and where they begin: cost * 2^20 - begin
    step, at = 1 << 20, np.arange(len(there) + 1)
    row = -at
    for w in own:
        new = row + step
        new[1:] = np.where(there == number[w], np.minimum(row[:-1], new[1:]), new[1:])
        row = np.minimum.accumulate(new - at * step) + at * step
    cost = -(-row // step)
    begin = cost * step - row
    fits = (at > cue - lo) & (begin <= cue - lo) & (cost <= TOLERANCE * len(own)) & (begin < at)
    if not fits.any():
        return None
    end = int(min(np.flatnonzero(fits), key=lambda j: (cost[j], j - begin[j])))
    differences, first = int(cost[end]), int(begin[end])
    missing = (differences + len(own) - (end - first)) // 2
    return (differences, missing, lo + first, lo + end - 1) if _numbers(own, words[lo + first : lo + end]) else None


def _numbers(own: list[str], words: list[str]) -> bool:
    """A template's numbers (versions) have to occur as they are."""
    return all(w in words for w in own if any(c.isdigit() for c in w))


def _notices(templates: TemplateSet, words: list[str], spans: list[tuple[int, int]], raw: bytes, cue: int) -> list[tuple]:
    """Notices around a cue, the best of each group of templates: (score, -differences, -template, first word, last word, missing,
    reduction). The score is what the template saves less what it leaves: words that are not the template's count against it."""
    out = []
    for group, reach in reversed(templates.groups):  # whole texts first; a notice of one sentence may be part of one
        lo, hi = max(0, cue - reach), min(len(words), cue + reach + 1)
        near, best = set(zip(words[lo:hi], words[lo + 1 : hi])), None
        for i in templates.ranked(raw[spans[lo][0] : spans[hi - 1][1]], group):
            own = templates.words[i]
            if len(templates.pairs[i] & near) < len(templates.pairs[i]) - 2 * TOLERANCE * len(own):  # a difference breaks two pairs at most
                continue
            if got := _confirmed(own, words[lo:hi], cue - lo):
                first, last = got[2] + lo, got[3] + lo
                whole, given = templates.sizes(i, raw[spans[first][0] : spans[last][1]])
                made = (whole - 2 * given, -got[0], -i, first, last, got[1], (whole - given) / whole)
                best = made if best is None else max(best, made)
                if not got[0]:
                    break
        if best:
            out.append(best)
            if not best[1]:
                break
    return out


def findings(text: str, templates: TemplateSet) -> list[tuple[str, str, int, int, float, int, int]]:
    """(license, text, start, end, reduction, missing, added) of a text, offsets in UTF-8 bytes; the reduction is the part
    of the notice's compressed size that its template saves."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if not any(c in low for c in CUES):
        return []
    both = [(w, m.span()) for m in _WORD.finditer(raw) if (w := _bare(m[0].decode("utf-8", "replace")))]
    words, spans = [w for w, _ in both], [p for _, p in both]
    starts = [a for a, _ in spans]
    cues = sorted({k for m in _CUE.finditer(low) if (k := bisect_right(starts, m.start()) - 1) >= 0})
    found, covered = set(), -1
    for cue in cues:
        if cue <= covered:
            continue
        lo, hi = max(0, cue - templates.reach), min(len(words), cue + templates.reach + 1)
        key = raw[starts[lo] : spans[hi - 1][1]], cue - lo
        if key not in templates.known:
            if len(templates.known) >= KEPT:
                templates.known.clear()
            templates.known[key] = _notices(templates, words[lo:hi], [(a - starts[lo], b - starts[lo]) for a, b in spans[lo:hi]], key[0], cue - lo)
        for f in templates.known[key]:
            found.add((*f[:3], f[3] + lo, f[4] + lo, *f[5:]))
            if not f[1]:  # further cues of a notice without differences
                covered = f[4] + lo
    out, taken = [], []
    for _, minus, i, first, last, missing, saved in sorted(found, key=lambda f: (-f[0], -f[1], f[3], -f[2])):
        at = bisect_right(taken, (first, len(words)))
        if at and taken[at - 1][1] >= first or at < len(taken) and taken[at][0] <= last:
            continue
        insort(taken, (first, last))
        a, b = spans[first][0], spans[last][1]
        out.append((templates.templates[-i][0], raw[a:b].decode("utf-8", "replace"), a, b, saved, missing, -minus - missing))
    return sorted(out, key=lambda f: f[2])


_SETS: list[TemplateSet] = []


def license_findings(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """A row for each confirmed notice of each document."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if templates is not None or not _SETS:
            _SETS[:] = [TemplateSet(templates or TEMPLATES)]
        for batch in batches:
            rows = [(d, *f) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in findings(t, _SETS[0])]
            yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r)) for r in rows], schema=_OUT)

    keyed = docs.select(F.col(doc_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return keyed.mapInArrow(run, "doc_id long, license string, notice string, start long, end long, reduction double, missing int, added int")


_OUT = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("notice", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()), ("missing", pa.int32()), ("added", pa.int32())])


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_findings(documents(spark, sf_dir))
