"""License scans by conditional compression.

The words of a text, lower-cased and joined by blanks (so that a notice may be
wrapped over lines; comment marks are no words), are cut into overlapping blocks.
Each block is compressed given nothing and given each template as a raw zstandard
dictionary. Every template that shortens a block, however little, is a candidate
there; none is passed over for its rank. A fast compressor may save nothing on a
block full of other notices: if the block has a template's words, its pieces are
compressed in their turn, as well as can be. Candidates are confirmed by wording: all
of a template's words in order, save the places marked as free, and in templates of
ten words and more one changed, missing or added word in ten, which is reported.
Numbers and names of licenses never change. What a template saves on the words of
the notice then ranks what was confirmed: a notice within one that saves more, and
whose template holds all of its words, is a part of it, and a changed one doesn't
stand beside a better one of the same words.

Blocks overlap by more than a short template, so that each of those lies whole in a
block; of a longer one some block holds at least the overlap.

Empty inputs: null and empty texts have no blocks. Repeated rows give repeated
matches. Null ids are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

# Parts of the public notices below.
GPL = (
    "This {{}} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation{comma} "
    "either version {version} of the License, or (at your option) any later version. This {{}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "{} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "{} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_NAMES = "{} Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY {} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# Public license notices, whole texts of the short licenses among them. "{}" stands for up to eight free words (years, holders, names, numbers of clauses).
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use {} except in compliance with the License. You may obtain a copy of the License at {} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "GPL-3.0": ("licensed under the GNU General Public License, version 3", "GNU General Public License as published by the Free Software Foundation, either version 3", "SPDX-License-Identifier: GPL-3.0", GPL.format(kind="General", version=3, colon=":", comma=",")),
    "GPL-2.0": ("licensed under the GNU General Public License, version 2", "GNU General Public License as published by the Free Software Foundation; either version 2", "SPDX-License-Identifier: GPL-2.0", GPL.format(kind="General", version=2, colon=";", comma=";")),
    "LGPL-3.0": ("licensed under the GNU Lesser General Public License, version 3", GPL.format(kind="Lesser General", version=3, colon=":", comma=",")),
    "AGPL-3.0": ("licensed under the GNU Affero General Public License, version 3", GPL.format(kind="Affero General", version=3, colon=":", comma=",")),
    "MPL-2.0": ("subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "licensed under the BSD 3-Clause License", BSD + BSD_NAMES + BSD_END),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND {} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Released under CC0 1.0", "dedicated to the public domain under CC0 1.0"),
    "LGPL-2.1": (GPL.format(kind="Lesser General", version=2.1, colon=";", comma=";"),),
    "BSD-2-Clause": (BSD + BSD_END,),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "proprietary": ("Copyright {} All rights reserved",),
}
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
FREE = 8
SIZE, OVERLAP = 2000, 400  #: characters of a block, and of what it shares with the next
TOLERANCE = 10  #: one changed word is allowed in so many words of a template
NAMES = frozenset("affero apache bsd cc cc0 gnu isc lesser library mit mozilla mpl nc noncommercial noderivatives sa sharealike unlicense".split())
NEVER = 1 << 20  #: the cost of a change that is not allowed


def words(text: str) -> list[str]:
    return WORD.findall(text.lower().replace("{}", " 0x7free "))


def appearance(template: list[str], block: list[str], start: int) -> tuple[int, int] | None:
    """(end, foreign words) of the template's appearance from a word of the block on, if there is one."""
    at, extra = start, 0
    for k, w in enumerate(template):
        if w == "0x7free":
            nxt = template[k + 1] if k + 1 < len(template) else None
            skip = next((s for s in range(FREE + 1) if nxt is None or at + s < len(block) and block[at + s] == nxt), None)
            if skip is None:
                return None
            at, extra = at + skip, extra + skip
        elif at < len(block) and block[at] == w:
            at += 1
        else:
            return None
    # "version 3" isn't confirmed by "version 3.1", nor "CC BY" by "CC BY-NC": words are whole, and next to each other.
    return at, extra


def differences(template: list[str], block: list[str]) -> int | None:
    """Least number of foreign words within the template's first full appearance in the block; None if it doesn't appear.

    All words of the template must be there, in order, next to each other but for
    free places.
    """
    for start in (k for k, w in enumerate(block) if w == template[0]):
        got = appearance(template, block, start)
        if got is not None:
            return got[1]
    return None


def changed_appearances(template: list[str], block: list[str]) -> list[tuple[int, int, int, int, str]]:
    """(start, end, foreign words, changed words, the changes) of the template's appearances in the block with no more changes than allowed.

    An alignment of the whole template with any part of the block: a replaced
    ("old>new"), missing ("-old") or added ("+new") word costs one, up to ``FREE``
    words at a free place nothing; numbers of the template and names of licenses on
    either side don't change. Of ends that follow each other the cheapest counts.
    """
    n = len(block)
    index: dict[str, list[int]] = {}
    for k, w in enumerate(block):
        index.setdefault(w, []).append(k)
    named = np.array([w in NAMES for w in block])
    added = np.concatenate(([0], np.cumsum(np.where(named, NEVER, 1))))
    rows = [np.zeros(n + 1, np.int64)]
    for w in template:
        old = rows[-1]
        if w == "0x7free":
            new = old.copy()
            for s in range(1, FREE + 1):
                np.minimum(new[s:], old[:-s], out=new[s:])
        else:
            fixed = w in NAMES or w[0].isdigit()
            new = old + (NEVER if fixed else 1)
            step = np.full(n, NEVER, np.int64) if fixed else np.where(named, NEVER, 1)
            step[index.get(w, [])] = 0
            np.minimum(new[1:], old[:-1] + step, out=new[1:])
            new = added + np.minimum.accumulate(new - added)
        rows.append(new)
    last = rows[-1]
    good = np.flatnonzero(last <= allowed(template))
    out = []
    for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else ():
        end = j = int(run[np.argmin(last[run])])
        i, foreign, changes = len(template), 0, []
        while i:
            w, cost = template[i - 1], rows[i][j]
            fixed = w in NAMES or w[0].isdigit()
            if w == "0x7free":
                s = next(s for s in range(FREE + 1) if rows[i - 1][j - s] == cost)
                i, j, foreign = i - 1, j - s, foreign + s
            elif j and block[j - 1] == w and rows[i - 1][j - 1] == cost:
                i, j = i - 1, j - 1
            elif j and not fixed and not named[j - 1] and rows[i - 1][j - 1] + 1 == cost:
                changes.append(f"{w}>{block[j - 1]}")
                i, j = i - 1, j - 1
            elif not fixed and rows[i - 1][j] + 1 == cost:
                changes.append(f"-{w}")
                i -= 1
            else:
                changes.append(f"+{block[j - 1]}")
                j -= 1
        out.append((j, end, foreign, len(changes), " ".join(reversed(changes))))
    return out


def allowed(template: list[str]) -> int:
    return sum(w != "0x7free" for w in template) // TOLERANCE


def span(template: list[str]) -> int:
    """The most words that an appearance takes."""
    return len(template) + FREE * template.count("0x7free") + allowed(template)


class Template:
    def __init__(self, license: str, text: str):
        self.license, self.text, self.words = license, text, words(text)
        self.need = {w for w in self.words if w != "0x7free"}
        self.allowed, self.span = allowed(self.words), span(self.words)
        self.plain = " ".join(w for w in self.words if w != "0x7free")


class Scanner:
    def __init__(self):
        import zstandard as z

        # One way of compression for all blocks: literals as they are, no match under six bytes. Given
        # nothing means given a dictionary that no text can match, so that both sides are parsed alike.
        fast = z.ZstdCompressionParameters(window_log=15, hash_log=13, chain_log=12, search_log=1, min_match=6, target_length=1, strategy=z.STRATEGY_FAST, write_content_size=False)

        def given(text: str):
            d = z.ZstdCompressionDict(text.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=fast)
            return z.ZstdCompressor(dict_data=d, compression_params=fast).compress

        self.known = [Template(name, t) for name, texts in TEMPLATES.items() for t in texts]
        self.alone = given("\0" * 16)
        self.given = [given(t.plain) for t in self.known]
        self.best = z.ZstdCompressor(level=19)
        self.best_given = [z.ZstdCompressor(level=19, dict_data=z.ZstdCompressionDict(t.plain.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for t in self.known]
        self.first = {t.words[0] for t in self.known}
        # Templates that are a part of another; what stands in a free place is none.
        self.parts = {(i, k) for i, x in enumerate(self.known) for k, y in enumerate(self.known) if i != k and f" {' '.join(x.words)} " in f" {' '.join(y.words)} "}
        self.cache: dict[tuple[str, int], int] = {}

    def saving(self, notice: str, k: int) -> int:
        """Bytes that the template as a dictionary saves on the words of a notice."""
        if (notice, k) not in self.cache:
            if len(self.cache) > 5_000:
                self.cache.clear()
            raw = notice.encode()
            self.cache[notice, k] = len(self.best.compress(raw)) - len(self.best_given[k].compress(raw))
        return self.cache[notice, k]

    def ranked(self, block: str) -> list[tuple[int, int]]:
        """(bytes saved on a block, template) of all templates, those that save most first."""
        raw = block.encode()
        alone = len(self.alone(raw))
        return sorted(((alone - len(c(raw)), k) for k, c in enumerate(self.given)), key=lambda x: (-x[0], x[1]))

    def shortens_a_piece(self, k: int, own: list[str]) -> bool:
        """Whether the template shortens any piece of a few times its length, each compressed as well as can be."""
        n = self.known[k].span
        return any(self.saving(" ".join(own[i : i + 3 * n]), k) > 0 for i in range(0, max(len(own) - n, 1), 2 * n))

    def appearances(self, own: list[str]) -> set[tuple[int, int, int, int, int, str]]:
        """(start, end, template, foreign words, changed words, changes) of all that the wording confirms in a text's words."""
        joined = " ".join(own)
        ends = list(accumulate(len(w) + 1 for w in own))
        have, places, out = set(own), None, set()
        for at in range(0, max(len(joined) - OVERLAP, 1), SIZE - OVERLAP):
            # The words of which the block has a character.
            a, b = bisect_right(ends, at), bisect_left(ends, min(at + SIZE, len(joined))) + 1
            for saved, k in self.ranked(joined[at : at + SIZE]):
                t = self.known[k]
                if len(t.need - have) > t.allowed:
                    continue
                lo, hi = max(a - t.span, 0), min(b + t.span, len(own))
                near = own[lo:hi]
                if len(t.need.difference(near)) > t.allowed or saved <= 0 and not self.shortens_a_piece(k, near):
                    continue
                if places is None:
                    places = {w: [] for w in self.first}
                    for i, w in enumerate(own):
                        if w in self.first:
                            places[w].append(i)
                starts = places[t.words[0]]
                for start in starts[bisect_left(starts, lo) : bisect_left(starts, b)]:
                    got = appearance(t.words, own, start)
                    if got is not None:
                        out.add((start, got[0], k, got[1], 0, ""))
                if t.allowed:
                    for s, e, foreign, changed, how in changed_appearances(t.words, near):
                        # Only what touches the block is whole there.
                        if lo + s < b and lo + e > a:
                            out.add((lo + s, lo + e, k, foreign, changed, how))
        return out

    def notices(self, own: list[str]) -> list[tuple[int, int, int, int, int, int, str]]:
        """(start, end, template, saved bytes, foreign words, changed words, changes) of a text's notices."""
        found = [(s, e, k, self.saving(" ".join(own[s:e]), k), *x) for s, e, k, *x in sorted(self.appearances(own))]
        out, group, reach = [], [], 0
        for x in [*found, None]:
            if group and (x is None or x[0] >= reach):
                kept = []
                for y in sorted(group, key=lambda y: (-y[3], y[5], y[0], y[1], y[2], y[4])):
                    part = any(z[0] <= y[0] and y[1] <= z[1] and (y[2], z[2]) in self.parts for z in kept)
                    if not part and not (y[5] and any(z[0] < y[1] and y[0] < z[1] for z in kept)):
                        kept.append(y)
                out += kept
                group = []
            if x is not None:
                reach = max(reach, x[1]) if group else x[1]
                group.append(x)
        return out

    def scan(self, text: str) -> list[tuple[int, str, str, int, int, int, str]]:
        """(line, license, template, saved bytes, foreign words, changed words, changes) of each line that a confirmed notice begins in.

        Of a license's notices that begin in one line, the one that saves most.
        """
        own = words(text)
        got = self.notices(own) if own else []
        if not got:
            return []
        ends = list(accumulate(len(words(x)) for x in text.split("\n")))
        out = {}
        for start, end, k, saved, *x in got:
            t = self.known[k]
            line, rank = bisect_right(ends, start), (-saved, x[1], t.text)
            if (line, t.license) not in out or rank < out[line, t.license][0]:
                out[line, t.license] = rank, (line, t.license, t.text, saved, *x)
        return sorted(x for _, x in out.values())


def scan(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line, license, template, saved, foreign, changed, changes) for every confirmed license notice in the rows' whole texts, by the line it begins in."""
    storage.bounded_batches(df.sparkSession)
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())

    def run(batches):
        s = Scanner()
        for b in batches:
            got = [(k, *m) for k, x in enumerate(b.column(1).to_pylist()) for m in s.scan(x)]
            take = pa.array([g[0] for g in got], pa.int64())
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            names = ["id", "line", "license", "template", "saved", "foreign", "changed", "changes"]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds, 1))], names=names)

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, line int, license string, template string, saved int, foreign int, changed int, changes string").withColumnRenamed("id", id)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "line", "license", "saved", "foreign", "changed", "changes")
