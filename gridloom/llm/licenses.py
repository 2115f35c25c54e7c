"""License texts found by conditional compression.

Candidate blocks are the stretches of a text around cues, wide enough for the longest template on both sides. Cues are words that licenses use, and runs
of the templates' own words: a template is cut in one run more than it may differ by words, so that any stretch that is confirmed holds some
run whole, and no template needs a word of licenses in it. A block is compressed with zstandard alone and with each template as a raw dictionary. Templates are ranked by how
many bytes they spare; only those that spare any are candidates, and the first of them of which some stretch of the block is near enough wins: its
closest stretch is confirmed by the exact words in which it differs. Where several candidates fit that stretch, the one that explains most of its words is
confirmed. Its words leave the block, and the rest is compressed and ranked again, until no candidate fits. Templates that spare bytes but
aren't confirmed follow by how much they spare. A task keeps the verdicts of the last blocks it saw.

Defined results: null and empty texts have no blocks; a text without cues has no rows; long texts are read whole, in blocks that
overlap by more than the longest template, and what two blocks confirm is reported once; repeated rows are each reported; equal templates
rank by name; first and length are those of the confirmed stretch, or else of the block; an empty table gives an empty result; columns of docs that
share a name with a result give way to it.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ._support import read_texts, unpacked

#: Wording of common licenses and of the notices by which texts name them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-conditions": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions "
        "in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution."
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "bsd-warranty": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "isc-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mit-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
CUE = re.compile(r"licen[sc]|copyright|hereby granted|redistribut|creative commons|spdx", re.IGNORECASE)
_WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Share of a template's words by which a confirmed block may differ, and blocks whose verdicts a task keeps.
MOST_DIFFERENT, KEPT = 0.2, 2_000
#: Words of a section of a longer text, about.
SECTION = 150

_TYPE = "template string, rank int, spared double, confirmed boolean, missing array<string>, added array<string>, first bigint, length bigint"


def sections(name: str, text: str, size: int = SECTION) -> dict[str, str]:
    """Templates of a whole license text: its sentences in stretches of about so many words, numbered from 1. All of a text's sections, in order, are the text."""
    out, held = [], []
    for part in re.split(r"(?<=[.;:])\s+", text):
        held.append(part)
        if len(words(" ".join(held))) >= size:
            out.append(" ".join(held))
            held = []
    if held and out and len(words(" ".join(held))) < size // 3:
        out[-1] += " " + " ".join(held)
    elif held:
        out.append(" ".join(held))
    return {f"{name}#{i}": x for i, x in enumerate(out, 1)}


class Cues:
    """Where a text may hold a license: words of licenses, and whole runs of the templates' words."""

    def __init__(self, templates: dict[str, str]):
        self.around = 2 * max(map(len, templates.values()))  # for line breaks, indents and comment signs
        runs: dict[str, list[re.Pattern]] = {}
        for text in templates.values():
            for run in own_runs(words(text)):
                if run and not CUE.search(" ".join(run)):
                    runs.setdefault(max(run, key=len), []).append(re.compile(r"(?<![^\W_])" + r"[\W_]+".join(map(re.escape, run)) + r"(?![^\W_])"))
        self.anchors = ahocorasick.Automaton()
        for word, patterns in runs.items():
            self.anchors.add_word(word, (len(word), patterns))
        if runs:
            self.anchors.make_automaton()
        self.any = bool(runs)

    def find(self, text: str) -> list[tuple[int, int]]:
        """Starts and ends of all cues, in order."""
        found = [m.span() for m in CUE.finditer(text)]
        if self.any:
            lower = text.lower()
            if len(lower) != len(text):  # a letter that has two in lower case
                lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
            for end, (size, patterns) in self.anchors.iter(lower):
                lo = max(0, end - self.around)
                if any(m.start() <= end + 1 - size and m.end() > end for p in patterns for m in p.finditer(lower, lo, min(len(lower), end + self.around))):
                    found.append((end + 1 - size, end + 1))
        return sorted(found)


def own_runs(some: list[str]) -> list[list[str]]:
    """One run of successive words more than a stretch may differ by: whatever differs, some run is whole."""
    n = int(MOST_DIFFERENT * len(some)) + 1
    cuts = [len(some) * k // n for k in range(n + 1)]
    return [some[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def spans(text: str, cues: Cues) -> Iterator[tuple[int, int]]:
    """Stretches around cues; near ones join, and long ones are cut into blocks that overlap by more than the longest template."""
    start, end, around = -1, -1, cues.around
    for a, b in cues.find(text):
        lo, hi = max(0, a - around), min(len(text), b + around)
        if start >= 0 and lo > end:
            yield start, end
            start = -1
        start, end = lo if start < 0 else start, max(hi, end)
        while end - start > 4 * around:
            yield start, start + 4 * around
            start += 3 * around
    if start >= 0:
        yield start, end


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def align(want: np.ndarray, own: np.ndarray) -> tuple[int, list[int], list[int], int, int]:
    """The fewest words to leave out of want and of some stretch of own for both to be equal: their number, which of want, which of own, and the stretch.

    Row by row over own: the least number for each beginning of want and the best stretch that ends here.
    """
    m = len(want)
    place = np.arange(m + 1, dtype=np.int32)
    rows = np.empty((len(own) + 1, m + 1), np.int32)
    rows[0] = place
    for j, w in enumerate(own.tolist(), 1):
        now = rows[j - 1] + 1
        if w >= 0:
            np.minimum(now[1:], np.where(want == w, rows[j - 1, :-1], m + 1), out=now[1:])
        now[0] = 0
        rows[j] = np.minimum.accumulate(now - place) + place
    end = j = int(np.argmin(rows[:, m]))
    i, missing, added = m, [], []
    while i:
        if j and want[i - 1] == own[j - 1] and rows[j - 1, i - 1] == rows[j, i]:
            i, j = i - 1, j - 1
        elif rows[j, i - 1] + 1 == rows[j, i]:
            i -= 1
            missing.append(i)
        else:
            j -= 1
            added.append(j)
    return int(rows[end, m]), missing[::-1], added[::-1], j, end


class Scanner:
    """Ranks and confirms blocks; one lives as long as its task."""

    def __init__(self, templates: dict[str, str]):
        self.words = {k: words(t) for k, t in templates.items()}
        self.alone = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
        self.given = {k: zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(self._plain(w), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, w in self.words.items()}
        self.seen: dict[str, list[tuple]] = {}
        self.cues = Cues(templates)

    @staticmethod
    def _plain(some: list[str]) -> bytes:
        return " ".join(some).encode()

    def judge(self, block: str) -> list[tuple]:
        """(template, rank, spared, confirmed, missing, added, first, last) of each confirmed stretch, then of the other templates that spare bytes."""
        if (known := self.seen.get(block)) is not None:
            return known
        at = [(m.start(), m.end(), m.group().lower()) for m in _WORDS.finditer(block)]
        own: list[str | None] = [w for _, _, w in at]
        first, out, known = self.spared(own), [], {}
        spared = first
        explained = lambda k: len(self.words[k]) - len(known[k][0]) - len(known[k][1])
        while True:
            # candidates by what they spare of the words that are left; the first that fits wins
            ranked = sorted((k for k, b in spared.items() if b > 0), key=lambda k: (-spared[k], k))
            for k in ranked:
                if k not in known:
                    known[k] = self.closest(k, own)
            winner = next((k for k in ranked if known[k]), None)
            if winner is None:
                break
            # of the candidates that fit the winner's stretch, the one that explains most of it
            lo, hi = known[winner][2:]
            winner = max((k for k in ranked if known[k] and known[k][2] < hi and known[k][3] > lo), key=lambda k: (explained(k), -ranked.index(k)))
            missing, added, lo, hi = known[winner]
            out.append((winner, len(out) + 1, spared[winner] / max(1, len(self._plain(self.words[winner]))), True, missing, added, at[lo][0], at[hi - 1][1]))
            own[lo:hi] = [None] * (hi - lo)
            known = {k: x for k, x in known.items() if x is None or x[3] <= lo or x[2] >= hi}
            spared = self.spared(own)
        had, there = {x[0] for x in out}, Counter(w for _, _, w in at)
        for k in sorted((k for k in self.words if k not in had and first[k] > 0), key=lambda k: (-first[k], k)):
            out.append((k, len(out) + 1, first[k] / max(1, len(self._plain(self.words[k]))), False, list((Counter(self.words[k]) - there).elements()), [], 0, len(block)))
        if len(self.seen) >= KEPT:
            self.seen.clear()
        self.seen[block] = out
        return out

    def spared(self, own: list[str | None]) -> dict[str, int]:
        """Bytes by which each template as a dictionary makes the block's remaining words smaller."""
        raw = self._plain([w for w in own if w is not None])
        size = len(self.alone.compress(raw))
        return {k: size - len(c.compress(raw)) for k, c in self.given.items()}

    def closest(self, template: str, own: list[str | None]) -> tuple[list[str], list[str], int, int] | None:
        """The template's words that a stretch of own lacks, the stretch's words that the template lacks, and the stretch: the first of those
        with the fewest of both over all stretches, or None where even they are too many.

        Such a stretch has most of the template's words within few more words than it has: only places like that are aligned.
        """
        want = self.words[template]
        most = int(MOST_DIFFERENT * len(want))
        width, some = len(want) + most, set(want)
        has = np.fromiter((w in some for w in own), bool, len(own))
        upto = np.concatenate([[0], np.cumsum(has)])
        enough = np.flatnonzero(upto[np.minimum(np.arange(len(own)) + width, len(own))] - upto[:-1] >= max(1, len(want) - most))
        if not len(enough):
            return None
        found, code = None, {w: i for i, w in enumerate(dict.fromkeys(want))}
        ids = np.array([code[w] for w in want])
        begins = enough[np.concatenate([[True], np.diff(enough) > width])]
        ends = np.minimum(enough[np.concatenate([np.diff(enough) > width, [True]])] + width, len(own))
        for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True):
            new = align(ids, np.array([code.get(w, -1) for w in own[lo:hi]]))
            if new[0] <= most and (found is None or new[0] < found[0]):
                found = (new[0], [want[i] for i in new[1]], [own[lo + j] or "" for j in new[2]], lo + new[3], lo + new[4])
        return found and found[1:]

    def hits(self, text: str) -> list[tuple]:
        """(template, rank, spared, confirmed, missing, added, first, length) of a text's blocks, without what overlapping blocks repeat."""
        every = [(*hit[:6], lo + hit[6], lo + hit[7]) for lo, hi in spans(text, self.cues) for hit in self.judge(text[lo:hi])]
        kept, taken = [], []
        explained = lambda x: len(self.words[x[0]]) - len(x[4]) - len(x[5])
        for x in sorted((x for x in every if x[3]), key=lambda x: (-explained(x), x[6], x[0])):
            i = bisect.bisect(taken, x[6:])
            if (i == 0 or taken[i - 1][1] <= x[6]) and (i == len(taken) or taken[i][0] >= x[7]):
                taken.insert(i, x[6:])
                kept.append(x)
        rows = sorted(kept + [x for x in every if not x[3]], key=lambda x: (x[6], x[1]))
        return [(*x[:7], x[7] - x[6]) for x in rows]


def _scan(batches: Iterator[pa.RecordBatch], templates: dict[str, str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates)
    for batch in batches:
        rows, found = [], []
        for row, text in enumerate(batch.column(batch.num_columns - 1)):
            text = text.as_py()
            for hit in scanner.hits(text) if text else ():
                rows.append(row)
                found.append(hit)
        take = pa.array(rows, pa.int64())
        columns = [pa.array([f[k] for f in found], field.type) for k, field in enumerate(schema)]
        yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[:-1]), *columns], names=[*batch.schema.names[:-1], *schema.names])


def scan(docs: DataFrame, keep: list[str], text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """templates: further ones, of whole license texts too, come from sections(). Returns keep, then template, rank, spared, confirmed, missing, added, first, length for each confirmed stretch (characters first, length), and for each block's other templates."""
    made = [c.split()[0] for c in _TYPE.split(", ")]
    listed = pa.list_(pa.string())
    arrow = pa.schema([("template", pa.string()), ("rank", pa.int32()), ("spared", pa.float64()), ("confirmed", pa.bool_()), ("missing", listed), ("added", listed), ("first", pa.int64()), ("length", pa.int64())])
    found = read_texts(docs, keep, text, lambda batches: _scan(batches, templates, arrow), _TYPE)
    return found.select(*unpacked(keep, made), *made)
