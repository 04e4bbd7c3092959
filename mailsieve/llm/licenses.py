"""License scans by token automata compiled from template markup.

A template is text with two kinds of marked regions:
  <<opt>> ... <<end>>     may be left out as a whole; regions nest
  <<var name max>>        stands for 0 to max words of any wording
All else is mandatory wording. Texts and templates are compared as words: lower-cased A-Z, runs of letters, digits and
non-ASCII characters, so layout and punctuation don't matter. compiled() makes a template an automaton over words; a text
has the license where the automaton runs from a start to its last state, that is where the mandatory wording is matched
exactly. Runs begin only where the template's longest fixed wording stands, found by a byte search. Short licenses are templates
as a whole; of the long ones (Apache, GPL, MPL, Creative Commons) their notices are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .storage import bounded_arrow

#: Phrase -> label, fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label -> whole license texts, fixed wording of the public licenses; copyright lines are no part of them. A text with a
#: clause more, or a condition changed, isn't accepted.
_NO_WARRANTY = "THIS SOFTWARE IS PROVIDED BY <<var holder 24>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var holder 24>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<opt>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<opt>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "<<opt>>3.<<end>> <<opt>>4.<<end>> Neither the name of <<var holder 24>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_ADVERTISING = "<<opt>>3.<<end>> All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by <<var holder 24>>."
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_MIT_END = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var holder 16>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND <<var holder 12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var holder 12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
LICENSES = {
    "mit": f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice <<opt>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software. {_MIT_END}",
    "mit-0": f"{_MIT_GRANT}. {_MIT_END}",
    "bsd-2-clause": f"{_BSD} {_NO_WARRANTY}",
    "bsd-3-clause": f"{_BSD} {_BSD_NAMES} {_NO_WARRANTY}",
    "bsd-4-clause": f"{_BSD} {_BSD_ADVERTISING} {_BSD_NAMES} {_NO_WARRANTY}",
    "isc": f"Permission to use, copy, modify, <<opt>>and<<end>> <<opt>>or<<end>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}",
    "0bsd": f"Permission to use, copy, modify, <<opt>>and<<end>> <<opt>>or<<end>> distribute this software for any purpose with or without fee is hereby granted. {_ISC_END}",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will <<var holder 12>> be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<opt>>1.<<end>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<opt>>2.<<end>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<opt>>3.<<end>> This notice may not be removed or altered from any source distribution.",
    "unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. <<opt>>For more information, please refer to <<var link 8>><<end>>',
    "bsl-1.0": 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}
#: Label -> notices by which works say that they are under a license, whole wording of the notice.
_GPL = "<<opt>>it under<<end>> the terms of the GNU <<KIND>> General Public License as published by the Free Software Foundation<<opt>>,<<end>> <<opt>>either<<end>> version"
NOTICES = {
    "mit": ["<<opt>>released<<end>> <<opt>>licensed<<end>> under the MIT license"],
    "apache-2.0": ["licensed under the Apache License, <<opt>>Version<<end>> 2.0", 'Licensed under the Apache License, Version 2.0 <<opt>>(the "License")<<end>>; you may not use <<var file 6>> except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "gpl-2.0": ["<<opt>>this work is<<end>> licensed under the <<opt>>GNU<<end>> General Public License, <<opt>>GPL<<end>> <<opt>>version<<end>> 2", _GPL.replace("<<KIND>> ", "") + " 2"],
    "gpl-3.0": ["<<opt>>this work is<<end>> licensed under the <<opt>>GNU<<end>> General Public License, <<opt>>GPL<<end>> <<opt>>version<<end>> 3", _GPL.replace("<<KIND>> ", "") + " 3"],
    "lgpl": ["under the <<opt>>terms of the<<end>> GNU Lesser General Public License"],
    "agpl": ["under the <<opt>>terms of the<<end>> GNU Affero General Public License"],
    "cc-by-4.0": ["licensed under <<opt>>a<<end>> <<opt>>the<<end>> <<opt>>Creative Commons<<end>> <<opt>>CC<<end>> <<opt>>Attribution<<end>> BY 4.0", "licensed under <<opt>>a<<end>> <<opt>>the<<end>> Creative Commons Attribution 4.0 <<opt>>International<<end>> License"],
    "cc-by-sa-4.0": ["licensed under <<opt>>a<<end>> <<opt>>the<<end>> CC BY-SA 4.0", "licensed under <<opt>>a<<end>> <<opt>>the<<end>> Creative Commons Attribution-ShareAlike 4.0 <<opt>>International<<end>> License"],
    "cc-by-nc-4.0": ["licensed under <<opt>>a<<end>> <<opt>>the<<end>> CC BY-NC 4.0", "licensed under <<opt>>a<<end>> <<opt>>the<<end>> Creative Commons Attribution-NonCommercial 4.0 <<opt>>International<<end>> License"],
    "cc0-1.0": ["CC0 1.0 <<opt>>Universal<<end>>"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, <<opt>>v.<<end>> <<opt>>version<<end>> 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<opt>>http<<end>> <<opt>>https<<end>> mozilla.org/MPL/2.0/"],
}
TEMPLATES = {label: [*([LICENSES[label]] if label in LICENSES else []), *NOTICES.get(label, [])] for label in [*LICENSES, *(x for x in NOTICES if x not in LICENSES)]}


class Automaton(NamedTuple):
    label: str
    steps: dict[int, dict[bytes, int]]  # state -> word -> state
    loops: dict[int, int]  # state -> state that any word leads to
    free: dict[int, tuple[int, ...]]  # state -> states reached without a word
    last: int
    fixed: bytes  # longest mandatory run, as " words "
    ahead: int  # most words that can stand before it


def tokens(text: str) -> list[bytes]:
    return text.encode().translate(bytes(vec.ALNUM.tolist()).replace(b"\0", b" ")).split()


@lru_cache(maxsize=None)
def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template. Optional regions become free steps past them, replaceable ones chains of any-word steps that may each be left."""
    steps, loops, free, state, opened = {}, {}, {}, 0, []
    runs, run, ahead = [], [], 0
    for k, piece in enumerate(template.replace(">>", "<<").split("<<")):
        if k % 2:
            run and runs.append((len(run), run, ahead - len(run)))
            run = []
            kind, *more = piece.split()
            if kind == "opt":
                opened.append(state)
            elif kind == "end":
                free.setdefault(opened.pop(), []).append(state)
            elif kind == "var":
                begin = state
                for _ in range(int(more[1])):
                    loops[state] = state + 1
                    state += 1
                    free.setdefault(state - 1, [])
                end = state + 1
                for s in range(begin, state + 1):
                    free.setdefault(s, []).append(end)
                state = end
                ahead += int(more[1])
            else:
                raise ValueError(f"unknown mark <<{piece}>>")
        else:
            for word in tokens(piece):
                steps.setdefault(state, {})[word] = state + 1
                state, ahead = state + 1, ahead + 1
                if not opened:
                    run.append(word)
    if opened:
        raise ValueError(f"an optional region isn't closed: {template}")
    run and runs.append((len(run), run, ahead - len(run)))
    if not runs:
        raise ValueError(f"no mandatory wording: {template}")
    _, words, before = max(runs, key=lambda r: r[0])
    return Automaton(label, steps, loops, {s: tuple(x) for s, x in free.items()}, state, b" " + b" ".join(words) + b" ", before)


def closure(a: Automaton, states: set[int]) -> set[int]:
    out, todo = set(states), list(states)
    while todo:
        for s in a.free.get(todo.pop(), ()):
            if s not in out:
                out.add(s)
                todo.append(s)
    return out


def match_at(a: Automaton, words: list[bytes], start: int) -> int:
    """The end of the longest run of a from start, or -1."""
    states, end, at = closure(a, {0}), -1, start
    while True:
        if a.last in states:
            end = at
        if at >= len(words):
            return end
        word, after = words[at], set()
        for s in states:
            if (to := a.steps.get(s, {}).get(word)) is not None:
                after.add(to)
            if (to := a.loops.get(s)) is not None:
                after.add(to)
        if not after:
            return end
        states, at = closure(a, after), at + 1


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word indexes at which " phrase " stands in " w w w "; places may overlap in the space between."""
    out, at, seen, word = [], joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", seen, at)
        out.append(word)
        seen, at = at, joined.find(phrase, at + 1)
    return out


def scan(text: bytes | None, phrases: dict[str, str] = PHRASES, templates: dict = TEMPLATES) -> dict:
    """The figures and matches of one text; see license_scan()."""
    words = (text or b"").translate(TO_WORDS).split()
    joined = b" " + b" ".join(words) + b" "
    base, spans = [], []
    if any(x in joined for x in ANCHORS):
        for phrase, label in phrases.items():
            found = tokens(phrase)
            base += [(at, at + len(found), label) for at in places(joined, b" " + b" ".join(found) + b" ")]
        for label, texts in templates.items():
            for template in texts:
                a, done = compiled(label, template), -1
                for at in places(joined, a.fixed):
                    # the earliest start whose run reaches past the fixed wording
                    for start in range(max(done, at - a.ahead, 0), at + 1):
                        end = match_at(a, words, start)
                        if end > at:
                            spans.append((start, end, label))
                            done = end
                            break
    cover = np.zeros(len(words), dtype=bool)
    for a, b, _ in base + spans:
        cover[a:b] = True
    starts = [x[0] for x in base]
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted({x[2] for x in base})), "labels": ",".join(sorted({x[2] for x in base + spans})),
        "score": float(cover.mean()) if words else 0.0, "matches": [{"label": x[2], "first": x[0], "end": x[1]} for x in sorted(spans)],
    }


TO_WORDS = bytes(vec.ALNUM.tolist()).replace(b"\0", b" ")
#: Every phrase and template has one of these words.
ANCHORS = (b" license ", b" licensed ", b" permission ", b" redistribution ", b" unencumbered ", b" cc0 ", b" gnu ")
MATCH = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
OUT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", MATCH)])


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in vec.slices(whole, "text"):
            data, off = vec.buffer(batch.column(0))
            raw, bounds = data.tobytes(), off.tolist()
            found = pa.Table.from_pylist([scan(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], schema=OUT).combine_chunks()
            yield pa.RecordBatch.from_arrays([batch.column(1), *(c.combine_chunks() for c in found.columns)], names=["doc_id", *OUT.names])


def license_scan(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, n_words, n_base (places of PHRASES), first_word and last_word (their smallest and largest start), base_labels, labels (with those of accepted templates), score (share of the words that lie in a phrase or an accepted template), matches (label, first word, end).

    Null and empty texts have no words, no labels and score 0. Repeated rows are scanned alike. Of overlapping runs of one
    template the earliest and longest counts. An empty table gives no rows. Within a row, so no shuffle.
    """
    bounded_arrow(docs.sparkSession)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first:long,end:long>>"
    return docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long")).mapInArrow(_scanner, schema)
