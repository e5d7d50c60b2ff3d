"""License scans by template mark-up.

A template is license wording in which ``[[...]]`` marks optional words and
``{{n}}`` a replaceable region of one to n words of any kind. Each template is
compiled to an automaton over words. It is started wherever its first two words
stand, and accepts if all mandatory wording follows exactly; of several ends the
last counts. Plain phrases are found besides, at all of their places.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` with A-Z lower-cased;
templates and phrases are read by the same rule. Texts are scanned where they
lie, in slices of bounded size, and nothing is shuffled.

Defined results: a null or wordless text has no places and no labels; a very long
text is scanned whole, in some forty bytes for each of its bytes; of passages that
several templates accept at one place each counts, and labels are listed once, in
order; repeated documents are rows of their own; an empty table gives no rows; other
columns are not looked at, and have numbers for names meanwhile, so none can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textcore as X

#: Phrases with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def _creative_commons(label: str, kind: str) -> list[tuple[str, str]]:
    """The notice without a version, and with each version, followed by its port."""
    notice = f"licensed under [[a]] [[the]] Creative Commons {kind}"
    return [(label, f"{notice} [[International]] License"), *((label, f"{notice} {v} [[{{{{2}}}}]] License") for v in ("1.0", "2.0", "2.1", "2.5", "3.0", "4.0"))]


def _gpl(label: str, version: str, kind: str = "") -> list[tuple[str, str]]:
    """The notice of one line, and the standard header after the program's name."""
    return [
        (label, f"licensed under the [[terms of the]] GNU {kind}General Public License [[(GPL)]] [[,]] version {version}"),
        (
            label,
            f"""is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as
            published by the Free Software Foundation, [[either]] version {version} of the License [[, or (at your option) any
            later version]]. {{{{6}}}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
            the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for
            more details.""",
        ),
        (
            label,
            f"""is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License
            version {version} as published by the Free Software Foundation. {{{{6}}}} is distributed in the hope that it will be
            useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
            PURPOSE. See the GNU {kind}General Public License for more details.""",
        ),
    ]


#: The BSD licenses, with a place for a third clause.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
    the following conditions are met: [[1.]] [[a)]] Redistributions of source code must retain the above copyright
    notice, this list of conditions and the following disclaimer. [[2.]] [[b)]] Redistributions in binary form must
    reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution. {third} THIS SOFTWARE IS PROVIDED BY {{{{12}}}} "AS IS" AND ANY
    EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
    A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{{{12}}}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
    SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
    WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
    OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


#: Labels with templates, public license texts and notices as fixed values. Each begins with two mandatory words. License texts and headers have all of their mandatory
#: wording; notices of one line are whole statements by themselves.
TEMPLATES = [
    ("mit", "released under the [[terms of the]] MIT License"),
    ("mit", "licensed under the [[terms of the]] MIT License"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
        OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("apache-2", 'licensed under the Apache License, Version 2.0 [[(the "License")]]'),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use {{4}} except in compliance with the
        License. You may obtain a copy of the License at [[http://www.apache.org/licenses/LICENSE-2.0]]
        [[https://www.apache.org/licenses/LICENSE-2.0]] Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("cc-by-nc", "licensed under [[a]] [[the]] [[Creative Commons]] CC BY-NC [[{{2}} International]]"),
    *_creative_commons("cc-by-nc", "Attribution-NonCommercial"),
    *_creative_commons("cc-by", "Attribution"),
    *_gpl("gpl-3", "3"),
    *_gpl("gpl-2", "2"),
    (
        "isc",
        """Permission to use, copy, modify, and [[/or]] distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND {{12}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    ),
    ("bsd-2-clause", _BSD.format(third="")),
    (
        "bsd-3-clause",
        _BSD.format(
            third="""[[3.]] [[c)]] Neither the name of {{12}} nor the names of {{4}} may be used to endorse or promote products derived
            from this software without specific prior written permission."""
        ),
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: [[1.]] The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. [[2.]] Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. [[3.]] This notice may not be removed or altered from any source
        distribution.""",
    ),
    (
        "bsl-1",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
        Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire
        statement, including the above license grant, this restriction and the following disclaimer, must be included in all
        copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative
        works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE
        IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS
        OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "0bsd",
        """Permission to use, copy, modify, and [[/or]] distribute this software for any purpose with or without fee is hereby
        granted. THE SOFTWARE IS PROVIDED "AS IS" AND {{12}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.""",
    ),
    (
        "mpl-2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at [[http://mozilla.org/MPL/2.0/]] [[https://mozilla.org/MPL/2.0/]]""",
    ),
    *_gpl("lgpl-3", "3", "Lesser "),
    *_gpl("lgpl-2.1", "2.1", "Lesser "),
    *_gpl("agpl-3", "3", "Affero "),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author
        or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
        this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend
        this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
        under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL {{12}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
]

SCANNED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
        T.StructField("matches", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.list_(pa.string())),
        ("labels", pa.list_(pa.string())),
        ("score", pa.float64()),
        ("matches", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))),
    ]
)


def tokens(text: str) -> list[bytes]:
    """A wording's words."""
    raw = text.encode()
    data = np.zeros(len(raw) + 8, np.uint8)
    data[:-8] = np.frombuffer(raw, np.uint8)
    return X.strings(X.words(X.Texts(data, np.array([0, len(raw)])), X.LOWER_WORDS, lower=True))


@dataclass
class Automaton:
    """States are numbers from 0; ``last`` accepts. A step on a word goes along ``by_word`` or ``by_any``; ``free`` costs no word."""

    by_word: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    by_any: list[set[int]] = field(default_factory=lambda: [set()])
    free: list[set[int]] = field(default_factory=lambda: [set()])

    @property
    def last(self) -> int:
        return len(self.free) - 1

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append(set())
        self.free.append(set())
        return self.last

    def _wording(self, text: str) -> None:
        for word in tokens(text):
            at = self.last
            self.by_word[at][word] = self._state()

    @classmethod
    def of(cls, template: str) -> Automaton:
        out = cls()
        out._region(template)
        return out

    def _region(self, template: str) -> None:
        for text, optional, most in re.findall(r"((?:(?!\[\[|\{\{).)+)|\[\[(.*?)\]\]|\{\{(\d+)\}\}", template, re.S):
            if text:
                self._wording(text)
            elif optional:
                # an own state before and after, so that skipping joins no other region's edges
                before = self.last
                start = self._state()
                self.free[before].add(start)
                self._region(optional)
                after = self._state()
                self.free[after - 1].add(after)
                self.free[start].add(after)
            else:
                states = [self.last, *(self._state() for _ in range(int(most)))]
                for a, b in zip(states, states[1:], strict=False):
                    self.by_any[a].add(b)
                for a in states[1:-1]:
                    self.free[a].add(states[-1])

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return out

    def accepts(self, words: Iterator[bytes]) -> int | None:
        """Words of the longest beginning of ``words`` that is accepted, or None."""
        now, best, n = self._closed({0}), None, 0
        if self.last in now:
            best = 0
        for word in words:
            after = {self.by_word[s][word] for s in now if word in self.by_word[s]}
            now = self._closed(after.union(*(self.by_any[s] for s in now)))
            n += 1
            if not now:
                break
            if self.last in now:
                best = n
        return best

    def opening(self) -> list[bytes]:
        """The first two mandatory words."""
        out, at = [], 0
        while len(out) < 2 and len(self.by_word[at]) == 1 and not self.free[at] and not self.by_any[at]:
            ((word, at),) = self.by_word[at].items()
            out.append(word)
        return out


class Scanner:
    """Phrases and compiled templates."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.phrases = [(self._words(tokens(p)), label) for p, label in phrases.items()]
        self.automata = []
        for label, template in templates:
            automaton = Automaton.of(template)
            opening = automaton.opening()
            if len(opening) < 2:
                raise ValueError(f"a template must begin with two mandatory words: {template[:60]!r}")
            self.automata.append((automaton, self._words(opening), label))

    @staticmethod
    def _words(found: list[bytes]) -> X.Words:
        data = np.zeros(sum(map(len, found)) + 8, np.uint8)
        data[:-8] = np.frombuffer(b"".join(found), np.uint8)
        ends = np.cumsum([len(x) for x in found])
        return X.Words(data, ends - [len(x) for x in found], ends, np.array([0, len(found)]))

    def scan(self, texts: X.Texts) -> list[dict]:
        w = X.words(texts, X.LOWER_WORDS, lower=True)
        h, owner, n_texts = X.hashes(w), w.owners(), len(texts)
        base: list[list] = [[] for _ in range(n_texts)]
        full: list[list] = [[] for _ in range(n_texts)]
        for phrase, label in self.phrases:
            for at in places(w, h, owner, phrase).tolist():
                base[owner[at]].append((at - int(w.first[owner[at]]), label))
        for automaton, opening, label in self.automata:
            for at in places(w, h, owner, opening).tolist():
                i = owner[at]
                own = (w.data[w.start[j] : w.end[j]].tobytes() for j in range(at, int(w.first[i + 1])))
                if (n := automaton.accepts(own)) is not None:
                    first = at - int(w.first[i])
                    full[i].append((first, first + n, label))
        out = []
        for i, n in enumerate(w.counts.tolist()):
            starts, plain = [s for s, _ in base[i]], {x for _, x in base[i]}
            out.append(
                {
                    "n_words": n,
                    "n_base": len(starts),
                    "first_word": min(starts, default=None),
                    "last_word": max(starts, default=None),
                    "base_labels": sorted(plain),
                    "labels": sorted(plain | {x for _, _, x in full[i]}),
                    "score": 1.0 if full[i] else 0.5 if starts else 0.0,
                    "matches": [{"label": x, "first": a, "end": b} for a, b, x in sorted(full[i])],
                }
            )
        return out


def places(w: X.Words, h: np.ndarray, owner: np.ndarray, phrase: X.Words) -> np.ndarray:
    """Where all words of a phrase follow one another in one text."""
    n = len(phrase.start)
    if len(h) < n:
        return np.zeros(0, np.int64)
    q = X.hashes(phrase)
    at = np.flatnonzero(h[: len(h) - n + 1] == q[0])
    for k in range(1, n):
        at = at[h[at + k] == q[k]]
    at = at[owner[at] == owner[at + n - 1]]
    good = [X.same_words(w, a + np.arange(n), phrase, np.arange(n)) for a in at]
    return at[np.array(good, bool)]


def scanned(docs: DataFrame, text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """All rows and columns of ``docs`` and at the end the struct SCANNED.

    ``score`` is 1 if a template is accepted, a half if there are only phrases, else 0. ``matches`` has the label, first
    word and end of each accepted passage.
    """
    names = docs.columns
    fields = [T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            out = [x for _, _, texts in X.slices(batch.column(at)) for x in scanner.scan(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _ARROW)], names=[f"c{i}" for i in range(batch.num_columns + 1)])

    return docs.toDF(*[f.name for f in fields]).mapInArrow(X.lean(run), T.StructType([*fields, T.StructField(f"c{len(fields)}", SCANNED)]))
