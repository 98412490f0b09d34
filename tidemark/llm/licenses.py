"""License scans by template-markup matching.

Templates are written in the public license-list markup: ``<<beginOptional>>...<<endOptional>>`` may be missing, and
``<<var;name="...";original="...";match="...">>`` stands for words of one line that fit a pattern. A template is compiled
into a token automaton; its mandatory words must all match, in order and with nothing between them. Sets of states are
determinised as they are met. A document is scanned backward once, which gives for each place the states that still lead
to the end; the forward walk starts only where a match does, and stops where none goes on, so that time is in proportion
to the words, whatever a line holds. A document is sent to Python only if it contains a mandatory word of some template,
which the JVM tests first.

``TEMPLATES`` has the whole texts of MIT, ISC, BSD-2-Clause, BSD-3-Clause and Zlib, the standard notices of Apache-2.0,
MPL-2.0 and of the GNU licenses (GPL-2.0, GPL-3.0, LGPL-2.1, LGPL-3.0, AGPL-3.0; -only and -or-later alike), and short
mentions. ``load_templates`` reads others from files.

Tokens are runs of ASCII letters and digits, lower-cased, with inner dots kept in numbers ("2.0"); "licence" reads as
"license". A line end matches nothing but ends a replaceable region. A region's pattern is held against one token; one
that begins with a dot (``.+``, ``.*``, ``.{0,20}``) takes any words of a line, whatever its count. Defined results:

* matches of one template do not overlap: the leftmost comes first, as long as it can be, and search goes on behind it;
* null and empty texts have no match; texts are scanned whole, whatever their length; repeated rows are scanned each;
* ids are integers; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced

_OPT = "<<beginOptional>>{}<<endOptional>>"
_WHO = '<<var;name="holder";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".+">>'
_BULLET = '<<var;name="bullet";original="1.";match="[0-9a-z]{0,2}">>'
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;name="holder";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".+">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
_BSD_GRANT = f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: {_BULLET} Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. {_BULLET} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_THIRD = f"""{_BULLET} Neither the name of <<var;name="organization";original="the copyright holder";match=".+">> nor the names of its contributors
may be used to endorse or promote products derived from this software without specific prior written permission. """
_BSD_DISCLAIMER = f"""THIS SOFTWARE IS PROVIDED BY {_WHO} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
<<var;name="holder";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".+">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
<<var;name="holder";original="THE AUTHOR";match=".+">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="holder";original="THE AUTHOR";match=".+">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = f"""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: {_BULLET} The origin of this software must
not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
the product documentation would be appreciated but is not required. {_BULLET} Altered source versions must be plainly marked as such, and must
not be misrepresented as being the original software. {_BULLET} This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> www apache org licenses LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> mozilla org MPL 2.0"""


def _gnu(name: str, version: str) -> str:
    """The notice that the GNU licenses ask for, of this version alone or of later ones too."""
    later = _OPT.format("either") + f' version {version} of the License' + _OPT.format(", or (at your option) any later version")
    return (
        f'<<var;name="program";original="program";match="(program|library|software|file|work)">> is free software<<beginOptional>>: <<endOptional>> you can redistribute it and/or modify it '
        f"under the terms of the GNU {name} as published by the Free Software Foundation{_OPT.format(',')} {later}"
    )


def _named(name: str, version: str) -> str:
    """A short mention of a GNU license."""
    start = '<<beginOptional>>This <<var;name="what";original="work";match="(work|program|software|file|library)">> is<<endOptional>>'
    return f"{start} {_VERB} under the {_OPT.format('terms of the')} GNU {name}{_OPT.format(',')} version {version} {_OPT.format('or any later version')} {_OPT.format('or later')}"


_VERB = '<<var;name="verb";original="licensed";match="(released|licensed|distributed|available)">>'
_RELEASED = '<<var;name="verb";original="Released";match="(released|licensed|distributed|available)">>'

_THREE, _TWO = (f'<<var;name="v";original="{v}";match="{v}(.0)?">>' for v in (3, 2))
_CC = "<<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>>"

#: License id and template. Ids that end in -text are whole texts, in -notice standard notices; the others are short mentions.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License<<beginOptional>>,<<endOptional>> Version 2.0 <<beginOptional>>(the "License")<<endOptional>>',
    "Apache-2.0-notice": _APACHE,
    "MIT": f"{_RELEASED} under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "MIT-text": _MIT,
    "BSD": f'{_RELEASED} under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>><<var;name="n";original="3";match="[0234]">> clause<<endOptional>> <<beginOptional>>new<<endOptional>> BSD <<beginOptional>><<var;name="n";original="3";match="[0234]">> clause<<endOptional>> License',
    "BSD-2-Clause-text": _BSD_GRANT + _BSD_DISCLAIMER,
    "BSD-3-Clause-text": _BSD_GRANT + _BSD_THIRD + _BSD_DISCLAIMER,
    "ISC-text": _ISC,
    "Zlib-text": _ZLIB,
    "GPL-3.0": _named("General Public License", _THREE),
    "GPL-2.0": _named("General Public License", _TWO),
    "GPL-3.0-notice": _gnu("General Public License", _THREE),
    "GPL-2.0-notice": _gnu("General Public License", _TWO),
    "LGPL-2.1-notice": _gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0-notice": _gnu("Lesser General Public License", _THREE),
    "AGPL-3.0-notice": _gnu("Affero General Public License", _THREE),
    "CC-BY-NC-4.0": f"Licensed under {_CC} CC BY-NC 4.0 <<beginOptional>>International<<endOptional>>",
    "CC-BY-SA-4.0": f"Licensed under {_CC} CC BY-SA 4.0 <<beginOptional>>International<<endOptional>>",
    "CC-BY-4.0": f"Licensed under {_CC} CC BY 4.0 <<beginOptional>>International<<endOptional>>",
    "CC-BY-4.0-name": "Licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution 4.0 <<beginOptional>>International<<endOptional>>",
    "CC-BY-SA-4.0-name": "Licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution-ShareAlike 4.0 <<beginOptional>>International<<endOptional>>",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-notice": _MPL,
    "SPDX-tag": 'SPDX-License-Identifier: <<var;name="id";original="MIT";match=".+">>',
    "Reserved": '<<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;name="holder";original="2024";match=".+">><<endOptional>> All rights reserved',
}
TOKEN = r"[a-z0-9]+(?:[.][0-9]+)*|\n"
_TOKEN = re.compile(TOKEN)
_MARK = re.compile(r"<<(beginOptional|endOptional|var)(.*?)>>", re.S)


def tokens(text: str) -> list[str]:
    return ["license" if t == "licence" else t for t in _TOKEN.findall(text.lower())]


# ---- templates -----------------------------------------------------------------------------------------------------


def parse(template: str) -> list:
    """Nested parts: a str is a mandatory token, ("var", pattern) a replaceable region, ("opt", parts) an optional one."""
    stack: list[list] = [[]]
    at = 0
    for mark in _MARK.finditer(template):
        stack[-1] += [t for t in tokens(template[at : mark.start()]) if t != "\n"]
        at = mark.end()
        if mark[1] == "beginOptional":
            stack.append([])
        elif mark[1] == "endOptional":
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            part = stack.pop()
            if part:
                stack[-1].append(("opt", part))
        else:
            match = re.search(r'match="(.*?)"', mark[2])
            stack[-1].append(("var", match[1] if match else ".+"))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0] + [t for t in tokens(template[at:]) if t != "\n"]


def _wild(pattern: str) -> bool:
    return bool(re.fullmatch(r"[.]([+*]|[{][0-9]*,?[0-9]*[}])", pattern))


class Automaton:
    """States are numbered; an edge takes a token that equals a word or fits a pattern. Sets of states are memoised."""

    def __init__(self, parts: list) -> None:
        self.edges: list[list[tuple[object, int]]] = [[]]
        self.free: list[list[int]] = [[]]  # moves without a token
        self.wild: set[int] = set()  # states within a replaceable region, which a line end leaves
        self.end = self._add(parts, 0)
        self.start = self._closed({0})
        self.over = self._leading({self.end})  # states from which the end needs no more words
        self.memo: dict[tuple[frozenset, str], frozenset] = {}
        self.back: dict[tuple[frozenset, str], frozenset] = {}

    def _state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _add(self, parts: list, state: int) -> int:
        for part in parts:
            if isinstance(part, str):
                to = self._state()
                self.edges[state].append((part, to))
            elif part[0] == "opt":
                to = self._state()
                self.free[self._add(part[1], state)].append(to)
                self.free[state].append(to)
            else:
                inside, to = self._state(), self._state()
                pattern = part[1]
                if _wild(pattern):  # any words of a line
                    self.edges[state].append((None, inside))
                    self.edges[inside].append((None, inside))
                    self.wild.add(inside)
                    self.free[inside].append(to)
                else:
                    self.edges[state].append((re.compile(pattern), to))
                if re.fullmatch(pattern, ""):
                    self.free[state].append(to)
            state = to
        return state

    def _closed(self, states: set[int]) -> frozenset:
        todo = list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return frozenset(states)

    def _leading(self, states: set[int]) -> frozenset:
        """The states from which some of ``states`` are reached without a token."""
        states = set(states)
        while more := {s for s in range(len(self.free)) if s not in states and states & set(self.free[s])}:
            states |= more
        return frozenset(states)

    def _takes(self, word, token: str) -> bool:
        return word is None or (word == token if isinstance(word, str) else bool(word.fullmatch(token)))

    def step(self, states: frozenset, token: str) -> frozenset:
        """The states after one more token."""
        key = (states, token)
        if key not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            if token == "\n":
                self.memo[key] = states - self.wild
            else:
                self.memo[key] = self._closed({to for s in states for word, to in self.edges[s] if self._takes(word, token)})
        return self.memo[key]

    def step_back(self, states: frozenset, token: str) -> frozenset:
        """The states before a token from which what follows it leads to the end, or that are at the end already."""
        key = (states, token)
        if key not in self.back:
            if len(self.back) > 100_000:
                self.back.clear()
            if token == "\n":
                self.back[key] = self._leading(states - self.wild) | self.over
            else:
                self.back[key] = self._leading({s for s in range(len(self.edges)) for word, to in self.edges[s] if to in states and self._takes(word, token)}) | self.over
        return self.back[key]

    def find(self, words: list[str]) -> list[tuple[int, int]]:
        """Places [start, end) of the leftmost longest matches."""
        # leads[k]: the states from which words[k:] lead to the end.
        leads, now = [self.over] * (len(words) + 1), self.over
        for k in range(len(words) - 1, -1, -1):
            leads[k] = now = self.step_back(now, words[k])
        out, at = [], 0
        while at < len(words):
            last = 0
            if words[at] != "\n" and leads[at] is not self.over and self.start & leads[at]:
                states, k = self.start & leads[at], at
                while k < len(words):
                    states = self.step(states, words[k]) & leads[k + 1]
                    if not states:
                        break
                    k += 1
                    if states & self.over and words[k - 1] != "\n":
                        last = k
                    if states <= self.over and not any(self.edges[s] for s in states):
                        break
            if last > at:
                out.append((at, last))
            at = max(last, at + 1)
        return out


def anchors(parts: list) -> tuple[str, ...]:
    """The one or two longest mandatory words, all of which a document must contain to be looked at."""
    words = sorted({"licen" if p == "license" else p for p in parts if isinstance(p, str)}, key=lambda w: (-len(w), w))
    if not words:
        raise ValueError("a template needs a mandatory word")
    return tuple(words[:2])


# ---- the scan ------------------------------------------------------------------------------------------------------

FOUND = "doc_id bigint, license string, matches bigint, first_token bigint"


def _scan(templates: dict[str, str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {name: (anchors(parts), Automaton(parts)) for name, parts in ((n, parse(t)) for n, t in templates.items())}
        for batch in sliced(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words, lower = None, text.lower()
                for name, (must, automaton) in automata.items():
                    if all(word in lower for word in must):
                        words = words if words is not None else tokens(text)
                        if places := automaton.find(words):
                            rows.append((doc, name, len(places), places[0][0] - words[: places[0][0]].count("\n")))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "license", "matches", "first_token"])

    return task


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each document and license found in it: how often, and before how many tokens the first match begins."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    maybe = F.lit(False)
    for must in sorted({anchors(parse(t)) for t in templates.values()}):
        maybe = maybe | reduce(Column.__and__, (F.contains(F.lower("text"), F.lit(word)) for word in must))
    return rows.where(maybe).mapInArrow(_scan(templates), FOUND)


def load_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Templates from files of markup, named by the files without ``.template.txt`` or the like; a list of licenses is small."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    return {r["name"].split(".template")[0].removesuffix(".txt"): r["value"] for r in rows.orderBy("name").collect()}


def _regex(parts: list) -> str:
    """The template as a pattern over tokens, each followed by one space."""
    out = ""
    for part in parts:
        if isinstance(part, str):
            out += re.escape(part).replace("\\-", "-") + r" (?:\n )*"
        elif part[0] == "opt":
            out += f"(?:{_regex(part[1])})?"
        elif _wild(part[1]):
            out += r"(?:[a-z0-9.]+ )" + ("*" if re.fullmatch(part[1], "") else "+") + r"(?:\n )*"
        else:
            out += f"(?:(?:{part[1]}) (?:\\n )*)" + ("?" if re.fullmatch(part[1], "") else "")
    return out


def oracle() -> str:
    """The same templates as regular expressions over the text's tokens."""
    rows = " UNION ALL ".join(
        "SELECT doc_id, '{0}' AS license, cast(len(regexp_extract_all(t, '{1}')) AS bigint) AS matches, "
        "cast(len(string_split(replace(' ' || substring(t, 1, instr(t, regexp_extract(t, '{1}')) - 1), ' \n ', ' '), ' ')) - 2 AS bigint) AS first_token FROM n".format(name, r"\b" + _regex(parse(t)))
        for name, t in TEMPLATES.items()
    )
    return (
        f"WITH n AS (SELECT doc_id, replace(array_to_string(regexp_extract_all(lower(text), '{TOKEN}'), ' ') || ' ', 'licence', 'license') AS t FROM documents WHERE text IS NOT NULL) "
        f"SELECT * FROM ({rows}) WHERE matches > 0"
    )
