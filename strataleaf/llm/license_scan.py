"""License scans by matching template markup.

Templates use the markup of public license lists: <<beginOptional>> ... <<endOptional>> around
wording that may be left out, <<var;name="...";original="...";match="...">> where wording may be
replaced; `match` is .{n,m}, a number of words, or .{n,}, .+ or .*, any number from n, 1 or 0 on. A template is compiled into an automaton
over tokens: mandatory tokens in order, optional regions as jumps, replaceable regions as so many
tokens of any kind, those without end as a state that stays. A text is accepted if some run of its tokens leads from start to end, so all
mandatory wording must be there, exactly and in order. As list guidelines have it, case, white
space and punctuation don't count, and spelling variants (licence, license) are one.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from strataleaf.llm.common import in_small_batches

_COPYRIGHT = '<<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;name="holder";original="<year> <holder>";match=".{0,20}">> <<beginOptional>>All rights reserved<<endOptional>><<endOptional>>'
_AS_IS = 'IS PROVIDED <<var;name="by";original="";match=".{0,12}">> "AS IS"'
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_DISCLAIMER = f"""THIS SOFTWARE {_AS_IS}<<beginOptional>> AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="liable";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".{{1,12}}">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE<<endOptional>>"""

TEMPLATES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0<<beginOptional>> (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at <<var;name="url";original="http://www.apache.org/licenses/LICENSE-2.0";match=".{1,12}">>
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.<<endOptional>>""",
    "MIT": f"""<<beginOptional>><<beginOptional>>The<<endOptional>> MIT License <<beginOptional>>(MIT)<<endOptional>><<endOptional>> {_COPYRIGHT}
        Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="what";original="this software and associated documentation files";match=".{{1,8}}">> (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE {_AS_IS}, WITHOUT WARRANTY OF ANY KIND<<beginOptional>>, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL <<var;name="liable";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".{{1,12}}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE<<endOptional>>""",
    "MIT-notice": 'Released under the <<beginOptional>>terms of the<<endOptional>> MIT License',
    "GPL-3.0": """This <<var;name="work";original="program";match=".{1,4}">> is <<beginOptional>>free software:<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>>
        GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either<<endOptional>> version 3<<beginOptional>> of the License<<endOptional>><<beginOptional>>, or (at your option) any later version<<endOptional>>""",
    "GPL-3.0-notice": """<<beginOptional>>This <<var;name="work";original="program";match=".{1,4}">> is<<endOptional>> free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the
        GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either<<endOptional>> version 3 <<beginOptional>>of the License<<endOptional>>
        <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>, or (at your option) any later version<<endOptional>>
        <<beginOptional>><<var;name="work";original="This program";match=".{1,4}">> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details.<<endOptional>> <<beginOptional>>You should have received a copy of the GNU General Public License along with <<var;name="work";original="this program";match=".{1,4}">>.
        If not, see <<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>>://<<beginOptional>>www.<<endOptional>>gnu.org/licenses/<<endOptional>>""",
    "CC-BY-NC-4.0": 'Licensed under <<beginOptional>>a Creative Commons Attribution NonCommercial 4.0 International License,<<endOptional>> CC BY-NC 4.0',
    "CC-BY-NC-4.0-notice": """<<beginOptional>>This <<var;name="work";original="work";match=".{1,4}">> is<<endOptional>> licensed under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>>
        Creative Commons Attribution-NonCommercial 4.0 International <<beginOptional>>Public<<endOptional>> License<<beginOptional>>. To view a copy of this license, visit <<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>>://creativecommons.org/licenses/by-nc/4.0/
        <<beginOptional>>or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA<<endOptional>><<endOptional>>""",
    "BSD-2-Clause": f"""<<beginOptional>><<beginOptional>>The<<endOptional>> BSD 2-Clause License<<endOptional>> {_COPYRIGHT} {_BSD_CONDITIONS} {_BSD_DISCLAIMER}""",
    "BSD-3-Clause": f"""<<beginOptional>><<beginOptional>>The<<endOptional>> BSD 3-Clause License<<endOptional>> {_COPYRIGHT} {_BSD_CONDITIONS}
        <<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="org";original="the copyright holder";match=".{{1,12}}">> nor the names of <<var;name="whose";original="its";match=".{{1,6}}">> contributors may be used to endorse or promote products derived from this software
        without specific prior written permission. {_BSD_DISCLAIMER}""",
    "ISC": f"""<<beginOptional>><<beginOptional>>The<<endOptional>> ISC License <<beginOptional>>(ISC)<<endOptional>><<endOptional>> {_COPYRIGHT} Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE {_AS_IS}<<beginOptional>> AND <<var;name="who";original="THE AUTHOR";match=".{{1,12}}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="liable";original="THE AUTHOR";match=".{{1,12}}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE<<endOptional>>""",
}

#: Values of attributes are quoted and may hold any character, > too.
_MARK = re.compile(r'<<(beginOptional|endOptional|var)((?:"[^"]*"|[^>"])*)>>')
_MATCH = re.compile(r'\bmatch="\.(?:\{(\d+)(,?)(\d*)\}|([+*]))"')
_TOKEN = re.compile(r"[a-z0-9]+")
_SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense"}


def tokens(text: str) -> list[str]:
    """Runs of ASCII letters and digits in small letters; of spelling variants the first."""
    return [_SAME.get(t, t) for t in _TOKEN.findall(_ascii_lower(text))]


def _ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def parse(template: str) -> list:
    """A sequence of tokens, of ("any", lo, hi), hi None for without end, and of ("optional", sequence). Markup that isn't understood is an error."""
    if "<<" in (left := _MARK.sub("", template)):
        raise ValueError(f"not understood: {left[left.index('<<') :][:80]}")
    stack: list[list] = [[]]
    at = 0
    for m in _MARK.finditer(template):
        stack[-1] += tokens(template[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            inner = stack.pop()
            if not stack:
                raise ValueError("an optional region ends that didn't begin")
            stack[-1].append(("optional", inner))
        elif not (n := _MATCH.search(m[2])):
            raise ValueError(f"not understood: {m[0][:80]}")
        elif n[4]:
            stack[-1].append(("any", int(n[4] == "+"), None))
        else:
            stack[-1].append(("any", int(n[1]), int(n[3]) if n[3] else None if n[2] else int(n[1])))
    if len(stack) > 1:
        raise ValueError("an optional region doesn't end")
    stack[-1] += tokens(template[at:])
    return stack[0]


class Automaton:
    """States are bits: a state waits for a token (None: any) and moves to the next; `skip` has the jumps without one."""

    def __init__(self, template: str) -> None:
        self.wants: list[str | None] = []
        self.skip: dict[int, list[int]] = {}
        self.stays = 0
        self._add(parse(template))
        self.end = len(self.wants)
        self.by_token: dict[str, int] = {}
        self.any = 0
        for i, w in enumerate(self.wants):
            if w is None:
                self.any |= 1 << i
            else:
                self.by_token[w] = self.by_token.get(w, 0) | 1 << i
        self.closed = [self._closure(i) for i in range(self.end + 1)]
        self.jumping = sum(1 << i for i in self.skip)
        first = [i for i in range(self.end) if self.closed[0] >> i & 1]
        self.first = {self.wants[i] for i in first}
        if None in self.first or self.closed[0] >> self.end & 1 or not _mandatory(parse(template)):
            raise ValueError("a template must begin with wording, and some of its wording must be mandatory")

    def _add(self, parts: list) -> None:
        for p in parts:
            at = len(self.wants)
            if isinstance(p, str):
                self.wants.append(p)
            elif p[0] == "optional":
                self._add(p[1])
                self.skip.setdefault(at, []).append(len(self.wants))
            elif p[2] is None:
                self.wants += [None] * (p[1] + 1)
                self.stays |= 1 << at + p[1]
                self.skip.setdefault(at + p[1], []).append(at + p[1] + 1)
            else:
                self.wants += [None] * p[2]
                for i in range(p[1], p[2]):
                    self.skip.setdefault(at + i, []).append(at + p[2])

    def _closure(self, state: int) -> int:
        out, todo = 0, [state]
        while todo:
            s = todo.pop()
            if not out >> s & 1:
                out |= 1 << s
                todo += self.skip.get(s, [])
        return out

    def match(self, words: list[str], at: int) -> int:
        """The number of tokens of the longest run from `at` that is accepted, or 0."""
        states, found, done = self.closed[0], 0, 1 << self.end
        for n in range(at, len(words)):
            stay = states & self.stays
            states = (states & (self.by_token.get(words[n], 0) | self.any)) << 1 | stay
            if not states:
                break
            jump = states & self.jumping
            while jump:
                low = jump & -jump
                states |= self.closed[low.bit_length() - 1]
                jump ^= low
            if states & done:
                found = n + 1 - at
        return found


class Scanner:
    """Automata of templates, by the words that they begin with."""

    def __init__(self, templates: Mapping[str, str]) -> None:
        self.automata = {k: Automaton(t) for k, t in templates.items()}
        self.starts: dict[str, list[str]] = {}
        for k, a in self.automata.items():
            for w in a.first:
                self.starts.setdefault(w, []).append(k)

    def matches(self, text: str) -> list[tuple[str, int, int]]:
        """(license, first token, tokens) of every run that a template accepts; of runs of one license that overlap, the first."""
        words, out = tokens(text), []
        free = dict.fromkeys(self.automata, 0)
        for at, w in enumerate(words):
            for k in self.starts.get(w, ()):
                if at >= free[k] and (n := self.automata[k].match(words, at)):
                    out.append((k, at, n))
                    free[k] = at + n
        return out


@cache
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(templates))


def _mandatory(parts: list) -> list[str]:
    return [p for p in parts if isinstance(p, str)]


def anchors(templates: Mapping[str, str] = TEMPLATES) -> list[str]:
    """A set of words such that every template has one of them as mandatory wording, in each spelling."""
    out: set[str] = set()
    for t in templates.values():
        words = _mandatory(parse(t))
        if not out & set(words):
            out.add(max((w for w in words), key=lambda w: (w in ("license", "licensed"), len(w))))
    return sorted({x for w in out for x in [w, *(k for k, v in _SAME.items() if v == w)]})


def matches(text: str, templates: Mapping[str, str] = TEMPLATES) -> list[tuple[str, int, int]]:
    """What templates accept in a text: see Scanner.matches."""
    return _scanner(tuple(templates.items())).matches(text)


def may_match(text: Column, templates: Mapping[str, str] = TEMPLATES) -> Column:
    """False only for texts without any anchor, in which no template can match; runs in the JVM."""
    low, out = F.lower(text), F.lit(False)
    for a in anchors(templates):
        out = out | F.contains(low, F.lit(a))
    return F.coalesce(out, F.lit(False))


_FOUND = ArrayType(StructType([StructField("license", StringType()), StructField("first_token", IntegerType()), StructField("n_tokens", IntegerType())]))


def _udf(templates: Mapping[str, str]):
    given = tuple(templates.items())

    @F.arrow_udf(_FOUND)
    def scan_texts(text: pa.Array) -> pa.Array:
        scanner = _scanner(given)
        rows = [None if t is None else [{"license": k, "first_token": a, "n_tokens": n} for k, a, n in scanner.matches(t)] for t in text.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("license", pa.string()), ("first_token", pa.int32()), ("n_tokens", pa.int32())])))

    return scan_texts


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, n_matches, first_token, n_tokens): one row per document and license; the last two of its first match.

    templates: markup by the license's name; markup that isn't understood is an error before any text is read.
    Null and empty texts match nothing; repeated rows have rows each; a null id stays null; an empty
    table gives an empty table. Other columns are ignored.
    """
    Scanner(templates)
    asked = in_small_batches(docs).select("doc_id", "text").where(may_match(F.col("text"), templates))
    found = asked.select("doc_id", _udf(templates)("text").alias("f")).where("size(f) > 0")
    names = F.array_sort(F.array_distinct(F.col("f.license")))
    each = found.select("doc_id", "f", F.explode(names).alias("license"))
    own = F.filter("f", lambda x: x["license"] == F.col("license"))
    return each.select("doc_id", "license", F.size(own).alias("n_matches"), own[0]["first_token"].alias("first_token"), own[0]["n_tokens"].alias("n_tokens"))


def _regex(template: str) -> str:
    """A template as a regular expression over ' token token ...', each token with a blank before it: by rewriting the markup itself, without parse()."""
    out, rest = "", template
    while rest:
        wording, mark, rest = rest.partition("<<")
        out += "".join(f" {_SAME.get(w, w)}" for w in re.split("[^a-z0-9]+", wording.lower()) if w)
        if not mark:
            break
        quoted = at = 0
        while quoted or rest[at : at + 2] != ">>":  # the mark ends outside of quotes
            quoted ^= rest[at] == '"'
            at += 1
        inside, rest = rest[:at], rest[at + 2 :]
        if inside == "beginOptional":
            out += "(?:"
        elif inside == "endOptional":
            out += ")?"
        else:
            out += "(?: [a-z0-9]+)" + inside.rpartition('match="')[2].rstrip('"').removeprefix(".")
    return out


def sql() -> str:
    """The query in DuckDB's SQL, by regular expressions."""
    flat = "' ' || trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) || ' '"
    for k, v in _SAME.items():
        flat = f"replace({flat}, ' {k} ', ' {v} ')"
    each = "\nUNION ALL ".join(
        f"SELECT doc_id, '{k}' AS license, regexp_extract_all(t, '({_regex(v)}) ', 1) AS m, regexp_extract(t, '^(.*?){_regex(v)} ', 1) AS pre FROM n" for k, v in TEMPLATES.items()
    )
    return f"""WITH n AS (SELECT doc_id, {flat} AS t FROM documents), f AS ({each})
SELECT doc_id, license, CAST(len(m) AS INTEGER) AS n_matches, CAST(len(regexp_extract_all(pre, '[a-z0-9]+')) AS INTEGER) AS first_token, CAST(len(regexp_extract_all(m[1], '[a-z0-9]+')) AS INTEGER) AS n_tokens
FROM f WHERE len(m) > 0"""
