"""Chat formatting: roles of raw transcripts by a hidden Markov model, then canonical turns.

A transcript is text in which turns may open with a speaker marker (of many styles), with a blank
line, or with nothing. Its lines are the observations. A hidden state is a role and whether the
line opens a turn; a line's features are the marker it begins with, whether a blank line is before
it, how it ends, how long it is, and whether it looks like code or a list. Viterbi finds the likeliest
states, which give each line its role and cut the text into turns. A line with a marker always opens a
turn of the marker's role, and a line inside a fenced block never opens one: their other emissions have
probability 0. Markers are dropped, all other text is kept as it is, and turns are rendered in one form.

The model is trained by counting over all labelled conversations, in a distributed aggregation
whose result has a fixed size (states squared, and states times feature values).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from strataleaf.llm.common import written

ROLES = ("system", "user", "assistant")
#: Speaker markers in small letters, by the role they suggest.
MARKERS = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "q", "question", "customer", "prompt", "instruction"),
    "assistant": ("assistant", "ai", "a", "answer", "bot", "agent", "response", "model"),
}
_OF = {w: i + 1 for i, r in enumerate(ROLES) for w in MARKERS[r]}
_MARKER = re.compile(rf"(?i)^ {{0,3}}(?:(?:\#{{1,4}}|\*\*|<\|?|\[|>)\s*)?(?P<who>{'|'.join(sorted(_OF, key=len, reverse=True))})\s*(?:(?:\*\*|\|?>|\])\s*:?|:\*\*|:(?!//))[ \t]*|^ {{0,3}}\#{{2,4}}\s*(?P<head>{'|'.join(sorted(_OF, key=len, reverse=True))})\s*$")
_LINE = re.compile(r"\r\n?|\n")
_FENCE = re.compile(r" {0,3}(```+|~~~+)[ \t]*([^`]*)$")
_ITEM = re.compile(r"(?:[-*+\u2022]|\d{1,3}[.)])[ \t]")
_CODE = re.compile(r"(?:def|class|if|elif|else|for|while|return|import|from|function|const|let|var|public|private|static|try|except|catch|print|\#include|SELECT|end|fi|done)\b.*[:;{})\]]\s*$|^[})\]]|[;{]\s*$|^(?:return|import|from)\s+[\w.]+\s*$|^[\w.\[\]]+ ?[-+*/]?= ?\S")
_STATES = [(r, b) for r in range(3) for b in (1, 0)]
#: Sizes of the features: marker (none in a transcript that has some, of a role, none in one that has none), with a blank line before
#: or not, in a transcript whose markers mostly have one or not; end of the line, length in words by powers of two, look (plain, indented, item of a list, code, inside a fence).
_SIZES = (20, 4, 8, 5)
_MARK, _LOOK, _INSIDE = 0, 3, 4
#: What training data may lack: as if so many lines that go on a turn had been seen, of each look but plain, and so many of them after each state.
PRIOR = 50
BORROWED = 0.1


def _inside(lines: list[str]) -> set[int]:
    """The lines of fenced blocks after the fence that opens them; a fence that nothing closes opens none."""
    fences = [(i, m[1], m[2].strip()) for i, line in enumerate(lines) if (m := _FENCE.match(line))]
    out: set[int] = set()
    closers: dict[str, list[int]] = {}
    for i, mark, info in reversed(fences):
        if not info:
            closers.setdefault(mark[0], []).append(i)
    at = -1
    for i, mark, _ in fences:
        if i <= at:
            continue
        ends = closers.get(mark[0], [])
        while ends and ends[-1] <= i:
            ends.pop()
        if ends:
            at = ends[-1]
            out.update(range(i + 1, at + 1))
    return out


def _look(line: str) -> int:
    if line[:1] == "\t" or line[:2] == "  ":
        return 1
    return 2 if _ITEM.match(line) else 3 if _CODE.search(line) else 0


def _features(lines: list[str]) -> list[tuple[tuple[int, ...], str, int]]:
    """Of each line that isn't blank: its features, what it says without its marker, and its number."""
    out, gap, inside = [], 0, _inside(lines)
    marks = [None if i in inside else _MARKER.match(line) for i, line in enumerate(lines)]
    none = 0 if any(marks) else 4
    gaps = [not lines[i - 1].strip() for i, m in enumerate(marks) if m and i]
    apart = int(2 * sum(gaps) > len(gaps))
    for i, (line, m) in enumerate(zip(lines, marks, strict=True)):
        if not line.strip():
            gap = 1
            continue
        said = line[m.end() :] if m else line
        s = said.rstrip()
        end = 0 if not s else 1 if s[-1] == "?" else 2 if s[-1] in ".!" else 3
        look = _INSIDE if i in inside else _look(said)
        mark = _OF[(m["who"] or m["head"]).lower()] if m else none
        out.append(((4 * mark + 2 * apart + gap, end, min(7, len(said.split()).bit_length()), look), said, i))
        gap = 0
    return out


def viterbi(observed: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The likeliest states; observed: lines x states, all in logarithms. Of equal ones the first."""
    n = len(observed)
    back = np.zeros((n, len(start)), np.int64)
    score = start + observed[0]
    for i in range(1, n):
        all_ = score[:, None] + move
        back[i] = all_.argmax(0)
        score = all_[back[i], np.arange(len(start))] + observed[i]
    path = [int(score.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return np.array(path[::-1])


class Model:
    """Logarithms of the start, transition and emission probabilities.

    Counts are smoothed: by one, or PRIOR, for each start, move and value; the share BORROWED of an emission is that
    of the lines of all roles, for a role that is rare knows little of its own lines.
    """

    def __init__(self, counts: dict[tuple[str, int, int], int]) -> None:
        k = len(_STATES)
        start, move = np.ones(k), np.ones((k, k))
        seen = [np.zeros((k, n)) for n in _SIZES]
        for (kind, x, y), n in counts.items():
            if kind == "start":
                start[y] += n
            elif kind == "move":
                move[x, y] += n
            else:
                seen[int(kind)][x, y] += n
        emit = []
        for i, c in enumerate(seen):
            e = c / np.maximum(c.sum(1, keepdims=True), 1)
            for b in (0, 1):
                own = [j for j, (_, begins) in enumerate(_STATES) if begins == b]
                all_ = c[own].sum(0) + 1
                if i == _LOOK and not b:
                    all_[1:] += PRIOR
                e[own] = np.where(c[own].any(1, keepdims=True), (1 - BORROWED) * e[own], 0) + BORROWED * all_ / all_.sum()
            emit.append(e)
        for i, (role, begins) in enumerate(_STATES):
            if not begins:
                move[[j for j, (r, _) in enumerate(_STATES) if r == role], i] += PRIOR
        for i, (own, begins) in enumerate(_STATES):
            start[i] *= begins  # a text opens a turn
            for m in range(1, 4):
                if not begins or m != own + 1:
                    emit[_MARK][i, 4 * m : 4 * m + 4] = 0  # a marker opens a turn of its role
            if begins:
                emit[_LOOK][i, _INSIDE] = 0
            for j, (role, begins2) in enumerate(_STATES):
                if not begins2 and role != _STATES[i][0]:
                    move[i, j] = 0  # a turn goes on in its role
        with np.errstate(divide="ignore"):
            self.start, self.move = np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True))
            self.emit = [np.log(e / e.sum(1, keepdims=True)) for e in emit]

    def turns(self, text: str) -> list[tuple[str, str]]:
        """(role, text) of the turns of a transcript; empty if it has no line."""
        lines = _LINE.split(text)
        found = _features(lines)
        if not found:
            return []
        f = np.array([x for x, _, _ in found])
        with np.errstate(invalid="ignore"):
            states = viterbi(sum(self.emit[i][:, f[:, i]].T for i in range(len(_SIZES))), self.start, self.move)
        out: list[tuple[str, int, int]] = []  # role, first and last of the turn's lines by their place in found
        for i, s in enumerate(states):
            role, begins = _STATES[s]
            if begins or not out:
                out.append((ROLES[role], i, i))
            else:
                out[-1] = (*out[-1][:2], i)
        return [(role, _said(lines, found, a, b)) for role, a, b in out]


def _said(lines: list[str], found: list, first: int, last: int) -> str:
    """The text of a turn: its lines as they are, without the marker, and without blank lines around it."""
    own = [found[first][1], *lines[found[first][2] + 1 : found[last][2] + 1]]
    while own and not own[0].strip():
        own.pop(0)
    return "\n".join(own)


_RESERVED = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def render(turns: list[tuple[str, str]]) -> str:
    """Turns in one form. What looks like the beginning of a control token in a text, <|, is written <\\|, and one that is so written takes another backslash."""
    return "".join("<|{}|>\n{}\n<|end|>\n".format(role, _RESERVED.sub(r"<\\\1|", text)) for role, text in turns)


def read(rendered: str) -> list[tuple[str, str]]:
    """The turns that render() was given."""
    return [(m[1], _ESCAPED.sub(r"<\1|", m[2])) for m in re.finditer(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>\n", rendered, re.DOTALL)]


_COUNT = "kind string, x int, y int, n long"


def train(transcripts: DataFrame) -> Model:
    """The model of transcripts (text, turns: array of struct(role, lines)), where lines is how many non-blank lines the turn has.

    A transcript whose turns don't add up to its lines, or with another role, isn't used.
    """

    def count(batches):
        from collections import Counter

        for pdf in batches:
            c: Counter = Counter()
            for text, turns in zip(pdf["text"], pdf["turns"], strict=True):
                if text is None or turns is None:
                    continue
                found = _features(_LINE.split(text))
                states = [_STATES.index((ROLES.index(t["role"]), int(i == 0))) for t in turns if t["role"] in ROLES for i in range(t["lines"])]
                if len(states) != len(found) or not found:
                    continue
                c["start", 0, states[0]] += 1
                for a, b in zip(states, states[1:], strict=False):
                    c["move", a, b] += 1
                for s, (f, _, _) in zip(states, found, strict=True):
                    for i, v in enumerate(f):
                        c[str(i), s, v] += 1
            yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["kind", "x", "y", "n"])

    rows = transcripts.select("text", "turns").mapInPandas(count, _COUNT).groupBy("kind", "x", "y").agg(F.sum("n").alias("n"))
    return Model({(r.kind, r.x, r.y): r.n for r in rows.collect()})  # at most 6 + 36 + 6 * 37 rows


def parsed(transcripts: DataFrame, model: Model) -> DataFrame:
    """(conv_id, n_turns, roles, rendered) of transcripts (conv_id, text).

    The text of turns is kept to the character, indentation and blank lines inside a turn too, but for
    markers with the blanks around them, blank lines around a turn, and line ends, which become line
    feeds; read() gives it back. A null, empty or blank text has no turns and renders as an empty string;
    repeated rows are parsed each; a null id stays null; an empty table gives an empty table. Other
    columns are ignored.
    """
    kind = StructType([StructField("n_turns", IntegerType()), StructField("roles", StringType()), StructField("rendered", StringType())])

    @F.pandas_udf(kind)
    def parse(text: pd.Series) -> pd.DataFrame:
        turns = [model.turns(t) if t else [] for t in text]
        return pd.DataFrame({"n_turns": [len(t) for t in turns], "roles": [",".join(r for r, _ in t) for t in turns], "rendered": [render(t) for t in turns]}).astype({"n_turns": "int32"})

    out = transcripts.select("conv_id", parse("text").alias("p"))
    return out.select("conv_id", "p.n_turns", "p.roles", "p.rendered")


_STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### System\n", "### Human\n", "### Response\n"),
    ("[SYSTEM] ", "[USER] ", "[BOT] "),
    ("Context: ", "Q: ", "A: "),
    ("", "", ""),
)


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, text, turns): raw transcripts of conversations (conv_id, turn, role, text), as they are met.

    The style of markers goes by the conversation; one turn in eight, by a hash, lacks its marker, and
    half the conversations have no blank lines between turns. Three turns in eight are laid out in several lines:
    by sentences, by paragraphs (where no blank lines are between turns), or as a list. Null texts are empty turns, null
    roles have no marker. turns keeps the truth, for training and tests.
    """
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(_STYLES)))
    bare = style == len(_STYLES) - 1
    apart = bare | (F.pmod(F.xxhash64(F.lit(3), "conv_id"), F.lit(2)) == 0)
    layout, sentence = F.pmod(F.xxhash64(F.lit(7), "conv_id", "turn"), F.lit(16)), r"([.?!]) +"
    said = F.when(layout < 3, F.regexp_replace("text", sentence, "$1\n")).when((layout == 3) & ~apart, F.regexp_replace("text", sentence, "$1\n\n")).when(layout.isin(4, 5), F.regexp_replace("text", sentence, "$1\n- "))
    c = c.withColumn("said", said.otherwise(F.col("text")))
    marker: Column = F.lit("")
    for i, names in enumerate(_STYLES):
        for role, m in zip(ROLES, names, strict=True):
            marker = F.when((style == i) & (F.col("role") == role), F.lit(m)).otherwise(marker)
    marker = F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0, F.lit("")).otherwise(marker)
    gap = F.when(apart, F.lit("\n\n")).otherwise(F.lit("\n"))
    c = c.select("conv_id", F.struct("turn", "role", "said", F.concat(marker, "said").alias("line"), gap.alias("gap")).alias("t"))
    each = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    lines = lambda s: F.size(F.filter(F.split(s, "\n|\r\n?"), lambda x: F.trim(x) != ""))
    return each.select("conv_id", F.array_join(F.transform("t", lambda t: F.concat(t["line"], t["gap"])), "").alias("text"), F.transform("t", lambda t: F.struct(t["role"].alias("role"), lines(t["line"]).alias("lines"))).alias("turns"))


def formatted(conversations: DataFrame) -> DataFrame:
    """Transcripts of conversations, parsed by a model of all of them."""
    raw = written(transcripts(conversations), "transcripts")
    return parsed(raw, train(raw))
