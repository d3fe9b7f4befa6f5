"""Secret scans by assignment-aware lexing.

A lexer that suits source code and configuration alike turns a text into name-literal pairs:
`name = "..."`, `name := '...'`, `"name": "..."`, `name => "..."`, `export NAME=bare`,
`name: bare`, `<name>bare</name>`, call arguments `name="..."`. The right side may join parts:
literals, references to names that were assigned before (also `${name}` inside a literal), and
`+`, `.` or blank between them; so constants reach the name they end in. A value is kept as a graph
of parts, so that text like `x = x + x`, however often repeated, takes linear time and space. A pair's
score is the sensitivity of its name, word by word, times the strength of its value; values that look
like placeholders, paths or plain words score low, private keys and passphrases don't. What is
reported, and redacted, is every literal that went into the value. A value that is joined from parts
to more than LONGEST characters isn't written out: it counts as strong, and has no hash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from strataleaf.llm.common import in_small_batches

#: Sensitive words, and pairs of words, of names, and how much each weighs; a name takes its heaviest. Plurals count too.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.9, "secret": 1.0, "token": 0.9, "credential": 0.9, "cred": 0.9, "auth": 0.7, "authorization": 0.7,
    "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "private key": 1.0, "api key": 1.0, "access key": 1.0, "signing": 0.7, "encryption": 0.7,
    "connstr": 0.7, "connectionstring": 0.7, "conn str": 0.7, "connection string": 0.7,
}
#: Words that also count at the end of a longer one that has no mark between: dbpassword, clientsecret.
_ENDINGS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "credential", "apikey", "accesskey", "privatekey", "secretkey")
#: A name whose last word is one of these tells of a secret, and doesn't hold it.
_META = frozenset(
    """name type url uri path file filename dir folder count length len limit size expiry expires expiration ttl class format header field label hint policy regex
    pattern version message msg error title placeholder help description prompt rule model index max min lifetime timeout endpoint issuer audience algorithm alg
    kind mode status enabled required page form button link arn provider method scheme prefix suffix strategy""".split()
)
META_FACTOR = 0.4
THRESHOLD = 0.5
REDACTED = "[REDACTED]"
#: Characters of a joined value that are written out.
LONGEST = 8_192
#: A text without a match of both holds no assignment to a sensitive name; the second is searched for in lower case, without - and _.
_OPERATORS = ("=", ":", ">")
_STEMS = sorted({k.replace(" ", "") for k in SENSITIVE})
_STEMS = [x for x in _STEMS if not any(y in x for y in _STEMS if y != x)]

_SEGMENTS = re.compile(r"[.\[\]$@]+")
_WORD = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Possessive, and begun only where no name is under way, so that a long run of letters is read once.
_NAME = r"(?<![A-Za-z0-9_$@])(?<![A-Za-z0-9_$@][.\-])[A-Za-z_$@][A-Za-z0-9_$@]*+(?:[.\-][A-Za-z0-9_$@]++|\[[A-Za-z0-9_$@]++\])*+"
_STRING = r'"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`'
#: A type between a name and its `=`: names with dots, arguments in brackets, alternatives. Possessive throughout.
_ANNOTATION = r"[&*]?[A-Za-z_][\w.]*+(?:\[[^\[\]\n=]*+(?:\[[^\[\]\n=]*+\][^\[\]\n=]*+)*+\]|<[^<>\n=]*+>)?+(?:[ \t]*+\|[ \t]*+[\w.]++)*+\??"
#: A target, possibly quoted or subscripted, and its operator; `==` and `::` are none.
_TARGET = re.compile(rf"""(?P<q>["']?)(?P<name>{_NAME})(?P=q)["'\]]*(?:\s*+:\s*+{_ANNOTATION}(?=[ \t]*+=(?![=>])))?[ \t]*(?P<op>:=|=>|=(?!=)|:(?![:/]))[ \t]*|<(?P<tag>{_NAME})>""")
_PART = re.compile(rf"(?P<string>[bruRfF]{{0,2}}(?:{_STRING}))|(?P<ref>(?:\$\{{?)?{_NAME}\}}?)|(?P<join>[ \t]*(?:\+|\.\.|\|\||\.)[ \t]*(?:\\?\n[ \t]*)?|[ \t]+)")
_BARE = re.compile(r"[^\s,;<>(){}\[\]\"'`]+")
_REFERENCE = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+")
_INNER = re.compile(r"\$\{([A-Za-z_][\w.]*)\}|\{([A-Za-z_][\w.]*)\}|\$([A-Za-z_]\w*)")
_DULL = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\{.*\}|\$\{.*\}|\$\(.*\)|%.*%|change.?me|placeholder|none|null|true|false|todo|dummy|test(?:ing)?|default|undefined|string|\[redacted\])$|://[^@]*$")
#: Dull only if what they are made of are words: a random value may begin with these too.
_PATH = re.compile(r"/|\./|[A-Za-z]:\\")
_VARIABLE = re.compile(r"\$[A-Za-z_][\w.:>\-\[\]'\"]*")
_SAMPLE = re.compile(r"(?i)your|example")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SCHEME = re.compile(r"(?i)(?:bearer|basic|token)[ \t]+")
_USERINFO = re.compile(r"://[^/@\s:]+:[^/@\s]+@")
_PRIVATE = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
#: A private key without quotes, after the sign of a block, or in quotes that end on another line.
_PEM = re.compile(r"""["'`]?(?:[|>][-+]?[ \t]*\n\s*)?(?P<pem>-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----)[\s\S])*+(?:-----END [A-Z0-9 ]*-----)?)""")
#: Names that end so, and values with such words, are what a user is told, not a passphrase.
_ABOUT = re.compile(r"(?i)(?:label|hint|message|msg|error|text|title|placeholder|help|description|prompt|name|url|type|field|regex|pattern|policy|rules?)s?$")
_TOLD = re.compile(r"(?i)\b(?:please|enter|type|your|passwords?|passphrase|must|should|required?|invalid|incorrect|wrong|forgot(?:ten)?|reset|confirm|missing|expired|failed)\b|[<>{}%]|[\r\n]")


@lru_cache(4096)
def sensitivity(name: str) -> float:
    """The weight of the heaviest sensitive word, or pair of neighbours, of a name."""
    out = 0.0
    for segment in _SEGMENTS.split(name):
        words = [w if w in SENSITIVE or w.endswith("ss") else w.removesuffix("s") for w in map(str.lower, _WORD.findall(segment))]
        for w in words:
            out = max(out, SENSITIVE.get(w, 0.0), next((SENSITIVE[x] for x in _ENDINGS if w.endswith(x)), 0.0))
        for pair in zip(words, words[1:], strict=False):
            out = max(out, SENSITIVE.get(" ".join(pair), 0.0))
    return out


def _tells_about(name: str) -> bool:
    words = _WORD.findall(_SEGMENTS.split(name.rstrip("]"))[-1])
    return bool(words) and {words[-1].lower(), words[-1].lower().removesuffix("s")} & _META != set()


def _wordy(s: str) -> bool:
    """Whether letters and digits come in runs as long as those of words: of random ones a run has hardly two."""
    runs = _PIECE.findall(s)
    return sum(map(len, runs)) >= 2.75 * len(runs)


def _dull(value: str) -> bool:
    if _DULL.search(value):
        return True
    if m := _PATH.match(value):
        return all(len(x) <= 3 or _wordy(x) for x in re.split(r"[\\/]", value[m.end() :]))
    if m := _SAMPLE.match(value):
        return _wordy(value[m.end() :])
    return bool(_VARIABLE.fullmatch(value)) and _wordy(value)


def strength(value: str) -> float:
    """0 to 1: grows with length and with entropy a character; 0 for placeholders, paths, short values, and values of one plain word or several."""
    return 0.0 if re.search(r"\s", value) else _entropy(value)


def _entropy(value: str) -> float:
    if len(value) < 8 or _dull(value):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if kinds == 1 and not re.search("[0-9]", value):
        bits -= 1.5
    return max(0.0, min(1.0, (bits - 1.0) / 2.0)) * min(1.0, 0.5 + n / 32)


def score(name: str, value: str) -> float:
    """Sensitivity times strength. Private keys are strong; a token counts without its scheme; words with blanks between
    them count as a passphrase unless name or value tell that they are addressed to a user."""
    if not (weight := sensitivity(name)):
        return 0.0
    if _PRIVATE.search(value):
        return weight
    if _tells_about(name) and not _USERINFO.search(value):
        weight *= META_FACTOR
    value = value.strip()
    if m := _SCHEME.match(value):
        value = value[m.end() :]
    if re.search(r"\s", value):
        return 0.0 if _ABOUT.search(name) or _TOLD.search(value) or "-----BEGIN" in value else weight * _entropy(value)
    return weight * strength(value)


def _unquoted(s: str) -> tuple[str, int]:
    """The inside of a string token, and where it begins."""
    at = re.match("[bruRfF]{0,2}", s).end()
    width = 3 if s[at : at + 3] in ('"""', "'''") and len(s) >= at + 6 else 1
    return s[at + width : len(s) - width], at + width


class _Value:
    """What a name was assigned: pieces of text and values of other names, and the literals that stand here."""

    __slots__ = ("length", "parts", "reported", "spans")

    def __init__(self, parts: list[str | _Value], spans: list[tuple[int, int]]) -> None:
        self.parts = [p for p in parts if (len(p) if isinstance(p, str) else p.length)]
        self.length = sum(len(p) if isinstance(p, str) else p.length for p in self.parts)
        self.spans = [s for s in spans if s[1]]
        self.reported = 0.0  # the best score that all literals below were reported with

    def text(self) -> str | None:
        """Written out; None for a joined value of more than LONGEST characters."""
        if len(self.parts) == 1 and isinstance(self.parts[0], str):
            return self.parts[0]
        if self.length > LONGEST:
            return None
        out, todo = [], [self]
        while todo:
            p = todo.pop()
            if isinstance(p, str):
                out.append(p)
            else:
                todo += reversed(p.parts)
        return "".join(out)


def _joined(parts: list[str | _Value], spans: list[tuple[int, int]]) -> _Value:
    made = _Value(parts, spans)
    # a value that is another one, and no more, is that one: so chains of names don't grow
    return made.parts[0] if len(made.parts) == 1 and not made.spans and isinstance(made.parts[0], _Value) else made


def findings(text: str) -> list[tuple[str, int, int, float, str | None]]:
    """(name, start, length, score, value) of every literal that reaches a sensitive name; each literal once, with its best score."""
    known: dict[str, _Value] = {}
    best: dict[tuple[int, int], tuple[str, int, int, float, str | None]] = {}
    at = 0
    while m := _TARGET.search(text, at):
        name, at = m["name"] or m["tag"], m.end()
        value, end = _value(text, at, known, bare=m["tag"] is not None or m["op"] in ("=", ":"))
        if value is None:
            continue
        at = max(at, end)
        short = re.split(r"[.\[\]]+", name.strip("]"))[-1].lstrip("$@")
        known[name] = known[short] = value
        weight = sensitivity(name)
        if not weight or value.reported >= 1:
            continue
        written = value.text()
        points = weight if written is None else score(name, written)
        if points < THRESHOLD:
            continue
        todo = [value]
        while todo:
            v = todo.pop()
            if v.reported < points:
                v.reported = points
                for s, n in v.spans:
                    if (s, n) not in best or best[s, n][3] < round(points, 4):
                        best[s, n] = (name, s, n, round(points, 4), written)
                todo += [p for p in v.parts if isinstance(p, _Value)]
    return sorted(best.values(), key=lambda f: f[1])


def _literal(token: str, start: int, known: dict[str, _Value]) -> _Value:
    """A string token that starts at `start`, with what it refers to put in."""
    inner, skip = _unquoted(token)
    parts: list[str | _Value] = []
    at, own = 0, False
    for r in _INNER.finditer(inner):
        got = known.get(next(g for g in r.groups() if g))
        if got:
            own |= r.start() > at
            parts += [inner[at : r.start()], got]
            at = r.end()
    own |= len(inner) > at
    return _joined([*parts, inner[at:]], [(start + skip, len(inner))] if own else [])


def _value(text: str, at: int, known: dict[str, _Value], bare: bool) -> tuple[_Value | None, int]:
    """What stands at `at`, or None, and where it ends."""
    parts: list[_Value] = []
    end = at
    while p := _PART.match(text, at):
        at = p.end()
        if p["join"] is not None:
            continue
        if p["string"] is not None:
            parts.append(_literal(p["string"], p.start(), known))
        else:
            got = known.get(p["ref"].strip("${}")) or known.get(p["ref"].strip("${}").split(".")[-1])
            if not got:
                break
            parts.append(got)
        end = at
    if parts:
        return _joined(parts, []), end
    at = end
    if p := _PEM.match(text, at):
        return _Value([p["pem"]], [(p.start("pem"), len(p["pem"]))]), p.end()
    if bare and (m := _SCHEME.match(text, at)) and (b := _BARE.match(text, m.end())) and not text.startswith(("(", "["), b.end()):
        word = b[0].rstrip(".")
        return _Value([word], [(b.start(), len(word))]), b.end()
    if bare and (b := _BARE.match(text, at)):
        word = b[0].rstrip(".")
        if not text.startswith(("(", "["), b.end()) and not _REFERENCE.fullmatch(word):  # calls, subscripts and attributes aren't literals
            return _Value([word], [(b.start(), len(word))]), b.end()
    return None, end


def may_hold(text: Column) -> Column:
    """False only for texts in which findings() finds nothing; runs in the JVM, cheapest test first."""
    flat = F.replace(F.replace(F.lower(text), F.lit("-"), F.lit("")), F.lit("_"), F.lit(""))
    operator, stem = F.lit(False), F.lit(False)
    for x in _OPERATORS:
        operator = operator | F.contains(text, F.lit(x))
    for x in _STEMS:
        stem = stem | F.contains(flat, F.lit(x))
    return F.coalesce(operator & stem, F.lit(False))


_FOUND = ArrayType(StructType([StructField("name", StringType()), StructField("start", IntegerType()), StructField("length", IntegerType()), StructField("score", DoubleType()), StructField("sha256", StringType())]))


@F.arrow_udf(_FOUND)
def _scan(text: pa.Array) -> pa.Array:
    def one(t: str | None):
        return None if t is None else [{"name": n, "start": s, "length": k, "score": x, "sha256": None if v is None else hashlib.sha256(v.encode("utf-8", "replace")).hexdigest()} for n, s, k, x, v in findings(t)]

    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64()), ("sha256", pa.string())]))
    return pa.array([one(t) for t in text.to_pylist()], kind)


def redacted_text(text: str) -> str:
    for _, start, length, _, _ in sorted(findings(text), key=lambda f: -f[1]):
        text = text[:start] + REDACTED + text[start + length :]
    return text


@F.pandas_udf(StringType())
def _redact(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else redacted_text(t))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, name, start, length, score, sha256): the literals of documents that reach sensitive names.

    start and length are characters of the text; sha256 is that of the assigned value, so that the
    result holds no secret; it is null for a joined value of more than LONGEST characters. Null and empty texts have no findings; repeated rows have theirs each; a
    null id stays null; an empty table gives an empty table. Other columns are ignored.
    """
    asked = in_small_batches(docs).select("doc_id", "text").where(may_hold(F.col("text")))
    found = asked.select("doc_id", _scan("text").alias("f")).where("size(f) > 0").select("doc_id", F.explode("f").alias("f"))
    return found.select("doc_id", "f.name", "f.start", "f.length", "f.score", "f.sha256")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every finding in text replaced by [REDACTED], and n_chars, if there, made to fit. All rows stay, nulls too.

    Only texts that may hold a secret are sent to Python; the others pass as they are.
    """
    clean = _redact(F.when(may_hold(F.col("text")), F.col("text")))
    out = in_small_batches(docs).withColumn("_sl_clean", clean)
    changed = {"text": F.coalesce("_sl_clean", "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_sl_clean") != F.col("text"), F.length("_sl_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*docs.columns)
