"""Embedded templates (EJS) rewritten as code of the same length.

The rewriting moves a cursor over tags whose text depends on what was replaced before, which column
expressions can't do; it runs as an Arrow-batched UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SCRIPT = re.compile(r"<script>(.*?)</script>", re.I | re.S)
_TAG = re.compile(r"(?P<open><%[=_#-]?)(?P<code>.*?)(?P<close>[_#-]?%>)", re.S)
_CONTROL = re.compile(r"(?P<word>for|if|while)\s+(?!\()(?P<rest>[^\n\r]+)")
_HEAD = re.compile(r"catch|for|if|switch|try|while")


def _units(text: str) -> str:
    """Text with each UTF-16 unit as one character; characters beyond U+FFFF become surrogate pairs."""
    if text.isascii():
        return text
    return "".join(c if c < "\U00010000" else "".join(map(chr, (0xD800 + ((ord(c) - 0x10000) >> 10), 0xDC00 + ((ord(c) - 0x10000) & 0x3FF)))) for c in text)


def _whole(text: str) -> str:
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _blank(chars: list[str], start: int, end: int) -> None:
    chars[start:end] = " " * (end - start)


def _open_scripts(text: str) -> str:
    """Script elements without attributes turned into one tag each; tags nested in them lose their marks."""
    chars = list(text)
    for m in _SCRIPT.finditer(text):
        body, end = m.span(1)
        chars[m.start() : body] = "<%".ljust(body - m.start())
        chars[end : m.end()] = "%>".ljust(m.end() - end)
        for t in _TAG.finditer(m[1]):
            if t["open"] == "<%" and t["close"] == "-%>":
                _blank(chars, body + t.start(), body + t.end())
            else:
                _blank(chars, body + t.start(), body + t.end("open"))
                _blank(chars, body + t.start("close"), body + t.end())
    return "".join(chars)


def _control(code: str) -> str | None:
    """Template shorthand as code, or null if the tag's text can stay."""
    if code in ("end", "else"):
        return {"end": "}", "else": "} else {"}[code]
    if code.startswith("else if"):
        rest = code[4:].strip()
        m = re.fullmatch(r"if\s+(?!\()([^\n\r]+)", rest)
        return "} else " + (f"if ({m[1]})" if m else rest) + " {"
    m = _CONTROL.fullmatch(code)
    new = f"{m['word']} ({m['rest']})" if m else code
    if _HEAD.match(new) and not new.endswith(("{", "}", ";")):
        new += " {"
    return new if new != code else None


def template_code(text: str) -> str:
    """Everything outside of tags blanked, tags' code in place; control heads are opened with braces and
    statements closed with semicolons. Line ends stay, and so does the length in UTF-16 units."""
    source = _open_scripts(_units(text))
    out = [c if c in "\r\n" else " " for c in source]
    for m in _TAG.finditer(source):
        code = m["code"].strip()
        if m["open"] == "<%#" or code.startswith("include "):
            continue
        new = _control(code)
        if new is not None:
            new = new if new.endswith(("{", "}", ";")) else new + ";"
            new = new[: len(m[0])]
            out[m.start() : m.start() + len(new)] = new
            continue
        out[m.start("code") : m.end("code")] = m["code"]
        if code and not code.endswith(("{", "}", ";")):
            out[m.end("code")] = ";"
    return _whole("".join(out))


@F.pandas_udf(StringType())
def _transform(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else template_code(t))


def transformed(text: Column) -> Column:
    """template_code of a column; null stays null."""
    return _transform(text)
