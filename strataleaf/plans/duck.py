"""Pieces of DuckDB SQL that the oracles share. Written apart from the Spark expressions, to check them."""

from __future__ import annotations

SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, list):
        return "[" + ", ".join(map(literal, v)) + "]"
    return text(v) if isinstance(v, str) else str(v)


def values(rows: list[tuple], columns: str) -> str:
    """A subquery of inline rows."""
    names = [c.split()[0] for c in columns.split(",")]
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS _v({', '.join(names)}))"


def mask(s: str) -> str:
    return rf"regexp_replace(regexp_replace({s}, '[\x{{10000}}-\x{{10FFFF}}]', '  ', 'g'), '[^\r\n]', ' ', 'g')"


def replace_each(s: str, pattern: str, f) -> str:
    p = text(pattern)
    gaps, hits = f"string_split_regex({s}, {p})", f"regexp_extract_all({s}, {p}, 0)"
    return f"array_to_string(list_transform(range(1, len({gaps}) + 1), lambda i: {gaps}[i] || coalesce({f(f'{hits}[i]')}, '')), '')"


def mask_each(s: str, pattern: str) -> str:
    return replace_each(s, pattern, mask)


def mask_to_semicolon(s: str, pattern: str) -> str:
    return replace_each(s, pattern, lambda m: f"(substr({mask(m)}, 2) || ';')")


COMMENT = r"(?s)<!--.*?-->"
STYLE = r"(?is)<style\b[^>]*>.*?</style>"
SCRIPT = r"(?is)<script\b[^>]*>.*?</script>"
BODY = r"(?is)<script\b[^>]*>(.*?)</script>"
TAG = r"(?i)</?script[^>]*>"
BR = r"(?i)</?br>"


def script_text(s: str) -> str:
    return f"array_to_string(list_filter(regexp_extract_all({s}, {text(BODY)}, 1), lambda b: regexp_matches(b, '[^{SPACE}]')), chr(10))"


def score(t: str) -> str:
    return f"CASE WHEN {t} IN ('', '/*unresolved*/ any', 'Promise<any>', 'Promise<unknown>', 'any', 'any[]', 'error', 'unknown', 'unknown[]') THEN 0 WHEN contains({t}, '=>') THEN 3 WHEN regexp_matches({t}, 'import\\(|[{{|]') THEN 2 ELSE 1 END"


def classify(t: str) -> str:
    return rf"""CASE WHEN regexp_matches({t}, 'error|unresolved|unknown|\bany\b') THEN 'unresolved' WHEN regexp_matches({t}, '=>|^<[^>]+>\(') THEN 'functionTypes'
      WHEN contains({t}, '|') THEN 'unionTypes' WHEN suffix({t}, '[]') OR regexp_matches({t}, '\b(Record|Promise|Map|Set|ReadonlyArray|Array)<|^(readonly )?\[') THEN 'genericTypes'
      WHEN regexp_matches({t}, '^\{{.*\}}$') THEN 'objectTypes' WHEN {t} IN ('void', 'undefined', 'symbol', 'string', 'number', 'null', 'boolean', 'bigint') THEN 'primitiveTypes' ELSE 'otherTypes' END"""
