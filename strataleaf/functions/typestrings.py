"""Type strings, as a checker prints them: scores, classes, comparison, normal forms."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strataleaf.functions.text import collapse_space

#: Never stored.
REJECTED = ("/*unresolved*/ any", "any", "any[]", "error", "unknown", "unknown[]")
#: Stored, but any other type is better.
UNRESOLVED = (*REJECTED, "Promise<any>", "Promise<unknown>")
PRIMITIVES = ("bigint", "boolean", "null", "number", "string", "symbol", "undefined", "void")
CLASSES = ("unresolved", "functionTypes", "unionTypes", "genericTypes", "objectTypes", "primitiveTypes", "otherTypes")


def has_any(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def is_rejected(t: Column) -> Column:
    return t.isin(*REJECTED) | (t == "")


def is_unresolved(t: Column) -> Column:
    return t.isin(*UNRESOLVED)


def score(t: Column) -> Column:
    """0 unresolved or empty, 3 a function, 2 an import, object or union, else 1."""
    return F.when(F.coalesce(t, F.lit("")).isin("", *UNRESOLVED), 0).when(has_any(t, "=>"), 3).when(has_any(t, "import(", "{", "|"), 2).otherwise(1)


_WORD_ANY = r"(^|[^A-Za-z0-9_])any([^A-Za-z0-9_]|\z)"
_GENERIC = r"(^|[^A-Za-z0-9_])(Array|Map|Promise|ReadonlyArray|Record|Set)<|^readonly \[|^\["


def classify(t: Column) -> Column:
    """One of CLASSES; the first that fits."""
    return (
        F.when(t.rlike(_WORD_ANY) | has_any(t, "unknown", "unresolved", "error"), CLASSES[0])
        .when(has_any(t, "=>") | t.rlike(r"^<[^>]+>\("), CLASSES[1])
        .when(has_any(t, "|"), CLASSES[2])
        .when(t.endswith("[]") | t.rlike(_GENERIC), CLASSES[3])
        .when(t.rlike(r"^\{[^\n\r\x{2028}\x{2029}]*\}\z"), CLASSES[4])
        .when(t.isin(*PRIMITIVES), CLASSES[5])
        .otherwise(CLASSES[6])
    )


def category(t: Column) -> Column:
    """The kind of a variable's type, in nine groups; the first that fits."""
    return (
        F.when(t.isin("any", "unknown"), "any")
        .when(has_any(t, "[]", "Array<"), "array")
        .when(t.isin("bigint", "boolean", "number", "string", "symbol"), "primitive")
        .when(t == "object", "object")
        .when(has_any(t, "=>") | (t == "Function"), "function")
        .when(has_any(t, "{", "<"), "complex")
        .when(has_any(t, "'", '"'), "literal")
        .when(has_any(t, "|"), "union")
        .otherwise("other")
    )


def counts_as_unresolved(t: Column) -> Column:
    """any, unknown or error as words, or unresolved anywhere."""
    return t.rlike(r"(^|[^A-Za-z0-9_])(any|error|unknown)([^A-Za-z0-9_]|\z)") | has_any(t, "unresolved")


def matches(expected: Column, actual: Column) -> Column:
    """Lenient comparison: equal but for white space, or a literal of the expected primitive."""
    return (
        F.when(collapse_space(expected) == collapse_space(actual), True)
        .when(expected == "number", actual.rlike(r"[0-9]\z"))
        .when(expected == "string", actual.rlike(r'(?s)^".*"\z'))
        .when(expected == "boolean", actual.isin("true", "false"))
        .otherwise(False)
    )


def promised(t: Column) -> Column:
    """t wrapped in Promise<>, unless it is."""
    return F.when(t.startswith("Promise<"), t).otherwise(F.concat(F.lit("Promise<"), t, F.lit(">")))


def signature(parameters: Column, returns: Column) -> Column:
    """`(name: type, ...) => returns` of an array of struct(name, type)."""
    return F.concat(F.lit("("), F.array_join(F.transform(parameters, lambda p: F.concat(p["name"], F.lit(": "), p["type"])), ", "), F.lit(") => "), returns)


def union_type(types: Column) -> Column:
    """An aggregate: the distinct types, sorted, joined by bars."""
    return F.array_join(F.array_sort(F.collect_set(types)), " | ")


_EXTENSION = re.compile(r"(\.d)?\.([cm]?[jt]s|[jt]sx)$")
_IMPORT = re.compile(r'import\("(?P<spec>[^"]+)"(?P<mode>,[^)]*resolution-mode[^)]*)?\)')


def imported_specifier(specifier: str, current: str | None) -> str:
    """An import's specifier as seen from a file: absolute paths and file URLs made relative, the extension dropped."""
    s = specifier.replace("\\", "/")
    if s.startswith("file://") and not urlsplit(s).netloc.strip("localhost"):
        s = unquote(urlsplit(s).path)
    if current and s.startswith("/"):
        s = posixpath.relpath(s, posixpath.dirname(current.replace("\\", "/")) or "/")
        s = s if s.startswith(".") else f"./{s}"
    return _EXTENSION.sub("", s)


def normal_type(t: str | None, current: str | None) -> str | None:
    """t with every import() normalised and resolution modes dropped."""
    return t and _IMPORT.sub(lambda m: f'import("{imported_specifier(m["spec"], current)}")', t)


@F.pandas_udf(StringType())
def _normalised(t: pd.Series, current: pd.Series) -> pd.Series:
    return pd.Series([normal_type(a, b) for a, b in zip(t, current, strict=True)], dtype=object)


def normalise(t: Column, current: Column) -> Column:
    """normal_type; only types that import anything go to Python."""
    return F.coalesce(_normalised(F.when(F.contains(t, F.lit("import(")), t), current), t)
