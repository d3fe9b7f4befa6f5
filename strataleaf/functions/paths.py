"""Paths: kinds of files, relative and output paths, artefact paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE = r"\.([cm]?[jt]s|[jt]sx|vue|svelte|ejs|xsjs|xsjslib)\z"
BUNDLE = r"node_modules/(?:.*/)?(?:[^/]*\.)?(app|bundle|dist|index|min)\.[cm]?js\z"
FIXTURE = r"\.([cm]?js|[jt]sx|ts|vue)\z"


def is_source(path: Column) -> Column:
    """Whether a path is scanned: by extension, case counting, outside node_modules."""
    return path.rlike(SOURCE) & ~F.contains(path, F.lit("node_modules"))


def is_bundle(path: Column) -> Column:
    """A bundled library inside node_modules."""
    return path.rlike(BUNDLE)


def is_typescript_without_jsx(path: Column) -> Column:
    return path.rlike(r"(?i)\.[cm]?ts\z")


def is_javascript_without_jsx(path: Column) -> Column:
    return path.rlike(r"(?i)\.[cm]?js\z")


def retries_without_jsx(path: Column, project_type: Column | str) -> Column:
    """Whether a failed parse is tried again as TypeScript without JSX: for files of neither .tsx nor .jsx, unless the project is Flow."""
    kind = F.lit(project_type) if isinstance(project_type, str) else project_type
    return ~kind.eqNullSafe(F.lit("flow")) & (is_typescript_without_jsx(path) | is_javascript_without_jsx(path))


def dispatch(path: Column) -> Column:
    """The front end of a file: 'component', 'template' or 'code'; null if it is none of ours."""
    return F.when(path.rlike(r"\.(vue|svelte)\z"), "component").when(path.rlike(r"\.ejs\z"), "template").when(path.rlike(SOURCE), "code")


def relative(path: Column, root: str) -> Column:
    """path without a literal root and its slash; unchanged if it isn't under root."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), path.substr(len(prefix) + 1, 1 << 30)).otherwise(path)


def output_path(rel: Column, out: str, suffix: str) -> Column:
    """Where a file's result goes: suffix '.json' or '.typemap'."""
    return F.concat(F.lit(out.rstrip("/") + "/"), rel, F.lit(suffix))


def slice_key(path: Column) -> Column:
    """The source file that a compiled artefact stands for."""
    bare = F.regexp_replace(path, r"^(.*?)target/scala-[^/]*/(test-)?classes/", "$1")
    return F.regexp_replace(bare, r"\.tasty\z", ".scala")
