"""Source files as tables, and the small control files around them."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataleaf.functions import paths
from strataleaf.functions.text import source_text

_EXTENSIONS = "{cjs,cts,ejs,js,jsx,mjs,mts,svelte,ts,tsx,vue,xsjs,xsjslib}"


def bundles_enabled(env: dict[str, str] | None = None) -> bool:
    """Whether bundled libraries in node_modules are scanned: asked for, or implied by a list of ignored folders without it."""
    e = os.environ if env is None else env
    ignored = e.get("STRATALEAF_IGNORE_DIRS", "")
    return e.get("STRATALEAF_BUNDLES") == "true" or (ignored != "" and "node_modules" not in ignored)


def _binary(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def _files(found: DataFrame, root: str) -> DataFrame:
    """(path, rel_path, ext, length, content) of a binary scan; content is decoded only if it is asked for."""
    path = F.regexp_replace("path", "^file:/+", "/")
    rel = paths.relative(path, root)
    return found.select(path.alias("path"), rel.alias("rel_path"), F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1)).alias("ext"), "length", source_text(F.col("content")).alias("content"))


def source_files(spark: SparkSession, root: str, bundles: bool | None = None) -> DataFrame:
    """The source files under root. The extensions are pushed into the listing."""
    files = _files(_binary(spark, root, f"*.{_EXTENSIONS}"), root)
    bundles = bundles_enabled() if bundles is None else bundles
    wanted = paths.is_source(F.col("path"))
    return files.where(wanted | paths.is_bundle(F.col("path")) if bundles else wanted)


def files_like(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Files under root by a name's pattern: '*.vue', 'routes', '*.tasty'."""
    return _files(_binary(spark, root, glob), root)


def artefacts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Files that slices are made from: route files, configuration, compiled artefacts, build files."""
    return {k: files_like(spark, root, g) for k, g in {"routes": "*routes", "config": "*.conf", "tasty": "*.tasty", "build": "build.{mill,sbt}"}.items()}


def snippets(spark: SparkSession, codes: dict[str, str]) -> DataFrame:
    """Code given as strings, as files of a project held in memory."""
    rows = [(n, n, n.rpartition(".")[2], len(c.encode()), c) for n, c in codes.items()]
    return spark.createDataFrame(rows, "path string, rel_path string, ext string, length long, content string")


def _upward(start: str | Path) -> Iterator[Path]:
    here = Path(start).resolve()
    yield from (here, *here.parents)


def read_json_if_exists(path: Path) -> object | None:
    """Parsed JSON, or None on any error: control files are optional."""
    try:
        return json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def nearest_package_json(start: str | Path) -> object | None:
    """The closest package.json upward that can be read."""
    return next((p for d in _upward(start) if (p := read_json_if_exists(d / "package.json")) is not None), None)


def find_tsconfig(start: str | Path) -> Path | None:
    """The closest tsconfig.json upward; if there is none, the closest jsconfig.json."""
    return next((d / n for n in ("tsconfig.json", "jsconfig.json") for d in _upward(start) if (d / n).is_file()), None)


def _jsonc(text: str) -> object:
    """JSON with comments and trailing commas."""
    bare = re.sub(r'("(?:[^"\\\\]|\\\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.DOTALL)
    return json.loads(re.sub(r'("(?:[^"\\\\]|\\\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare))


def read_tsconfig(path: str | Path) -> dict | None:
    """A configuration with those that it extends put under it; None if it can't be read.

    `files`, `include` and `exclude` are absolute; of each the nearest configuration that has it counts. Options are
    merged, the nearest first. One that extends itself stops there.
    """

    def read(at: Path, seen: frozenset[Path]) -> dict | None:
        try:
            own = _jsonc(at.read_text(encoding="utf-8-sig"))
        except (OSError, ValueError):
            return None
        if not isinstance(own, dict):
            return None
        out: dict = {}
        bases = own.get("extends") or []
        for base in [bases] if isinstance(bases, str) else bases:
            found = _extended(at.parent, str(base))
            if found and found not in seen:
                out |= {k: v for k, v in (read(found, seen | {found}) or {}).items() if k != "compilerOptions"} | {"compilerOptions": out.get("compilerOptions", {}) | ((read(found, seen | {found}) or {}).get("compilerOptions") or {})}
        for k in ("files", "include", "exclude"):
            if isinstance(own.get(k), list):
                out[k] = [str((at.parent / str(x)).absolute()) if not str(x).startswith("/") else str(x) for x in own[k]]
        out["compilerOptions"] = out.get("compilerOptions", {}) | (own.get("compilerOptions") or {})
        return out

    start = Path(path).absolute()
    return read(start, frozenset((start,)))


def _extended(folder: Path, name: str) -> Path | None:
    """The file that `extends` names: relative, absolute, or of an installed package."""
    if name.startswith((".", "/")):
        places = [folder / name, folder / f"{name}.json"]
    else:
        places = [d / "node_modules" / n for d in (folder, *folder.parents) for n in (name, f"{name}.json", f"{name}/tsconfig.json")]
    return next((p.resolve() for p in places if p.is_file()), None)


def glob_pattern(glob: str) -> str:
    """An include or exclude pattern as a regular expression over whole paths; a folder stands for all below it."""
    last = glob.rstrip("/").rpartition("/")[2]
    if "*" not in last and "?" not in last and "." not in last:
        glob = glob.rstrip("/") + "/**/*"
    out = ""
    for part in re.split(r"(\*\*/|\*|\?)", os.path.normpath(glob).replace("**/", "\0").replace("\0", "**/")):
        out += {"**/": "(?:[^/]+/)*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def configured_files(files: DataFrame, config: dict | None, root: str) -> DataFrame:
    """The rows of files (path, ...) that a configuration of read_tsconfig() names: `files`, and of `include` what isn't excluded.

    Without either all below root is included; without `exclude`, installed packages and the output folder are left out.
    """
    config = config or {}
    include = config.get("include", [] if "files" in config else [f"{root}/**/*"])
    out_dir = (config.get("compilerOptions") or {}).get("outDir")
    exclude = config.get("exclude", [f"{root}/**/{n}" for n in ("node_modules", "bower_components", "jspm_packages")] + ([f"{root}/{out_dir}"] if out_dir else []))
    path = F.col("path")
    named = path.isin(config.get("files", []))
    for g in include:
        taken = path.rlike(glob_pattern(g))
        for x in exclude:
            taken = taken & ~path.rlike(glob_pattern(x))
        named = named | taken
    return under_root(files.where(named), root)


def under_root(files: DataFrame, root: str) -> DataFrame:
    """Files that a configuration adds: only those below root with a script's extension."""
    return files.where(F.col("path").startswith(root) & F.col("path").rlike(r"\.([cm]?[jt]s|[jt]sx)\z"))
