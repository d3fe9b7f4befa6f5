"""Front ends: parsers and checkers that run outside of Spark, behind a partition-level interface.

A front end is a function from a file's (path, text) to a result, or a command that reads a file and
prints one. Failures never end a job: they become rows of a side table. A chain of front ends is tried
in order inside one Python call, so a later one runs only if the earlier ones failed.
"""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FrontEnd = Callable[[str, str], str]
PARSED = "path string, result string, front_end string, stage string, message string"
#: Most bytes of output that are taken from a child process.
MAX_OUTPUT = 100 * 1024 * 1024


def parse_order(ext: str, project_type: str, retry_without_jsx: bool) -> list[str]:
    """The parsers that a code file is given to, in order. Flow projects try Hermes first and swap the two main ones."""
    flow = project_type == "flow"
    main = ["secondary", "primary"] if flow else ["primary", "secondary"]
    first = ["hermes"] if flow and ext in ("js", "jsx", "cjs", "mjs") else []
    return [*first, main[0], *(["without-jsx"] if retry_without_jsx else []), main[1], "safe", "safe-flow", "hermes"]


def parser_options(path: str, flow: bool = False) -> dict[str, object]:
    """What a parser must be told about a file: JSX unless it is TypeScript without, types unless Flow, and declaration files."""
    low = path.lower()
    plain_ts = low.endswith((".ts", ".mts", ".cts"))
    plugins = ["flow" if flow else "typescript", *([] if plain_ts else ["jsx"])]
    return {"plugins": plugins, "dts": low.endswith((".d.ts", ".d.mts", ".d.cts"))}


def option_set(path: str, flow: bool = False, safe: bool = False, jsx: bool | None = None) -> dict[str, object]:
    """All that a parser is told about a file, in one of four sets: with TypeScript's or Flow's types, lenient or safe.

    JSX unless the file is TypeScript without, or jsx says otherwise; declaration files are marked. The
    lenient sets let a file be script or module and allow what is only legal in some place; the safe ones
    take modules, and allow imports, awaits and returns anywhere.
    """
    own = parser_options(path)
    legacy = ["optionalChaining", "classProperties", "decorators-legacy", "exportDefaultFrom", "doExpressions", "numericSeparator", "dynamicImport"]
    types: list[str | tuple[str, dict]] = [*legacy, "jsx", ("flow", {"all": True, "enums": True})] if flow else ["typescript"]
    allowed = ["importExportEverywhere", "awaitOutsideFunction", "returnOutsideFunction", *([] if safe else ["newTargetOutsideFunction", "superOutsideMethod", "undeclaredExports"])]
    with_jsx = flow or ("jsx" in own["plugins"] if jsx is None else jsx)
    return {
        "plugins": merge_plugins(types, ["jsx"] if with_jsx else []),
        "dts": not flow and own["dts"],
        "sourceType": "module" if safe else "unambiguous",
        "allow": allowed,
        "errorRecovery": True,
    }


def retry_without_jsx(path: str, project_type: str | None) -> bool:
    """Whether code that may be TypeScript, or be no JSX, deserves another try without JSX: `<T>x` reads as a tag with it."""
    return project_type != "flow" and not path.lower().endswith((".tsx", ".jsx"))


def merge_plugins(*groups: Sequence[str | tuple[str, dict]]) -> list[str | tuple[str, dict]]:
    """Plugins of all groups; of one name the first."""
    seen: dict[str, str | tuple[str, dict]] = {}
    for p in (p for g in groups for p in g):
        seen.setdefault(p if isinstance(p, str) else p[0], p)
    return list(seen.values())


def compiler_options(package: dict | None, extensions: set[str], config: dict | None = None) -> dict[str, object]:
    """Options of a type program: node-style modules where the package or its files call for them, unless configured; five are forced."""
    own = (config or {}).get("compilerOptions", {})
    modern = bool(package and (package.get("type") == "module" or "exports" in package or "imports" in package)) or bool(extensions & {"mts", "cts"})
    chosen = {"module": "NodeNext", "moduleResolution": "NodeNext"} if modern else {"module": "ESNext", "moduleResolution": "Node"}
    return chosen | own | {"allowJs": True, "checkJs": True, "noEmit": True, "skipLibCheck": True, "resolveJsonModule": True}


def first_result(chain: Sequence[tuple[str, FrontEnd]], path: str, text: str) -> tuple[str | None, str | None, str | None]:
    """(result, name of the front end, None) of the first that succeeds, else (None, None, the last failure)."""
    message = "no front end"
    for name, f in chain:
        try:
            return f(path, text), name, None
        except Exception as bad:  # noqa: BLE001 - whatever a parser throws is a row, not the end of the job
            message = f"{name}: {bad}"
    return None, None, message


def parse(files: DataFrame, chain: Sequence[tuple[str, FrontEnd]], stage: str = "parse") -> DataFrame:
    """PARSED of files (path, content): a result, or a message. Rows are whole files, so batches are small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *first_result(chain, p, t or "")) for p, t in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame([(p, r, n, stage if m else None, m) for p, r, n, m in rows], columns=["path", "result", "front_end", "stage", "message"])

    return files.select("path", "content").mapInPandas(run, PARSED)


def parse_components(candidates: DataFrame, chain: Sequence[tuple[str, FrontEnd]]) -> DataFrame:
    """PARSED of components (path, candidates: array of struct(pos, name, code)): the first candidate that parses.

    front_end is the candidate's name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, tries in zip(pdf["path"], pdf["candidates"], strict=True):
                result, name, message = None, None, "nothing to parse"
                for c in sorted(tries if tries is not None else [], key=lambda c: c["pos"]):
                    result, _, message = first_result(chain, path, c["code"])
                    if result is not None:
                        name = c["name"]
                        break
                rows.append((path, result, name, "parse" if message else None, message))
            yield pd.DataFrame(rows, columns=["path", "result", "front_end", "stage", "message"])

    return candidates.select("path", "candidates").mapInPandas(run, PARSED)


def types_with_fallback(primary: DataFrame, fallback: Callable[[DataFrame], DataFrame], files: DataFrame) -> DataFrame:
    """primary (path, ...), and for the files without a row there what fallback makes of them: it runs on those alone."""
    missing = files.join(primary.select("path"), "path", "left_anti")
    return primary.unionByName(fallback(missing))


@dataclass(frozen=True)
class Command:
    """A command that is run on one file at a time, in an executor."""

    argv: tuple[str, ...]
    timeout: float | None = None
    max_output: int = MAX_OUTPUT

    def __call__(self, path: str, text: str) -> str:
        """What the command prints about the text, which it finds in a file of path's name. A nonzero status with output counts as success; of its complaints 2,000 characters are kept."""
        with tempfile.TemporaryDirectory() as folder:
            file = Path(folder) / Path(path).name
            file.write_text(text, encoding="utf-8")
            done = subprocess.run([*self.argv, str(file)], capture_output=True, timeout=self.timeout, check=False)
        if len(done.stdout) > self.max_output:
            raise ValueError(f"more than {self.max_output} bytes of output")
        if not done.stdout:
            raise ValueError(done.stderr.decode("utf-8", "replace")[:2000] or f"status {done.returncode}, no output")
        return done.stdout.decode("utf-8", "replace")


@dataclass(frozen=True)
class Parsers:
    """One command with many parsers: each file is given to those of parse_order, in order, until one succeeds.

    In argv, {parser} stands for the parser's name and {options} for its options as JSON; without either there is
    nothing to vary, and the command is tried once.
    """

    argv: tuple[str, ...]
    project_type: str | None = None
    timeout: float | None = None

    def __call__(self, path: str, text: str) -> str:
        if not any("{parser}" in a or "{options}" in a for a in self.argv):
            return Command(self.argv, self.timeout)(path, text)
        ext = path.rpartition(".")[2].lower()
        chain: list[tuple[str, FrontEnd]] = []
        for name in dict.fromkeys(parse_order(ext, self.project_type or "", retry_without_jsx(path, self.project_type))):
            flow = name in ("secondary", "safe-flow")
            options = json.dumps(option_set(path, flow, name.startswith("safe"), False if name == "without-jsx" else None))
            chain.append((name, Command(tuple(a.replace("{parser}", name).replace("{options}", options) for a in self.argv), self.timeout)))
        result, _, message = first_result(chain, path, text)
        if result is None:
            raise ValueError(message)
        return result


def command_on_paths(paths: DataFrame, command: Sequence[str], timeout: float | None = None, max_output: int = MAX_OUTPUT) -> DataFrame:
    """PARSED of paths (path) on a file system that executors share: each file's command output, as a compiler's dump."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    done = subprocess.run([*command, path], capture_output=True, timeout=timeout, check=False)
                    out = done.stdout[: max_output + 1]
                    if len(out) > max_output:
                        raise ValueError(f"more than {max_output} bytes of output")
                    bad = None if out else done.stderr.decode("utf-8", "replace")[:2000] or f"status {done.returncode}, no output"
                    rows.append((path, out.decode("utf-8", "replace") if out else None, command[0], "dump" if bad else None, bad))
                except (OSError, ValueError, subprocess.SubprocessError) as bad:
                    rows.append((path, None, command[0], "dump", str(bad)))
            yield pd.DataFrame(rows, columns=["path", "result", "front_end", "stage", "message"])

    return paths.select("path").mapInPandas(run, PARSED)


def failures(parsed: DataFrame) -> DataFrame:
    """(path, stage, message) of what didn't parse."""
    return parsed.where(F.col("message").isNotNull()).select("path", "stage", "message")


def seconds(value: str | None) -> float | None:
    """A timeout in milliseconds from the environment, as seconds; None if it isn't a positive number."""
    try:
        ms = float(value) if value else 0.0
    except ValueError:
        return None
    return ms / 1000 if ms > 0 else None


def launcher(kind: str, here: Path, env: dict[str, str] | None = None) -> list[str] | None:
    """The command of the PHP or Ruby front end: named by the environment, installed here, or by a parent; None if there is none."""
    e = os.environ if env is None else env
    if kind == "php":
        named, tool, runtime = e.get("PHP_PARSER_BIN"), "php-parse", [e.get("PHP_CMD", "php")]
    else:
        named, tool = e.get("RUBY_PARSER_BIN"), "ruby-parse"
        runtime = [str(Path(e["RUBY_HOME"]) / "bin" / "ruby") if e.get("RUBY_HOME") else e.get("RUBY_CMD", "ruby")]
    places = [Path(named)] if named else [here / "plugins" / "bin" / tool, *(d / "node_modules" / ".bin" / tool for d in here.parents)]
    found = next((p for p in places if p.is_file()), None)
    return [*runtime, str(found)] if found else None


def ensure_compiled(root: Path, env: dict[str, str] | None = None, run: Callable[..., object] = subprocess.run) -> bool:
    """Whether compiled artefacts exist under root; if none do, one build is tried, on the driver, before a job starts."""
    e = os.environ if env is None else env
    if next(root.rglob("*.tasty"), None):
        return True
    build = [e.get("MILL_CMD", "mill"), "__.compile"] if (root / "build.mill").is_file() else [e.get("SBT_CMD", "sbt"), "compile"]
    try:
        run(build, cwd=root, timeout=seconds(e.get("STRATALEAF_TIMEOUT")), check=False, capture_output=True)
    except (OSError, subprocess.SubprocessError):
        return False
    return next(root.rglob("*.tasty"), None) is not None


def launch(kind: str, arguments: Sequence[str], here: Path, env: dict[str, str] | None = None) -> int:
    """Run the PHP or Ruby front end with arguments passed on, on this machine's terminal; its status, 1 if there is none."""
    e = os.environ if env is None else env
    command = launcher(kind, here, dict(e))
    if command is None:
        return 1
    try:
        return subprocess.run([*command, *arguments], check=False, timeout=seconds(e.get("STRATALEAF_TIMEOUT")), env=None if env is None else {**os.environ, **env}).returncode
    except (OSError, subprocess.SubprocessError):
        return 1
