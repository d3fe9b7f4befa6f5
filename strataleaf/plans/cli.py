"""Command line: options and the jobs they start."""

from __future__ import annotations

import os
import re
import shlex
import sys
from dataclasses import dataclass, field
from pathlib import Path

from strataleaf.sources import frontends

#: name: (short form, default, whether it is boolean). recurse is accepted; scans always recurse.
OPTIONS: dict[str, tuple[str | None, object, bool]] = {
    "src": ("i", ".", False),
    "output": ("o", "ast_out", False),
    "type": ("t", None, False),
    "recurse": ("r", True, True),
    "tsTypes": (None, True, True),
}
_SHORT = {short: name for name, (short, _, _) in OPTIONS.items() if short}
_TRUE, _FALSE = frozenset("1 true y yes".split()), frozenset("0 false n no".split())
SCRIPT_TYPES = frozenset("flow javascript js nodejs ts typescript".split())


@dataclass
class Arguments:
    values: dict[str, object] = field(default_factory=lambda: {k: d for k, (_, d, _) in OPTIONS.items() if d is not None})
    rest: list[str] = field(default_factory=list)


def option_name(name: str) -> str:
    """kebab-case to camelCase."""
    return re.sub("-([a-z])", lambda m: m[1].upper(), name)


def is_option(token: str | None) -> bool:
    return bool(token) and token != "-" and token.startswith("-")


def boolean(name: str, value: object) -> bool:
    if value is None:
        return True
    if isinstance(value, bool):
        return value
    low = str(value).lower()
    if low not in _TRUE | _FALSE:
        raise ValueError(f"Invalid boolean value for --{name}: {value}")
    return low in _TRUE


class _Reader:
    def __init__(self, tokens: list[str]) -> None:
        self.tokens, self.at, self.out = tokens, 0, Arguments()

    def store(self, name: str, value: object) -> None:
        name = option_name(name)
        if name in OPTIONS and OPTIONS[name][2]:
            self.out.values[name] = boolean(name, value)
        else:
            self.out.values[name] = True if value is None else value

    def operand(self) -> str | None:
        """The next token, if it isn't an option; it is used up."""
        if self.at < len(self.tokens) and not is_option(self.tokens[self.at]):
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def take(self, name: str, inline: str | None, shown: str) -> None:
        value = inline if inline is not None else self.operand()
        if value is None and name in OPTIONS and not OPTIONS[name][2]:
            raise ValueError(f"Missing value for {shown}")
        self.store(name, value)

    def long(self, token: str) -> None:
        if token.startswith("--no-"):
            self.store(token[5:].partition("=")[0], False)
            return
        name, eq, inline = token[2:].partition("=")
        self.take(option_name(name), inline if eq else None, f"--{name}")

    def short(self, token: str) -> None:
        letters, eq, inline = token[1:].partition("=")
        for i, letter in enumerate(letters):
            name, after = _SHORT.get(letter, letter), letters[i + 1 :]
            if letter == "h":
                self.out.values["help"] = True
            elif name in OPTIONS and OPTIONS[name][2]:
                self.store(name, inline if eq else None if after else self.operand())
            elif after:
                self.store(name, after)
                return
            else:
                self.take(name, inline if eq else None, f"-{letter}")

    def read(self) -> Arguments:
        while self.at < len(self.tokens):
            token = self.tokens[self.at]
            self.at += 1
            if token == "--":
                self.out.rest += self.tokens[self.at :]
                break
            if token in ("--help", "--version"):
                self.out.values[token[2:]] = True
            elif token.startswith("--"):
                self.long(token)
            elif is_option(token):
                self.short(token)
            else:
                self.out.rest.append(token)
        return self.out


def parse(tokens: list[str]) -> Arguments:
    """Options as `--x=v`, `--x v`, `--no-x`, `-xv`, clustered short ones; everything after `--` is an operand. Unknown options are kept."""
    return _Reader(tokens).read()


def project_kind(kind: str | None, root: Path) -> str | None:
    """'script' or 'component' jobs; without a known type, 'script' if the root holds a package, else None."""
    if kind in SCRIPT_TYPES:
        return "script"
    if kind == "vue":
        return "component"
    return "script" if any((root / n).is_file() for n in ("package.json", "rush.json")) else None


USAGE = """usage: strataleaf [-i SRC] [-o OUTPUT] [-t TYPE] [--tsTypes=BOOLEAN] [-h] [--version]
       strataleaf slices [-i SRC] [-o OUTPUT]
       strataleaf php|ruby ARGUMENTS...

Environment: STRATALEAF_PARSER, a command that prints a file's syntax tree as JSON ({parser} and {options} stand for the parser to
use and its options); STRATALEAF_DUMP, a command that prints what a compiled artefact holds; STRATALEAF_TIMEOUT, milliseconds a file."""


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("strataleaf").getOrCreate()


def _output(args: Arguments, root: Path) -> Path:
    output = Path(str(args.values["output"]))
    return root / output if str(output) == "ast_out" else output


def _slices(args: Arguments, root: Path) -> int:
    from strataleaf.plans.jobs import slices_from_tree

    command = shlex.split(os.environ.get("STRATALEAF_DUMP", ""))
    if not command:
        print("STRATALEAF_DUMP names no command", file=sys.stderr)
        return 1
    frontends.ensure_compiled(root)
    output = _output(args, root)
    output.mkdir(parents=True, exist_ok=True)
    print(slices_from_tree(_session(), str(root.resolve()), str(output), command, frontends.seconds(os.environ.get("STRATALEAF_TIMEOUT"))))
    return 0


def main(tokens: list[str] | None = None) -> int:
    """Scan a tree, and parse and type it where a parser is configured; or make slices; or start another language's front end."""
    tokens = sys.argv[1:] if tokens is None else tokens
    if tokens[:1] in (["php"], ["ruby"]):
        return frontends.launch(tokens[0], tokens[1:], Path(__file__).resolve().parent)
    sliced = tokens[:1] == ["slices"]
    try:
        args = parse(tokens[sliced:])
    except ValueError as bad:
        print(bad, file=sys.stderr)
        return 1
    if args.values.get("help") or args.values.get("version"):
        print(USAGE if args.values.get("help") else "0.1.0")
        return 0
    root = Path(str(args.values["src"]))
    if sliced:
        return _slices(args, root)
    kind = project_kind(args.values.get("type"), root)
    if kind is None:
        print("no package here, and no known --type", file=sys.stderr)
        return 1
    from strataleaf.plans.jobs import export_job, scan_job

    output = _output(args, root)
    command = shlex.split(os.environ.get("STRATALEAF_PARSER", ""))
    chain = [("configured", frontends.Parsers(tuple(command), args.values.get("type"), frontends.seconds(os.environ.get("STRATALEAF_TIMEOUT"))))] if command else []
    spark = _session()
    scan_job(spark, str(root.resolve()), str(output), kind, chain)
    if chain:
        export_job(spark, str(output), bool(args.values.get("tsTypes", True)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
