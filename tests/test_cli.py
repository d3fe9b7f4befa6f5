"""The command line from end to end, with commands that stand in for parsers, and the control files it reads."""

import json
import os
import sys
from pathlib import Path

import pytest

from strataleaf.plans import cli
from strataleaf.sources import files, frontends, sinks

PARSER = """
import json, sys
name, options, path = sys.argv[1:]
text = open(path).read()
if "bad" in text or (name == "primary" and "only secondary" in text):
    sys.exit("cannot read it as " + name)
literal = {"type": "StringLiteral", "start": 10, "value": name + " " + json.loads(options)["sourceType"]}
print(json.dumps({"type": "File", "program": {"type": "Program", "body": [{"type": "VariableDeclaration", "kind": "const", "declarations": [{"type": "VariableDeclarator", "start": 6, "id": {"type": "Identifier", "start": 6, "name": "x"}, "init": literal}]}]}}))
"""


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "p"
    for name, text in {"package.json": "{}", "a.js": "const x = 's'", "lib/b.ts": "// only secondary", "bad.js": "bad", "tests/kept.spec.ts": "const x = 's'", "other/left.test.ts": "x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (tmp_path / "parser.py").write_text(PARSER)
    return root


def test_trees_and_types_of_a_tree(spark, project, tmp_path, monkeypatch):
    monkeypatch.setenv("STRATALEAF_PARSER", f"{sys.executable} {tmp_path / 'parser.py'} {{parser}} '{{options}}'")
    assert cli.main(["-i", str(project), "-o", str(tmp_path / "out"), "-t", "ts"]) == 0
    out = tmp_path / "out"
    doc = json.loads((out / "a.js.json").read_text())
    assert set(doc) == {"fullName", "relativeName", "ast"} and doc["relativeName"] == "a.js" and doc["ast"]["type"] == "File"
    assert json.loads((out / "a.js.typemap").read_text()) == {"6": "string", "10": "string"}
    retried = json.loads((out / "lib/b.ts.json").read_text())
    assert retried["ast"]["program"]["body"][0]["declarations"][0]["init"]["value"] in ("without-jsx unambiguous", "secondary unambiguous")
    assert not (out / "bad.js.json").exists()
    assert [r.path.rpartition("/")[2] for r in spark.read.parquet(f"{out}/failures").collect()] == ["bad.js"]
    assert cli.main(["-i", str(project), "-o", str(tmp_path / "bare"), "-t", "ts", "--no-tsTypes"]) == 0
    assert (tmp_path / "bare/a.js.json").exists() and not (tmp_path / "bare/a.js.typemap").exists()


def test_slices_of_a_tree(spark, tmp_path, monkeypatch):
    root = tmp_path / "s"
    (root / "conf").mkdir(parents=True)
    (root / "A.tasty").write_bytes(b"x")
    (root / "conf/routes").write_text("GET /a controllers.A.b()\n")
    dump = "Names (1 bytes):\n0: abc\nTrees (1 bytes):\n1: X [f[Signed Signature(List(slick.jdbc.X),java.lang.String) @f]]\nPositions (1 bytes):\nsource paths:\n0: 5 [app/A.scala]\n"
    (tmp_path / "dump.py").write_text(f"print({dump!r})")
    monkeypatch.setenv("STRATALEAF_DUMP", f"{sys.executable} {tmp_path / 'dump.py'}")
    assert cli.main(["slices", "-i", str(root), "-o", str(tmp_path / "out")]) == 0
    got = json.loads((tmp_path / "out/slices.json").read_text())
    assert got["app/A.scala"]["usedTypes"] == ["slick.jdbc.X"] and got["app/A.scala"]["tags"] == ["database"]
    assert [(r["method"], r["pattern"]) for r in got["config"]["routes"]] == [("GET", "/a")]
    monkeypatch.setenv("STRATALEAF_DUMP", "")
    assert cli.main(["slices", "-i", str(root)]) == 1


def test_other_languages_are_launched(tmp_path, monkeypatch):
    tool = tmp_path / "tool.py"
    tool.write_text("import sys; sys.exit(len(sys.argv))")
    monkeypatch.setenv("PHP_PARSER_BIN", str(tool))
    monkeypatch.setenv("PHP_CMD", sys.executable)
    assert cli.main(["php", "-x", "y"]) == 3
    monkeypatch.setenv("PHP_PARSER_BIN", str(tmp_path / "absent"))
    assert cli.main(["php"]) == 1


def test_option_sets():
    assert frontends.option_set("a.ts") == {"plugins": ["typescript"], "dts": False, "sourceType": "unambiguous", "allow": ["importExportEverywhere", "awaitOutsideFunction", "returnOutsideFunction", "newTargetOutsideFunction", "superOutsideMethod", "undeclaredExports"], "errorRecovery": True}
    assert frontends.option_set("a.d.ts")["dts"] and not frontends.option_set("a.js")["dts"]
    assert frontends.option_set("a.js")["plugins"] == ["typescript", "jsx"] and frontends.option_set("a.js", jsx=False)["plugins"] == ["typescript"]
    safe = frontends.option_set("a.ts", flow=True, safe=True)
    assert safe["sourceType"] == "module" and "jsx" in safe["plugins"] and safe["plugins"][-1][0] == "flow" and len(safe["allow"]) == 3


def test_tsconfig(spark, tmp_path):
    root = tmp_path / "t"
    for name in ("src/a.ts", "src/deep/b.tsx", "src/skip/c.ts", "one.ts", "node_modules/m/x.ts", "dist/y.js", "note.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    (root / "base.json").write_text('{"compilerOptions": {"strict": true, "outDir": "dist"}, "exclude": ["src/skip"]}')
    (root / "tsconfig.json").write_text('{ // a comment, with a "quote"\n "extends": "./base", "compilerOptions": {"module": "CommonJS", "strict": false,}, "files": ["one.ts"], "include": ["src"], }')
    config = files.read_tsconfig(root / "tsconfig.json")
    assert config["compilerOptions"] == {"strict": False, "outDir": "dist", "module": "CommonJS"}
    paths = spark.createDataFrame([(str(p),) for p in root.rglob("*") if p.is_file()], "path string")
    names = lambda c: sorted(str(Path(r.path).relative_to(root)) for r in files.configured_files(paths, c, str(root)).collect())
    assert names(config) == ["one.ts", "src/a.ts", "src/deep/b.tsx"]
    assert names({"compilerOptions": {"outDir": "dist"}}) == ["one.ts", "src/a.ts", "src/deep/b.tsx", "src/skip/c.ts"]
    assert frontends.compiler_options(None, set(), config)["module"] == "CommonJS"
    (root / "loop.json").write_text('{"extends": "./loop.json"}')
    assert files.read_tsconfig(root / "loop.json") == {"compilerOptions": {}} and files.read_tsconfig(root / "absent.json") is None


def test_reports(spark):
    results = spark.createDataFrame([("b", False, "m"), ("a", True, None)], "name string, passed boolean, message string")
    doc = json.loads(sinks.report_document(results).first().document)
    assert doc["summary"] == {"total": 2, "passed": 1, "failed": 1, "passRate": 50.0} and [r["name"] for r in doc["results"]] == ["a", "b"]
    metrics = spark.createDataFrame([(4, None)], "total int, rate double")
    assert [r.line for r in sinks.report_lines(metrics, "Types").orderBy("line_no").collect()] == ["Types", "=====", "total: 4", "rate: -"]


def test_sorted_lists(spark):
    from strataleaf.operators import relational

    a, b = (spark.createDataFrame([(x,) for x in xs], "path string") for xs in ("cb", "ab"))
    assert [r.path for r in relational.union_distinct(a, b, order=["path"]).collect()] == ["a", "b", "c"]
    assert [r.path for r in relational.anti_merge(a, b, "path", order=["path"]).collect()] == ["a", "b", "c"]
    assert os.sep == "/"
