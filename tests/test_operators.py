"""Operators against sequential simulations, and sources, sinks, front ends and streams on small trees."""

import json
import random
import sys

import pytest
from pyspark.sql import functions as F

from strataleaf.operators import relational as R
from strataleaf.operators import tree, typemap
from strataleaf.plans import jobs
from strataleaf.sources import files, frontends, sinks
from strataleaf.streaming import ingest

COLUMNS = "relative_name string, offset int, type string, seq int, mode string"
TYPES = ["error", "unknown", "Promise<any>", "any[]", "any", "string", "number", "boolean", "() => void", "(a: number) => string", "{ a: 1 }", "A | B", "", "\"\U0001f600\"", "\"abc\""]


def simulate(candidates):
    """One candidate after another, as a walk would add them."""
    unresolved = set("error,any,any[],/*unresolved*/ any,unknown,unknown[]".split(","))
    rank = lambda t: 0 if not t or t in unresolved | {"Promise<any>", "Promise<unknown>"} else 3 if "=>" in t else 2 if any(x in t for x in ("import(", "{", "|")) else 1
    out = {}
    for name, offset, t, _, mode in sorted(candidates, key=lambda c: c[3]):
        key = (name, offset)
        if offset < 0 or not t:
            continue
        if mode == "overwrite":
            if t != "any":
                out[key] = t
        elif t not in unresolved:
            old = out.get(key)
            size = lambda x: len(x.encode("utf-16-le"))
            if old is None or (rank(t), size(t)) >= (rank(old), size(old)):
                out[key] = t
    return out


@pytest.mark.parametrize("seed", range(3))
def test_arbitration(spark, seed):
    r = random.Random(seed)
    rows = [(f"f{r.randint(0, 3)}", r.randint(-1, 40), r.choice(TYPES), i, r.choice(["scored"] * 5 + ["overwrite"])) for i in range(2000)]
    want = simulate(rows)
    r.shuffle(rows)
    for parts in (1, 7):
        got = typemap.arbitrate(spark.createDataFrame(rows, COLUMNS).repartition(parts)).collect()
        assert {(x.relative_name, x.offset): x.type for x in got} == want


def test_walk():
    doc = {"start": 0, "loc": {"type": "no"}, "type": "File", "body": [{"type": "A", "x": {"type": "B"}}, [None, {"type": "C", "n": 1}], {"type": 3, "y": {"type": "D"}}]}
    got = list(tree.walk(doc))
    assert [(n["type"], n["parent_id"], n["depth"]) for n in got] == [("File", None, 0), ("A", 0, 1), ("B", 1, 2), ("C", 0, 1), ("D", 0, 1)]
    deep = None
    for _ in range(5000):
        deep = {"type": "N", "c": deep}
    assert sum(1 for _ in tree.walk(deep)) == 5000


def test_walk_total_is_sum_of_histogram(spark):
    docs = spark.createDataFrame([("a", '{"type":"X","c":[{"type":"Y"},{"type":"Y"}]}'), ("b", "oops"), ("c", None)], "relative_name string, ast_json string")
    n = tree.nodes(docs)
    hist = tree.type_histogram(n)
    assert sorted((r.type, r.n) for r in hist.collect()) == [("X", 1), ("Y", 2)]
    assert tree.total_nodes(hist).first().total_nodes == n.count() == 3
    assert tree.shape_snapshot(hist).first().node_type_counts == {"X": 1, "Y": 2}
    assert [(r.path, r.stage) for r in tree.malformed(docs).collect()] == [("b", "tree")]


def _some_tree(r, deep=0):
    """JSON of any shape: objects without types, types that aren't strings, positions, repeated keys, arrays in arrays."""
    kind = r.random()
    if deep > 5 or kind < 0.25:
        return r.choice(["null", "1", "0.5", "true", '"x"', "[]", "{}", '{"type":"Leaf"}', '{"type":"Leaf","text":"é \\" }"}', '{"type":"Other","n":1}', '{"line":3}'])
    if kind < 0.5:
        return "[" + ",".join([_some_tree(r, deep + 1) for _ in range(r.randint(0, 5))]) + "]"
    if kind < 0.6:
        return "[" + ",".join([r.choice(['{"type":"Leaf"}', '{"type":"Other","v":null}'])] * r.randint(0, 9)) + "]"
    keys = r.choices(["type", "loc", "start", "end", "body", "x", "x"], k=r.randint(0, 6))
    value = lambda k: r.choice(['"A"', '"Leaf"', '"B"', "7", '{"type":"T"}', '""']) if k == "type" else _some_tree(r, deep + 1)
    return "{" + ",".join(f'"{k}":{value(k)}' for k in keys) + "}"


def test_tallies_are_nodes_grouped(spark):
    r = random.Random(5)
    docs = [(f"d{i % 150}", _some_tree(r)) for i in range(200)] + [("null", None), ("bad", "{"), ("too deep", "[" * 200_000), (None, '{"type":"A"}'), ("scalar", "3")]
    df = spark.createDataFrame(docs, "relative_name string, ast_json string").repartition(3)
    want = tree.nodes(df).groupBy("relative_name", "type", "depth").agg(F.count("*").alias("n"), F.sum("ordinal").alias("places"))
    got = tree.tallies(df)
    assert got.schema.simpleString() == "struct<relative_name:string,type:string,depth:int,n:bigint,places:bigint>"
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 200


def test_tally_reads_as_deep_as_the_reader():
    nested = lambda n: '{"type":"N","c":' * n + "null" + "}" * n
    low, high = 1, 200_000
    while high - low > 1:
        mid = (low + high) // 2
        try:
            json.loads(nested(mid))
            low = mid
        except RecursionError:
            high = mid
    for n in range(max(1, low - 5), low):
        assert len(tree.tally(tree._read_to_count(nested(n)))) == n


def test_nodes_are_the_walk(spark):
    r = random.Random(6)
    docs = {f"d{i}": _some_tree(r) for i in range(100)} | {"wide": json.dumps({"type": "File", "c": [{"type": "W", "start": i, "s": "é", "f": 0.5, "none": None} for i in range(50_001)]})}
    got = {}
    for x in tree.nodes(spark.createDataFrame([*docs.items()], "relative_name string, ast_json string")).collect():
        got.setdefault(x.relative_name, []).append({k: v for k, v in x.asDict().items() if k != "relative_name"})
    want = {k: [n | {"attrs": dict(n["attrs"])} for n in tree.walk(json.loads(v))] for k, v in docs.items()}
    assert got == {k: v for k, v in want.items() if v}


def test_enclosing_functions_and_callees(spark):
    doc = {"type": "FunctionDeclaration", "body": {"type": "Block", "c": [{"type": "ReturnStatement"}, {"type": "ArrowFunctionExpression", "b": {"type": "ReturnStatement"}}]}}
    assert tree.enclosing_function(doc) == {0: None, 1: 0, 2: 0, 3: 0, 4: 3}
    name = lambda at: {"start": at, "type": "Identifier"}
    call = json.dumps({"type": "CallExpression", "callee": name(4), "arguments": [name(9)]})
    n = tree.nodes(spark.createDataFrame([("a", call)], "relative_name string, ast_json string"))
    assert [r.offset for r in tree.callee_offsets(n).collect()] == [4]
    types = spark.createDataFrame([("a", 1, "number"), ("a", 1, "Foo"), ("a", 1, "Foo")], "relative_name string, function_id int, type string")
    assert tree.return_types(types).first().type == "Promise<Foo | number>"


def test_first_visit():
    shared = {"l": 1}
    cyclic = {"p": shared, "q": shared}
    cyclic["self"] = cyclic
    assert tree.FirstVisit().dumps(cyclic) == '{"p":{"l":1}}' and tree.FirstVisit().dumps([shared, shared]) == '[{"l":1},null]'


def test_relational_edges(spark):
    scan = spark.createDataFrame([("a",), ("b",)], "k string")
    extra = spark.createDataFrame([("b",), ("c",), (None,)], "k string")
    assert sorted(str(r.k) for r in R.anti_merge(scan, extra, "k").collect()) == ["None", "a", "b", "c"]
    before = spark.createDataFrame([("a", 1), ("b", None), ("c", None)], "k string, v int")
    after = spark.createDataFrame([("a", 1), ("b", None), ("d", None)], "k string, v int")
    assert sorted(r.k for r in R.snapshot_diff(before, after, ["k"], "v").collect()) == ["c", "d"]
    lines = R.file_lines(spark.createDataFrame([("f", "a\r\n\n b ")], "file string, content string"))
    assert [(r.line_no, r.line) for r in lines.orderBy("line_no").collect()] == [(0, "a"), (1, ""), (2, "b")]


def test_window_and_aggregate_share_one_shuffle(spark):
    c = spark.createDataFrame([("f", 1, "string", 0, "scored")], COLUMNS)
    plan = typemap.arbitrate(c)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.fixture
def project(tmp_path):
    for name, body in {
        "package.json": '{"type": "module"}', "a.ts": "let x = 1", "sub/b.vue": "<script>y</script>", "sub/c.ejs": "<% if a %>", "sub/skip.py": "no", "D.TS": "case counts",
        "node_modules/m/index.js": "1", "node_modules/m/other.js": "2", "tsconfig.json": "{}", "conf/routes": "GET /a c.A.x\n", "build.sbt": 'val scala = "3.3.1"',
    }.items():
        to = tmp_path / name
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text(body)
    return tmp_path


def test_sources(spark, project):
    root = str(project)
    names = lambda df: sorted(r.rel_path for r in df.collect())
    assert names(files.source_files(spark, root, bundles=False)) == ["a.ts", "sub/b.vue", "sub/c.ejs"]
    assert names(files.source_files(spark, root, bundles=True)) == ["a.ts", "node_modules/m/index.js", "sub/b.vue", "sub/c.ejs"]
    assert names(files.files_like(spark, root, "*.vue")) == ["sub/b.vue"]
    found = files.artefacts(spark, root)
    assert names(found["routes"]) == ["conf/routes"] and names(found["build"]) == ["build.sbt"]
    assert files.find_tsconfig(project / "sub") == project / "tsconfig.json"
    assert files.nearest_package_json(project / "sub") == {"type": "module"} and files.read_json_if_exists(project / "a.ts") is None
    assert files.bundles_enabled({"STRATALEAF_IGNORE_DIRS": "x"}) and files.bundles_enabled({"STRATALEAF_BUNDLES": "true"})
    assert not files.bundles_enabled({}) and not files.bundles_enabled({"STRATALEAF_IGNORE_DIRS": "a,node_modules"})
    extra = files.snippets(spark, {f"{root}/a.ts": "", "/other/x.ts": "", f"{root}/r.json": ""})
    assert [r.path for r in files.under_root(extra, root).collect()] == [f"{root}/a.ts"]


def test_scan_job(spark, project, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))

    def parser(path, code):
        if path.endswith(".ejs"):
            raise ValueError("no templates")
        return json.dumps({"type": "File", "program": {"type": "Program", "text": code}})

    jobs.scan_job(spark, str(project), out, chain=[("p", parser)])
    assert sorted(r.relative_name for r in spark.read.parquet(f"{out}/ast_nodes").where("type = 'Program'").collect()) == ["a.ts", "sub/b.vue"]
    bad = spark.read.parquet(f"{out}/failures").collect()
    assert [(r.path.endswith("c.ejs"), r.stage, r.message) for r in bad] == [(True, "parse", "p: no templates")]


def test_sinks(spark, tmp_path):
    trees = spark.createDataFrame([("/p/a.js", "a.js", '{"type":"File"}'), ("/p/s/b.js", "s/b.js", "{}")], "full_name string, relative_name string, ast_json string")
    assert sinks.export(sinks.ast_documents(trees), str(tmp_path), ".json") == 2
    written = json.loads((tmp_path / "a.js.json").read_text())
    assert written == dict(fullName="/p/a.js", relativeName="a.js", ast={"type": "File"})
    types = spark.createDataFrame([("a.js", 10, 'q"'), ("a.js", 9, "string")], "relative_name string, offset int, type string")
    assert sinks.typemap_documents(types).first().document == '{"9":"string","10":"q\\""}'
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        sinks.typemap_documents(types.union(types)).collect()
    at = str(tmp_path / "snapshot")
    shape = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert sinks.snapshot_or_compare(shape, at, ["k"], "n") is None
    assert [r.k for r in sinks.snapshot_or_compare(shape.where("k = 'a'"), at, ["k"], "n").collect()] == ["b"]


def test_front_ends(spark, tmp_path):
    assert frontends.parse_order("ts", "ts", True) == ["primary", "without-jsx", "secondary", "safe", "safe-flow", "hermes"]
    assert frontends.parse_order("js", "flow", False) == ["hermes", "secondary", "primary", "safe", "safe-flow", "hermes"]
    assert frontends.parser_options("a.d.mts") == {"plugins": ["typescript"], "dts": True} and frontends.parser_options("a.js", flow=True) == {"plugins": ["flow", "jsx"], "dts": False}
    assert frontends.merge_plugins(["a", ("b", {"x": 1})], ["b", "c", "a"]) == ["a", ("b", {"x": 1}), "c"]
    assert frontends.compiler_options({"type": "module"}, set())["module"] == "NodeNext" and frontends.compiler_options(None, {"mts"}, {"compilerOptions": {"module": "X"}})["module"] == "X"
    assert frontends.seconds("1500") == 1.5 and frontends.seconds("x") is None and frontends.seconds(None) is None
    shout = frontends.Command((sys.executable, "-c", "import sys; print(open(sys.argv[1]).read().upper(), end='')"))
    fail = frontends.Command((sys.executable, "-c", "import sys; sys.exit('bad')"))
    src = files.snippets(spark, {"a.js": "x", "b.js": ""})
    got = {r.path: (r.result, r.front_end, r.message) for r in frontends.parse(src, [("fail", fail), ("shout", shout)]).collect()}
    assert got["a.js"] == ("X", "shout", None) and got["b.js"][0] is None and "no output" in got["b.js"][2]
    file = tmp_path / "d.tasty"
    file.write_text("dump")
    dumped = frontends.command_on_paths(spark.createDataFrame([(str(file),), ("/absent",)], "path string"), ["cat"])
    assert {r.path: r.result for r in dumped.collect()} == {str(file): "dump", "/absent": None}
    assert [r.path for r in frontends.failures(dumped).collect()] == ["/absent"]
    primary = spark.createDataFrame([("a.js", "t")], "path string, type string")
    both = frontends.types_with_fallback(primary, lambda rest: rest.select("path", F.lit("virtual").alias("type")), src)
    assert sorted((r.path, r.type) for r in both.collect()) == [("a.js", "t"), ("b.js", "virtual")]


def test_launchers(tmp_path):
    assert frontends.launcher("php", tmp_path, {}) is None
    tool = tmp_path / "plugins" / "bin" / "ruby-parse"
    tool.parent.mkdir(parents=True)
    tool.write_text("")
    assert frontends.launcher("ruby", tmp_path, {"RUBY_HOME": "/r"}) == ["/r/bin/ruby", str(tool)]
    assert frontends.launcher("php", tmp_path, {"PHP_PARSER_BIN": str(tool), "PHP_CMD": "php8"}) == ["php8", str(tool)]
    ran = []
    assert not frontends.ensure_compiled(tmp_path, {}, lambda argv, **_: ran.append(argv)) and ran == [["sbt", "compile"]]
    (tmp_path / "x.tasty").write_text("")
    assert frontends.ensure_compiled(tmp_path, {}, lambda *_, **__: 1 / 0)


def test_incremental_ingestion(spark, project, tmp_path_factory):
    out, mark = str(tmp_path_factory.mktemp("table")), str(tmp_path_factory.mktemp("mark"))
    run = lambda: ingest.ingest(ingest.incoming(spark, str(project)), out, mark).awaitTermination()
    run()
    assert spark.read.parquet(out).count() == 3
    (project / "new.ts").write_text("n")
    run()
    assert sorted(r.content for r in spark.read.parquet(out).select("content").collect()) == ["<% if a %>", "<script>y</script>", "let x = 1", "n"]
    counts = ingest.windowed_counts(ingest.incoming(spark, str(project)), window="1 hour").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.table("counts").agg(F.sum("files")).first()[0] == 4


def test_slice_and_type_jobs(spark, tmp_path):
    from strataleaf.plans import fixtures as X

    dumps = spark.createDataFrame(X.DUMPS, "dump string, file_ord int, content string")
    jobs.slice_job(dumps, spark.createDataFrame(X.ROUTES, "file_ord int, content string"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/slices")).count() == 3 and spark.read.parquet(str(tmp_path / "s/routes")).count() == 13
    c = spark.createDataFrame([x[1:] for x in X.CANDIDATES], COLUMNS)
    jobs.type_job(c, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/typemap")).count() == 11
