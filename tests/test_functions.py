"""Known answers and properties of the functions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataleaf.functions import paths, text
from strataleaf.functions import typestrings as T
from strataleaf.operators.ejs import template_code
from strataleaf.plans import cli
from strataleaf.plans.fixtures import TEMPLATES


def units(s):
    return len(s.encode("utf-16-le")) // 2


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


SFC = '<script setup>\nconst a=1;\n</script>\n<!-- c\nd --><style>p{}</style>\n<template>\n<p :x.y="1" @click="f">{{ a }}<br></p>\n</template>\n'
CLEAN = '             ;\nconst a=1;\n        ;\n      \n                       \n<template>\n<p :x.y="1"  click="f">{  a  }   ;</p>\n</template>\n'


def test_clean_component(spark):
    assert one(spark, SFC, text.clean_component) == CLEAN


def test_virtual_source(spark):
    assert one(spark, "<t>a</t>\n<script>x=1</script>", text.virtual_source) == ("        \n        x=1         ", True)
    assert one(spark, "<script a>a</script>", text.virtual_source) == ("          a         ", True)  # at its true place
    assert one(spark, "none", text.virtual_source) == ("    ", False)


def test_candidates(spark):
    got = one(spark, "<script>x=1</script>\n<template>{{a}}</template>", text.parse_candidates)
    template = "                    \n<template>{ a }</template>"
    assert [(c.name, c.code) for c in got] == [("full", "       ;x=1        ;\n<template>{ a }</template>"), ("combined", "x=1\n" + template), ("template-only", template), ("script-only", "x=1")]
    assert [c.name for c in one(spark, "<template>{{ only }}</template>", text.parse_candidates)] == ["full"]
    assert one(spark, "", text.parse_candidates) == []


_PIECES = st.lists(st.sampled_from(["<script>", "</script>", "<!--", "-->", "<style>", "</style>", "<br>", "<template>", "</template>", "{{", "}}", ":[", "]", " @x=", "a", "\n", "\r\n", " ", "\U0001f600", "é", "<img ", ' >', "'"]), max_size=25).map("".join)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_PIECES, min_size=20, max_size=20))
def test_cleaning_keeps_every_length(spark, many):
    df = spark.createDataFrame([(m,) for m in many], "v string")
    c = F.col("v")
    out = df.select(c, text.clean_component(c).alias("a"), text.clean_component(c, False).alias("b"), text.virtual_source(c)["source"].alias("s"), text.mask(c).alias("m"), text.utf16_length(c).alias("n")).collect()
    for r in out:
        assert r.n == units(r.v) == units(r.a) == units(r.b) == units(r.m) == units(r.s)
        assert [i for i, x in enumerate(r.m) if x in "\r\n"] == [i for i, x in enumerate(r.v.replace("\U0001f600", "__")) if x in "\r\n"]
        assert set(r.m) <= set(" \r\n")


def test_nth_index(spark):
    nth = lambda n: one(spark, "\U0001f600 ab xx ab", lambda c: text.nth_index(c, "ab", n))
    assert (nth(0), nth(1), nth(2)) == (3, 9, None)
    assert one(spark, "aaaa", lambda c: text.nth_index(c, "aa", 1)) == 2  # matches don't overlap
    assert one(spark, "x.y*", lambda c: text.nth_index(c, ".y*", 0)) == 1


def test_utf8_is_repaired(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "c binary")
    assert df.select(text.source_text(F.col("c")).alias("t")).first().t == "a�b"


@pytest.mark.parametrize(("source", "code"), TEMPLATES)
def test_templates(source, code):
    assert template_code(source) == code


@settings(max_examples=200)
@given(st.lists(st.sampled_from(["<%", "%>", "<%=", "-%>", "<%#", " if a ", " end ", "else", "else if b", "x", "\n", "<script>", "</script>", "include y", "\U0001f600", "for (;;)"]), max_size=20).map("".join))
def test_templates_keep_length_and_lines(source):
    out = template_code(source)
    assert units(out) == units(source)


@pytest.mark.parametrize(
    ("path", "kind", "retry"),
    [("a/b.ts", "code", True), ("a.tsx", "code", False), ("a.JSX", None, False), ("a.vue", "component", False), ("a.svelte", "component", False), ("a.ejs", "template", False), ("a.d.mts", "code", True), ("a.py", None, False), ("ts", None, False), ("a.cjs", "code", True)],
)
def test_dispatch(spark, path, kind, retry):
    assert one(spark, path, paths.dispatch) == kind
    assert one(spark, path, lambda c: paths.retries_without_jsx(c, "ts")) is retry
    assert one(spark, path, lambda c: paths.retries_without_jsx(c, "flow")) is False


def test_paths(spark):
    assert one(spark, "x+y/a.js", lambda c: paths.relative(c, "x+y")) == "a.js"
    assert one(spark, "a/foo.js", lambda c: paths.relative(c, ".")) == "a/foo.js"
    assert one(spark, "/src2/a.js", lambda c: paths.relative(c, "/src/")) == "/src2/a.js"
    assert one(spark, "m/target/scala-3.1/classes/a/B.tasty", paths.slice_key) == "m/a/B.scala"
    bundle = lambda p: one(spark, p, paths.is_bundle)
    assert bundle("a/node_modules/x/y.min.js") and bundle("node_modules/index.cjs") and not bundle("node_modules/x/lib.js") and not bundle("a/index.js")


@pytest.mark.parametrize(("t", "n"), [("", 0), ("any", 0), ("Promise<unknown>", 0), ("(a) => any", 3), ("{ a }", 2), ("A | B", 2), ('import("x").T', 2), ("string", 1)])
def test_scores(spark, t, n):
    assert one(spark, t, T.score) == n


def arguments(*tokens):
    a = cli.parse(list(tokens))
    return a.values, a.rest


def test_command_line():
    base = {"src": ".", "output": "ast_out", "recurse": True, "tsTypes": True}
    assert arguments() == (base, [])
    assert arguments("--tsTypes=false") == arguments("--no-tsTypes") == ({**base, "tsTypes": False}, [])
    assert arguments("-rfalse") == ({**base, "f": "alse"}, [])
    assert arguments("-ifoo", "bar") == ({**base, "src": "foo"}, ["bar"])
    assert arguments("--foo", "1", "--", "-x") == ({**base, "foo": "1"}, ["-x"])
    assert arguments("--ts-types", "no", "-") == ({**base, "tsTypes": False}, ["-"])
    assert arguments("-h", "--version", "-t", "vue") == ({**base, "help": True, "version": True, "type": "vue"}, [])
    with pytest.raises(ValueError, match="Invalid boolean value for --tsTypes: src"):
        arguments("--tsTypes", "src")
    with pytest.raises(ValueError, match="Missing value for -i"):
        arguments("-i")
    with pytest.raises(ValueError, match="Missing value for --src"):
        arguments("--src", "--x")


def test_project_kind(tmp_path):
    assert cli.project_kind("ts", tmp_path) == "script" and cli.project_kind("vue", tmp_path) == "component" and cli.project_kind(None, tmp_path) is None
    (tmp_path / "rush.json").write_text("{}")
    assert cli.project_kind(None, tmp_path) == "script"
    assert cli.main(["--version"]) == 0 and cli.main(["-i"]) == 1
