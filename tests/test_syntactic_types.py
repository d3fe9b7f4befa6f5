"""Types from syntax: every rule of the authored tree, scopes, depth, and trees that make no sense."""

import json

import pytest

from strataleaf.operators import syntactic_types as S
from strataleaf.operators import tree
from strataleaf.plans import fixtures as X


def at(found, position):
    return [t for o, t, _ in found if o == position]


FOUND = list(S.emitted(json.loads(X.RULES_TREE)))


@pytest.mark.parametrize(("rule", "position", "want"), X.RULES, ids=[f"{r}-{p}" for r, p, _ in X.RULES])
def test_rules(rule, position, want):
    assert want in at(FOUND, position)


def test_names_that_lead_to_themselves_have_no_type():
    names = {"p1", "p2"}
    for d in json.loads(X.RULES_TREE)["program"]["body"]:
        if d.get("declarations") and isinstance(d["declarations"][0]["id"], dict) and d["declarations"][0]["id"].get("name") in names:
            assert set(at(FOUND, d["declarations"][0]["id"]["start"])) == {"any"}


def test_deep_and_odd_trees(spark):
    deep = "[" * 100_000 + "]" * 100_000
    rows = [("deep", deep), ("big", '{"type":"StringLiteral","start":9999999999999}'), ("odd", '{"type":"VariableDeclarator","id":"x","start":1}'), ("ok", '{"type":"StringLiteral","start":3}'), ("null", None), ("bad", "{")]
    docs = spark.createDataFrame(rows, "relative_name string, ast_json string")
    assert [(r.relative_name, r.offset, r.type) for r in S.type_candidates(docs).collect()] == [("ok", 3, "string")]
    assert sorted((r.relative_name, r.start) for r in tree.nodes(docs).collect() if r.relative_name != "big") == [("odd", 1), ("ok", 3)]
    assert [r.start for r in tree.nodes(docs).where("relative_name = 'big'").collect()] == [None]
    assert sorted((r.path, r.message) for r in tree.malformed(docs).collect()) == [("bad", "malformed JSON"), ("deep", "too deep")]


def test_first_visit_of_deep_values():
    deep = []
    for _ in range(50_000):
        deep = [deep]
    made, n = tree.FirstVisit().plain(deep), 0
    while made:
        made, n = made[0], n + 1
    assert n == 50_000
    shared = {"l": 1}
    assert tree.FirstVisit().dumps({"a": 1, "b": shared, "c": [shared, 2], "d": shared, "e": None}) == '{"a":1,"b":{"l":1},"c":[null,2],"e":null}'
