"""Small authored tables for operators that the driver's tables have no input for. Their queries exercise the operator, not scale."""

from __future__ import annotations

import json

COMPONENTS = [
    ("plain.vue", "<template>\n<h1 :title=\"t\">{{ t }}</h1>\n</template>\n<script>\nexport default { data: () => ({ t: 'x' }) }\n</script>\n<style scoped>\nh1 { color: red }\n</style>\n"),
    ("setup.vue", '<script setup lang="ts">\nconst n = 1;\n</script>\n<!-- a\nb -->\n<template>\n<p :[key]="v" @click="go" .prop="z">{{ n }}<br>{{ n + 1 }}</p>\n</template>\n'),
    ("two.vue", "<SCRIPT>let a = 1;</SCRIPT>\r\n<script>let b = 2;</script>\r\n<template>{{a}}</template><p></p><template>{{b}}</template>"),
    ("image.vue", '<template><img src="a.png"  ><img src="b.png" /><img alt="c" x></template>'),
    ("none.vue", "<template>{{ only }}</template>"),
    ("empty.vue", ""),
    ("astral.vue", "<!-- \U0001f600 -->\n<template>\U0001f600 {{ x }}</template>\n<script>const s = '\U0001f600';</script>"),
]
#: (project, relative_name, offset, type, seq, mode)
CANDIDATES = [
    ("p1", "a.ts", 0, "any", 0, "scored"), ("p1", "a.ts", 0, "string", 1, "scored"), ("p1", "a.ts", 0, "Promise<any>", 2, "scored"),
    ("p1", "a.ts", 4, "number", 0, "scored"), ("p1", "a.ts", 4, "string", 1, "scored"), ("p1", "a.ts", 4, "bigint", 2, "scored"),
    ("p1", "a.ts", 9, "() => void", 0, "scored"), ("p1", "a.ts", 9, "{ a: number; b: string; c: boolean }", 1, "scored"),
    ("p1", "a.ts", 12, "(x: number) => string", 0, "scored"), ("p1", "a.ts", 12, "string", 1, "overwrite"), ("p1", "a.ts", 12, "number | string", 2, "scored"),
    ("p1", "a.ts", 15, "string", 0, "scored"), ("p1", "a.ts", 15, "any", 1, "overwrite"), ("p1", "a.ts", 15, "unknown", 2, "overwrite"),
    ("p1", "a.ts", -1, "string", 0, "scored"), ("p1", "b.ts", 0, "Promise<any>", 0, "scored"), ("p1", "b.ts", 3, "Array<string>", 0, "scored"),
    ("p2", "c.ts", 0, "typeof import(\"./d\")", 0, "scored"), ("p2", "c.ts", 0, "Map<string, number>", 1, "scored"), ("p2", "c.ts", 7, "error", 0, "scored"),
    ("p2", "c.ts", 8, "boolean", 0, "scored"), ("p2", "c.ts", 8, "unknown[]", 1, "scored"), ("p2", "c.ts", 20, "{ a: 1 }", 0, "scored"),
    ("p2", "d.ts", 1, "\"\U0001f600\"", 0, "scored"), ("p2", "d.ts", 1, "\"xyz\"", 1, "scored"), ("p2", "d.ts", 1, "\"abc\"", 2, "scored"),
]
TYPES = [
    ("p1", t) for t in ("string", "number", "any", "Promise<any>", "company", "() => void", "<T>(x: T) => T", "string | null", "string[]", "Map<string, number>", "readonly [a, b]", "[1, 2]", "{ a: number }", "{}", "void", "Foo", "string", "unresolvedThing", "Function", "object", "\"lit\"", "Array<number>")
] + [("p2", t) for t in ("number", "string", "Foo", "a.any.b", "error", "HTMLElement", "Set<Bar>", "bigint", "'x' | 'y'", "ReadonlyArray<string>")]
#: (file_ord, content)
ROUTES = [
    (0, "# comment\nGET /a controllers.A.x(id: Int)\nget  /a  controllers.A.x\nGET /a controllers.A.x\n-> /adm admin.Routes\n+ nocsrf\nGET /webjars w.X.y\nGET /w webjars.F.at(file)\nFOO /z q\nPUT /b B.c\r\n\n  POST\t/c   C.d  \n"),
    (1, "GET /a controllers.A.x\nDELETE /only\nDELETE /only\nGET /adm admin.Routes\nOPTIONS /o O.p(a, b)\nHEAD /h H\n"),
]
#: (dump, file_ord, content)
DUMPS = [
    ("app/A.tasty", 0, "Names (10 bytes, starting from 1):\n0: ASTs\n1: a\n2: play.api.Foo\n3: x: yy\nTrees (5 bytes):\n139: SELECT 38 [<init>[ Signature(List(play.api.mvc.MessagesControllerComponents,scala.Int),play.api.mvc.Result) @<init>]]\n140: X [f[Signed Signature(List(slick.jdbc.X),java.lang.String) @f]]\nPositions (9 bytes):\nsource paths:\n0: 5 [app/controllers/A.scala]\n"),
    ("app/R.tasty", 1, "Names:\r\n1: ab\r\n---\r\nTrees:\r\n1: T Signature(router.RoutesPrefix, q) x\r\npositions:\r\nsource paths:\r\n0: target/scala-3/x/routes.scala\r\n"),
    ("app/A2.tasty", 2, "Trees (1):\n1: T Signature(play.twirl.api.Html) x\nNames (2):\n3: late\n5: late\n4: other\nsource paths: 1 [app/controllers/A.scala]\n"),
    ("app/N.tasty", 3, "Names:\n1: nothing\n"),
]
TEMPLATES = [
    ("<% if (a) { %>x<% } %>", "   if (a) {       }   "),
    ("<% if a %>y<% else %>z<% end %>", "if (a) {   } else {   }        "),
    ("<%= user.name %>", "    user.name ; "),
    ("<%# note %><% include x %>", " " * 26),
    ("<script>var q=<%= v %>;</script>", "        var q=    v   ;         "),
]
#: (type, current file, normal form)
IMPORTS = [
    ('import("/p/src/models").User', "/p/src/a.ts", 'import("./models").User'),
    ('Promise<typeof import("/p/lib/x.d.ts", { with: { "resolution-mode": "import" } })>', "/p/src/a.ts", 'Promise<typeof import("../lib/x")>'),
    ('import("vue").Ref<import("file:///p/src/b.tsx").T>', "/p/src/a.ts", 'import("vue").Ref<import("./b").T>'),
    ("string", "/p/src/a.ts", "string"),
    (None, "/p/src/a.ts", None),
]
#: (expected, actual, whether they match)
PAIRS = [
    ("number", "number", True), ("number", "42", True), ("number", "x1", True), ("number", "one", False), ("string", '"a"', True), ("string", "a", False),
    ("boolean", "true", True), ("boolean", "yes", False), ("a  |  b", "a | b", True), ("number[]", "number[]", True), ("T", "U", False),
]
#: (project, line_no, line)
BUILDS = [
    ("a", 0, "name := \"x\""), ("a", 1, "val scala212 = \"2.12.1\""), ("a", 2, "val scala3 = \"3.3.1\""), ("a", 3, "val scalaNext = \"3.4.0\""),
    ("b", 0, "crossScalaVersions := Seq(\"2.13.1\", \"3.2.0\")"), ("c", 0, "scalaVersion := \"3.1.0\""),
]
TREES = [
    ("m.js", '{"end":20,"start":0,"type":"File","loc":{"start":{"type":"no"}},"program":{"type":"Program","body":[{"type":"ExpressionStatement","expression":{"type":"CallExpression","callee":{"type":"Identifier","name":"f","start":3},"arguments":[{"type":"NumericLiteral","value":1},[{"type":"Identifier","name":"g","start":9}]]}},null]},"comments":[null]}'),
    ("n.js", '{"type":"File","program":{"body":[{"type":"Identifier","name":"z"},{"type":7,"x":{"type":"Identifier"}}]}}'),
    ("bad.js", '{"type":'),
    ("null.js", None),
]


def _node(kind: str, start: int, **more: object) -> dict:
    return {"start": start, "type": kind, **more}


def _name(name: str, start: int, **more: object) -> dict:
    return _node("Identifier", start, name=name, **more)


_STRINGS = {"typeAnnotation": {"elementType": {"type": "TSStringKeyword"}, "type": "TSArrayType"}, "type": "TSTypeAnnotation"}
_BODY = _node("BlockStatement", 50, body=[_node("ReturnStatement", 52, argument=_name("a", 59)), _node("ReturnStatement", 62, argument=_node("StringLiteral", 69, value="s"))])
_TYPED = _node(
    "Program",
    0,
    body=[
        _node("VariableDeclaration", 0, declarations=[_node("VariableDeclarator", 6, id=_name("a", 6), init=_node("NumericLiteral", 10, value=1))]),
        {"async": True, **_node("FunctionDeclaration", 20, id=_name("f", 35), params=[_name("x", 37, typeAnnotation=_STRINGS)], body=_BODY)},
        _node("ExpressionStatement", 80, expression=_node("CallExpression", 80, callee=_name("a", 80), arguments=[_node("UnaryExpression", 82, operator="typeof", argument=_name("a", 89))])),
    ],
)
#: (relative_name, ast_json, expected (offset, type))
TYPED_TREES = [
    ("t.ts", json.dumps(_TYPED), [(6, "number"), (10, "number"), (20, "Promise<number | string>"), (35, "(x: Array<string>) => Promise<number | string>"), (37, "Array<string>"), (59, "number"), (69, "string"), (82, "string"), (89, "number")]),
    ("bad.ts", "{", []),
    ("null.ts", None, []),
]


class _Builder:
    """Syntax trees whose nodes start at places of their own."""

    def __init__(self) -> None:
        self.at = 0

    def __call__(self, type_: str, /, **fields: object) -> dict:
        self.at += 1
        return {"type": type_, "start": self.at, **fields}

    def name(self, name: str, note: dict | None = None) -> dict:
        return self("Identifier", name=name, **({"typeAnnotation": note} if note else {}))

    def number(self, value: int = 1) -> dict:
        return self("NumericLiteral", value=value)

    def string(self, value: str = "s") -> dict:
        return self("StringLiteral", value=value)

    def const(self, target: str | dict, init: dict | None, kind: str = "const") -> dict:
        target = self.name(target) if isinstance(target, str) else target
        return self("VariableDeclaration", kind=kind, declarations=[self("VariableDeclarator", id=target, init=init)])

    def block(self, *body: dict) -> dict:
        return self("BlockStatement", body=list(body))

    def function(self, name: str | None, *body: dict, params: tuple = (), kind: str = "FunctionDeclaration", **more: object) -> dict:
        return self(kind, **({"id": self.name(name)} if name else {}), params=list(params), body=self.block(*body), **more)

    def back(self, value: dict | None) -> dict:
        return self("ReturnStatement", argument=value)

    def call(self, callee: str | dict, *arguments: dict) -> dict:
        return self("CallExpression", callee=self.name(callee) if isinstance(callee, str) else callee, arguments=list(arguments))

    def member(self, of: str | dict, name: str | dict) -> dict:
        of = self.name(of) if isinstance(of, str) else of
        return self("MemberExpression", object=of, property=self.name(name) if isinstance(name, str) else name, computed=not isinstance(name, str))

    def record(self, **fields: dict) -> dict:
        return self("ObjectExpression", properties=[self("ObjectProperty", key=self.name(k), value=v) for k, v in fields.items()])

    def array(self, *elements: dict) -> dict:
        return self("ArrayExpression", elements=list(elements))

    def operation(self, op: str, left: dict, right: dict) -> dict:
        kind = "LogicalExpression" if op in ("&&", "||", "??") else "AssignmentExpression" if op.endswith("=") and op not in ("==", "<=") else "BinaryExpression"
        return self(kind, operator=op, left=left, right=right)


def _note(kind: str, **fields: object) -> dict:
    return {"type": "TSTypeAnnotation", "typeAnnotation": {"type": kind, **fields}}


def _reference(name: str, *arguments: str) -> dict:
    return _note("TSTypeReference", typeName={"type": "Identifier", "name": name}, typeParameters={"params": [{"type": a} for a in arguments]})


def typed_rules() -> tuple[str, list[tuple[str, int, str]]]:
    """A tree of small declarations, and what is known of some of its places: (rule, position, type)."""
    b = _Builder()
    body: list[dict] = []
    asked: list[tuple[str, int, str]] = []

    def value(rule: str, init: dict, type_: str, kind: str = "const") -> None:
        """const xN = init: the name has the type."""
        body.append(b.const(f"x{len(body)}", init, kind))
        asked.append((rule, body[-1]["declarations"][0]["id"]["start"], type_))

    def here(rule: str, node: dict, type_: str) -> dict:
        asked.append((rule, node["start"], type_))
        return node

    # two functions with a name of their own each, and blocks that hide an outer one
    body += [b.function("a", b.const("x", b.number()), b.back(b.name("x"))), b.function("b", b.const("x", b.string()), b.back(b.name("x")))]
    value("TREE-4", b.call("a"), "number")
    value("TREE-4", b.call("b"), "string")
    body.append(b.function("hidden", b.const("y", b.string()), b.block(b.const("y", b.number()), b.back(b.name("y")))))
    value("TREE-4", b.call("hidden"), "number")
    body.append(b.function("none", b.function("inner", b.back(b.number()))))
    value("TREE-4", b.call("none"), "void")
    value("TREE-6", b("AwaitExpression", argument=b.call("later")), "number")
    body.append(b.function("later", b.back(b.number()), **{"async": True}))
    value("TREE-7", b.call("declared"), "boolean")
    body.append(b.function("declared", b.back(b.call("unknown")), returnType=_note("TSBooleanKeyword")))
    value("TY-1", b("TSAsExpression", expression=b.call("unknown"), typeAnnotation=_note("TSStringKeyword")), "string")
    value("TY-1", b("TSNonNullExpression", expression=b.number()), "number")
    method = b("ClassMethod", kind="get", key=b.name("size"), params=[], body=b.block(b.back(b.number())))
    here("TY-2", method, "number")
    here("TY-2", method["key"], "() => number")
    signature = b("TSMethodSignature", key=b.name("f"), parameters=[b.name("p", _note("TSStringKeyword"))], typeAnnotation=_note("TSVoidKeyword"))
    here("TY-2", signature["key"], "(p: string) => void")
    here("TY-6", signature["parameters"][0], "string")
    property_ = b("ClassProperty", key=b.name("z"), value=b.string())
    here("TY-3", property_["key"], "string")
    body.append(here("TY-17", b("ClassDeclaration", id=b.name("K"), typeParameters={"params": [{"type": "TSTypeParameter", "name": "T"}]}, body=b("ClassBody", body=[method, property_])), "K<T>"))
    body.append(b("TSInterfaceDeclaration", body=b("TSInterfaceBody", body=[signature])))
    value("TY-4", b.call("x_later"), "string")
    body.append(b.const("x_later", b("ArrowFunctionExpression", params=[], body=b.string())))
    first, second, third = b.name("first"), b.name("second"), b.name("third")
    pattern = b("ObjectPattern", properties=[b("ObjectProperty", key=b.name("p"), value=first), b("ObjectProperty", key=b.name("q"), value=b("ArrayPattern", elements=[second, b("AssignmentPattern", left=third, right=b("BooleanLiteral", value=True))]))])
    body.append(b.const(pattern, b.record(p=b.number(), q=b.array(b.string()))))
    asked.extend([("TY-5", first["start"], "number"), ("TY-5", second["start"], "string"), ("TY-5", third["start"], "boolean")])
    body.append(b.const("rec", b.record(k=here("TY-7", b.string(), "string"), m=b("FunctionExpression", params=[], body=b.block(b.back(b.number()))))))
    short = b("ObjectProperty", key=b.name("rec"), value=b.name("first"), shorthand=True)
    here("TY-8", short, "number")
    body.append(b.const("short", b("ObjectExpression", properties=[short])))
    value("TY-9", b.call(b("Import"), b.string("m")), 'Promise<typeof import("m")>')
    value("TY-10", b.call(b.member("rec", "m")), "number")
    value("TY-10", b.call(b.member(b.string(), "split"), b.string()), "Array<string>")
    value("TY-10", b.call("parseInt", b.string()), "number")
    value("TY-10", b.call(b.member("Promise", "resolve"), b.number()), "Promise<number>")
    value("TY-11", b("NewExpression", callee=b.name("Map"), arguments=[], typeParameters={"params": [{"type": "TSStringKeyword"}, {"type": "TSNumberKeyword"}]}), "Map<string, number>")
    value("TY-11", b("NewExpression", callee=b.name("K"), arguments=[]), "K")
    access = b.member("rec", "k")
    here("TY-12", access["property"], "string")
    value("TY-12", access, "string")
    element = b.member(b.array(b.number(), b.number()), b.number(0))
    here("TY-12", element["property"], "number")
    value("TY-12", element, "number")
    long = b.string()
    for _ in range(1500):
        long = b.operation("+", long, b.number())
    value("TY-13", long, "string")
    value("TY-13", b.operation("<", b.call("unknown"), b.number()), "boolean")
    value("TY-13", b.operation("??", b("NullLiteral"), b.number()), "number")
    value("TY-13", b.operation("||", b.number(), b.string()), "number | string")
    value("TY-13", b.operation("=", b.name("w"), b.number()), "number")
    value("TY-13", b.operation("+=", b.name("first"), b.number()), "number")
    value("TY-14", b("ConditionalExpression", test=b.name("w"), consequent=b.number(), alternate=b.string()), "number | string")
    one, two = b("TSEnumMember", id=b.name("One"), initializer=b.number()), b("TSEnumMember", id=b.name("Two"))
    body.append(b("TSEnumDeclaration", id=b.name("E"), members=[here("TY-18", one, "E.One"), here("TY-18", two, "E.Two")]))
    value("TY-18", b.member("E", "Two"), "E.Two")
    value("TY-19", b("TemplateLiteral", quasis=[], expressions=[]), "string")
    value("TY-20", b("TaggedTemplateExpression", tag=b.name("a"), quasi=b("TemplateLiteral", quasis=[], expressions=[])), "number")
    value("TY-20", b("TaggedTemplateExpression", tag=b.member("String", "raw"), quasi=b("TemplateLiteral", quasis=[], expressions=[])), "string")
    got = b.const("got", b("YieldExpression", argument=b.number()))
    asked.append(("TY-21", got["declarations"][0]["id"]["start"], "string"))
    body.append(b.function("gen", got, generator=True, returnType=_reference("Generator", "TSNumberKeyword", "TSVoidKeyword", "TSStringKeyword")))
    body.append(b.function("made", b("YieldExpression", argument=b.number()), b.back(b.string()), generator=True))
    value("TY-21", b.call("made"), "Generator<number, string, unknown>")
    spread = b("SpreadElement", argument=b.array(b.number()))
    here("TY-22", spread, "Array<number>")
    body.append(b.const("spread", b.array(spread)))
    value("TY-23", b("UnaryExpression", operator="typeof", argument=b.name("w")), "string")
    value("TY-24", b.array(b.number(), b.number()), "Array<number>")
    # nodes that make no sense: they have no type, and those below still do
    odd = b("VariableDeclarator", id="not a node", init=b.array(here("TY-25", b.string(), "string")))
    body.append(b("VariableDeclaration", kind="const", declarations=[odd]))
    value("TY-25", b("CallExpression", callee="x", arguments=7), "number", "let")
    asked.pop()
    # names that lead to themselves
    body += [b.const("p1", b.name("p2")), b.const("p2", b.name("p1"))]
    return json.dumps(b("File", program=b("Program", body=body))), asked


RULES_TREE, RULES = typed_rules()
#: The routes and slices above as one document.
SLICES_DOCUMENT = '{"config":{"routes":[{"method":"GET","pattern":"/a","controllerMethod":"controllers.A.x"},{"method":"get","pattern":"/a","controllerMethod":"controllers.A.x"},{"method":"GET","pattern":"/adm","controllerMethod":"admin.Routes"},{"method":"PATCH","pattern":"/adm","controllerMethod":"admin.Routes"},{"method":"POST","pattern":"/adm","controllerMethod":"admin.Routes"},{"method":"DELETE","pattern":"/adm","controllerMethod":"admin.Routes"},{"method":"PUT","pattern":"/adm","controllerMethod":"admin.Routes"},{"method":"PUT","pattern":"/b","controllerMethod":"B.c"},{"method":"POST","pattern":"/c","controllerMethod":"C.d"},{"method":"DELETE","pattern":"/only"},{"method":"DELETE","pattern":"/only"},{"method":"OPTIONS","pattern":"/o","controllerMethod":"O.p"},{"method":"HEAD","pattern":"/h","controllerMethod":"H"}]},"app/N.scala":{"sourceFile":"app/N.scala","tags":[],"usedTypes":[],"literals":["nothing"]},"app/controllers/A.scala":{"sourceFile":"app/controllers/A.scala","tags":["framework-input","framework-output"],"usedTypes":["play.twirl.api.Html"],"literals":["late","other","1 [app/controllers/A.scala]"]},"target/scala-3/x/routes.scala":{"sourceFile":"target/scala-3/x/routes.scala","tags":["framework-route","generated"],"usedTypes":["router.RoutesPrefix"],"literals":["ab"]}}'
