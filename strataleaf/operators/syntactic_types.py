"""Type candidates from syntax alone, for trees that no checker has seen.

A checker knows the types of a whole project; where there is none, annotations, literals and the
shape of expressions still tell some. Trees are those of a Babel-like parser, as JSON. What can't be
told is `any`, which arbitration drops, so the two kinds of candidates can be mixed: a checker's
stronger types win by score. One pass over each tree, batch by batch in Arrow; no state between files.

Names are looked up in lexical scopes: blocks hold what is declared in them, functions their parameters
and every `var` below. Trouble at one node costs that node's type alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATES = "relative_name string, offset int, type string, seq long, mode string"
_ARROW = pa.schema([("relative_name", pa.string()), ("offset", pa.int32()), ("type", pa.string()), ("seq", pa.int64()), ("mode", pa.string())])

_KEYWORDS = {f"TS{k.capitalize()}Keyword": k for k in ("any", "boolean", "never", "null", "number", "object", "string", "symbol", "undefined", "unknown", "void")} | {"TSBigIntKeyword": "bigint", "TSThisType": "this"}
_LITERALS = {"BigIntLiteral": "bigint", "BooleanLiteral": "boolean", "NullLiteral": "null", "NumericLiteral": "number", "RegExpLiteral": "RegExp", "StringLiteral": "string", "TemplateLiteral": "string"}
_SIGNATURES = frozenset(("TSCallSignatureDeclaration", "TSConstructSignatureDeclaration", "TSMethodSignature"))
_FUNCTIONS = frozenset(("ArrowFunctionExpression", "ClassMethod", "ClassPrivateMethod", "FunctionDeclaration", "FunctionExpression", "ObjectMethod", "TSDeclareFunction", "TSDeclareMethod")) | _SIGNATURES
_CALLS = frozenset(("CallExpression", "OptionalCallExpression"))
_MEMBERS = frozenset(("MemberExpression", "OptionalMemberExpression"))
_BLOCKS = frozenset(("BlockStatement", "CatchClause", "ForInStatement", "ForOfStatement", "ForStatement", "Program", "StaticBlock", "SwitchStatement", "TSModuleBlock"))
#: What calls of global functions and of methods give.
_GLOBALS = {"BigInt": "bigint", "Boolean": "boolean", "Number": "number", "String": "string", "Symbol": "symbol", "isFinite": "boolean", "isNaN": "boolean", "parseFloat": "number", "parseInt": "number"}
_STATICS = {"Array.isArray": "boolean", "Date.now": "number", "JSON.stringify": "string", "Number.isInteger": "boolean", "Object.keys": "Array<string>", "String.fromCharCode": "string", "String.raw": "string"}
_OF_STRING = dict.fromkeys("at charAt concat normalize padEnd padStart repeat replace replaceAll slice substring toLowerCase toString toUpperCase trim trimEnd trimStart".split(), "string") | dict.fromkeys("endsWith includes startsWith".split(), "boolean") | dict.fromkeys("charCodeAt indexOf lastIndexOf length localeCompare search".split(), "number") | {"split": "Array<string>"}
_OF_ARRAY = dict.fromkeys("every includes some".split(), "boolean") | dict.fromkeys("indexOf lastIndexOf length push unshift".split(), "number") | dict.fromkeys("join toString".split(), "string")
#: Type arguments that a constructor has where none are written.
_NEW = {"Array": "any[]", "Map": "Map<any, any>", "Promise": "Promise<unknown>", "Set": "Set<unknown>", "WeakMap": "WeakMap<WeakKey, any>"}
_TROUBLE = (RecursionError, TypeError, ValueError, AttributeError, LookupError)
#: They hold others and have no type of their own.
_CONTAINERS = frozenset(("BlockStatement", "CatchClause", "ExpressionStatement", "File", "ImportDeclaration", "ImportSpecifier", "Program", "SwitchCase", "TSModuleBlock", "VariableDeclaration", "CommentLine", "CommentBlock"))
_COMPARISONS = frozenset("== != === !== < <= > >= in instanceof".split())
_ARITHMETIC = frozenset("- * / % ** << >> >>> & | ^".split())


def printed(node: object) -> str:
    """A type annotation's text; arrays as Array<T>."""
    if not isinstance(node, dict):
        return "any"
    kind = node.get("type", "")
    if kind in ("TSTypeAnnotation", "TSParenthesizedType"):
        return printed(node.get("typeAnnotation"))
    if kind in _KEYWORDS:
        return _KEYWORDS[kind]
    if kind == "TSArrayType":
        return f"Array<{printed(node.get('elementType'))}>"
    if kind == "TSTupleType":
        return f"[{', '.join(map(printed, node.get('elementTypes') or []))}]"
    if kind in ("TSUnionType", "TSIntersectionType"):
        return (" | " if kind == "TSUnionType" else " & ").join(map(printed, node.get("types") or []))
    if kind == "TSLiteralType":
        value = (node.get("literal") or {}).get("value")
        return json.dumps(value, ensure_ascii=False)
    if kind in ("TSTypeReference", "TSExpressionWithTypeArguments"):
        arguments = ((node.get("typeParameters") or node.get("typeArguments") or {}).get("params")) or []
        return _name(node.get("typeName") or node.get("expression")) + (f"<{', '.join(map(printed, arguments))}>" if arguments else "")
    if kind == "TSTypeOperator":
        return f"{node.get('operator')} {printed(node.get('typeAnnotation'))}"
    if kind == "TSFunctionType":
        return f"{_parameters(node.get('parameters') or node.get('params'))} => {printed(node.get('typeAnnotation') or node.get('returnType'))}"
    if kind == "TSTypeLiteral":
        members = [f"{_name(m.get('key'))}: {printed(m.get('typeAnnotation'))}" for m in node.get("members") or [] if isinstance(m, dict)]
        return "{ " + "; ".join(members) + " }" if members else "{}"
    return "any"


def _name(node: object) -> str:
    if not isinstance(node, dict):
        return ""
    if node.get("type") == "TSQualifiedName":
        return f"{_name(node.get('left'))}.{_name(node.get('right'))}"
    if node.get("type") == "MemberExpression":
        return f"{_name(node.get('object'))}.{_name(node.get('property'))}"
    return str(node.get("name") or node.get("value") or "")


def _pattern(node: dict) -> str:
    """A parameter's name, or its pattern."""
    kind = node.get("type")
    if kind == "AssignmentPattern":
        return _pattern(node.get("left") or {})
    if kind == "RestElement":
        return "..." + _pattern(node.get("argument") or {})
    if kind == "TSParameterProperty":
        return _pattern(node.get("parameter") or {})
    if kind == "ObjectPattern":
        return "{ " + ", ".join(_name(p.get("key")) for p in node.get("properties") or [] if isinstance(p, dict)) + " }"
    if kind == "ArrayPattern":
        return "[" + ", ".join(_pattern(p) if isinstance(p, dict) else "" for p in node.get("elements") or []) + "]"
    return _name(node)


def _of_function(node: dict) -> list[dict]:
    return [p for p in node.get("params") or node.get("parameters") or [] if isinstance(p, dict)]


def _parameters(params: object) -> str:
    return "(" + ", ".join(f"{_pattern(p)}: {_parameter(p)}" for p in params or [] if isinstance(p, dict)) + ")"


def _parameter(p: dict) -> str:
    if p.get("type") == "AssignmentPattern":
        left = p.get("left") or {}
        return printed(left["typeAnnotation"]) if left.get("typeAnnotation") else expression(p.get("right"))
    if p.get("type") == "TSParameterProperty":
        return _parameter(p.get("parameter") or {})
    return printed(p.get("typeAnnotation")) if p.get("typeAnnotation") else "any"


class _Scope:
    """Names that are declared in a block or function; each stands for what tells its type: (kind, node, path)."""

    def __init__(self, above: _Scope | None, function: dict | None) -> None:
        self.above, self.function = above, function
        self.names: dict[str, tuple[str, object, tuple]] = {}

    def find(self, name: str) -> tuple[tuple[str, object, tuple], _Scope] | None:
        at: _Scope | None = self
        while at is not None:
            if name in at.names:
                return at.names[name], at
            at = at.above
        return None

    def bind(self, target: object, kind: str, node: object, path: tuple = ()) -> None:
        """The names of a target, an identifier or a pattern; of several declarations of a name the first counts."""
        todo = [(target, kind, node, path)]
        while todo:
            target, kind, node, path = todo.pop()
            if not isinstance(target, dict):
                continue
            form = target.get("type")
            if form == "AssignmentPattern":
                todo.append((target.get("left"), "or", (kind, node, path, target.get("right")), ()) if kind != "or" else (target.get("left"), kind, node, path))
            elif form == "ObjectPattern":
                for p in target.get("properties") or []:
                    if isinstance(p, dict) and p.get("type") == "RestElement":
                        todo.append((p.get("argument"), "any", None, ()))
                    elif isinstance(p, dict):
                        todo.append((p.get("value"), kind, node, (*path, _name(p.get("key")))) if kind == "value" else (p.get("value"), "any", None, ()))
            elif form == "ArrayPattern":
                todo += [(e, kind, node, (*path, i)) if kind == "value" and e.get("type") != "RestElement" else (e.get("argument") or e, "any", None, ()) for i, e in enumerate(target.get("elements") or []) if isinstance(e, dict)]
            elif form in ("RestElement", "TSParameterProperty"):
                todo.append((target.get("argument") or target.get("parameter"), "parameter" if kind == "parameter" else "any", target, ()))
            elif target.get("name"):
                note = target.get("typeAnnotation")
                self.names.setdefault(str(target["name"]), ("note", note, ()) if note else (kind, node, path))

    def declare(self, statement: object, hoisted: bool = False) -> None:
        """What a statement declares here; hoisted: only its `var`s, which are declared in a block below."""
        if not isinstance(statement, dict):
            return
        kind = statement.get("type", "")
        if kind in ("ExportNamedDeclaration", "ExportDefaultDeclaration"):
            self.declare(statement.get("declaration"), hoisted)
        elif kind == "VariableDeclaration" and (not hoisted or statement.get("kind") == "var"):
            for d in statement.get("declarations") or []:
                if isinstance(d, dict):
                    self.bind(d.get("id"), "value" if isinstance(d.get("init"), dict) else "any", d.get("init"))
        elif hoisted:
            return
        elif kind in ("FunctionDeclaration", "TSDeclareFunction"):
            self.bind(statement.get("id"), "function", statement)
        elif kind == "ClassDeclaration":
            self.bind(statement.get("id"), "class", statement)
        elif kind == "TSEnumDeclaration":
            self.bind(statement.get("id"), "enum", statement)
        elif kind == "ImportDeclaration":
            for x in statement.get("specifiers") or []:
                self.bind((x or {}).get("local"), "any", None)


def _vars(body: object) -> Iterator[dict]:
    """Declarations of `var` below, not those inside functions."""
    stack = [body]
    while stack:
        n = stack.pop()
        if isinstance(n, list):
            stack += reversed(n)
        elif isinstance(n, dict):
            if n.get("type") == "VariableDeclaration" and n.get("kind") == "var":
                yield n
            if n.get("type") not in _FUNCTIONS:
                stack += reversed([v for v in n.values() if isinstance(v, (dict, list))])


class _Typer:
    """Types of the expressions of one tree."""

    def __init__(self) -> None:
        self.scopes: dict[int, _Scope] = {}
        self.types: dict[int, str] = {}
        self.results: dict[int, str] = {}
        self.asked: set[int] = set()  # names whose type is being found: none is found by way of itself

    def inside(self, node: dict, scope: _Scope) -> _Scope:
        """The scope of what is in a node."""
        kind = node.get("type", "")
        if kind not in _FUNCTIONS and kind not in _BLOCKS:
            return scope
        got = self.scopes.get(id(node))
        if got is None:
            got = self.scopes[id(node)] = _Scope(scope, node if kind in _FUNCTIONS else scope.function)
            if kind in _FUNCTIONS:
                for p in _of_function(node):
                    got.bind(p, "parameter", p)
                for v in _vars(node.get("body")):
                    got.declare(v, True)
                if kind == "FunctionExpression":
                    got.bind(node.get("id"), "function", node)
            elif kind == "Program":
                for v in _vars(node.get("body")):
                    got.declare(v, True)
            if kind in _BLOCKS:
                if kind == "CatchClause":
                    got.bind(node.get("param"), "any", None)
                cases = [x for c in node.get("cases") or [] if isinstance(c, dict) for x in c.get("consequent") or []]
                body = node.get("body")
                for x in [*(body if isinstance(body, list) else []), *cases, node.get("init")]:
                    got.declare(x)
                left = node.get("left")
                if isinstance(left, dict) and left.get("type") == "VariableDeclaration":
                    got.declare(left)
        return got

    def of(self, node: object, scope: _Scope) -> str:
        """The type of an expression, as far as its syntax tells."""
        if not isinstance(node, dict):
            return "any"
        known = self.types.get(id(node))
        if known is None:
            known = self._of(node, scope)
            if not self.asked:
                self.types[id(node)] = known
        return known

    def bound(self, name: str, scope: _Scope) -> str:
        found = scope.find(name)
        if not found:
            return "any"
        (kind, node, path), where = found
        if id(node) in self.asked and node is not None:
            return "any"
        self.asked.add(id(node))
        try:
            return self._bound(name, kind, node, path, where)
        finally:
            self.asked.discard(id(node))

    def _bound(self, name: str, kind: str, node, path: tuple, where: _Scope) -> str:
        if kind == "note":
            return printed(node)
        if kind == "value":
            value = self.at(node, path, where)
            return "any" if value is None else self.of(value, where)
        if kind == "or":  # a default: it counts where nothing else tells
            inner, of, at, default = node
            told = self._bound(name, inner, of, at, where) if inner != "any" else "any"
            return self.of(default, where) if told == "any" else told
        if kind == "parameter":
            return _parameter(node)
        if kind == "function":
            return self.signature(node, where)
        return f"typeof {name}" if kind in ("class", "enum") else "any"

    def at(self, node: object, path: tuple, scope: _Scope) -> object | None:
        """The part of a literal that a path of keys and places leads to."""
        for step in path:
            node = self.literal(node, scope)
            if not isinstance(node, dict):
                return None
            if node.get("type") == "ArrayExpression" and isinstance(step, int):
                elements = node.get("elements") or []
                plain = all(not isinstance(e, dict) or e.get("type") != "SpreadElement" for e in elements[: step + 1])
                node = elements[step] if plain and step < len(elements) else None
            elif node.get("type") == "ObjectExpression":
                node = next((p.get("value") or p for p in reversed(node.get("properties") or []) if isinstance(p, dict) and not p.get("computed") and _name(p.get("key")) == str(step)), None)
            else:
                return None
        return node

    def literal(self, node: object, scope: _Scope) -> object:
        """What a name was initialised with, through other names."""
        seen = set()
        while isinstance(node, dict) and node.get("type") == "Identifier" and id(node) not in seen:
            seen.add(id(node))
            found = scope.find(str(node.get("name")))
            if not found or found[0][0] != "value":
                return None
            (_, node, path), scope = found
            node = self.at(node, path, scope) if path else node
        return node

    def called(self, callee: object, scope: _Scope) -> str:
        """What a call of an expression gives."""
        if not isinstance(callee, dict):
            return "any"
        kind = callee.get("type")
        if kind in ("ParenthesizedExpression", "TSNonNullExpression"):
            return self.called(callee.get("expression"), scope)
        if kind in _FUNCTIONS:
            return self.returned(callee, scope)
        if kind == "Identifier":
            name = str(callee.get("name"))
            found = scope.find(name)
            if not found:
                return _GLOBALS.get(name, "any")
            (how, node, path), where = found
            if how == "function":
                return self.returned(node, where)
            value = self.at(node, path, where) if how == "value" else None
            if not isinstance(value, dict) or id(value) in self.asked:
                return "any"
            if value.get("type") in _FUNCTIONS:
                return self.returned(value, where)
            if value.get("type") != "Identifier":
                return "any"
            self.asked.add(id(value))
            try:
                return self.called(value, where)
            finally:
                self.asked.discard(id(value))
        if kind in _MEMBERS and not callee.get("computed"):
            of, name = callee.get("object") or {}, _name(callee.get("property"))
            if of.get("type") == "Identifier" and not scope.find(str(of.get("name"))):
                if of.get("name") == "Math":
                    return "number"
                return _STATICS.get(f"{of.get('name')}.{name}", "any")
            value = self.at(of, (name,), scope)
            if isinstance(value, dict) and value.get("type") in _FUNCTIONS:
                return self.returned(value, scope)
            return self.member(self.of(of, scope), name, "any") if name != "length" else "any"
        return "any"

    def member(self, of: str, name: str, other: str) -> str:
        if of == "string":
            return _OF_STRING.get(name, other)
        return _OF_ARRAY.get(name, other) if of.startswith("Array<") or of.endswith("[]") else other

    def _of(self, node: dict, scope: _Scope) -> str:
        kind = node.get("type", "")
        go = lambda n: self.of(n, scope)
        if kind in _LITERALS:
            return _LITERALS[kind]
        if kind in ("TSAsExpression", "TSSatisfiesExpression", "TSTypeAssertion"):
            note = printed(node.get("typeAnnotation"))
            return go(node.get("expression")) if note == "const" else note
        if kind in ("TSNonNullExpression", "SpreadElement", "ParenthesizedExpression", "ChainExpression"):
            return go(node.get("expression") or node.get("argument"))
        if kind == "ImportExpression" or (kind in _CALLS and (node.get("callee") or {}).get("type") == "Import"):
            source = node.get("source") or (node.get("arguments") or [None])[0]
            return f'Promise<typeof import("{_name(source)}")>'
        if kind == "AwaitExpression":
            inner = go(node.get("argument"))
            return inner[8:-1] if inner.startswith("Promise<") and inner.endswith(">") else inner
        if kind == "Identifier":
            return "undefined" if node.get("name") == "undefined" else self.bound(str(node.get("name")), scope)
        if kind in _CALLS:
            callee, arguments = node.get("callee") or {}, node.get("arguments") or []
            if callee.get("type") in _MEMBERS and _name(callee) == "Promise.resolve" and len(arguments) == 1:
                inner = go(arguments[0])
                return inner if inner == "any" or inner.startswith("Promise<") else f"Promise<{inner}>"
            return self.called(callee, scope)
        if kind in _MEMBERS:
            return self.property(node, scope)
        if kind == "UnaryExpression":
            return {"typeof": "string", "delete": "boolean", "!": "boolean", "void": "undefined"}.get(node.get("operator", ""), "number")
        if kind == "UpdateExpression":
            return "bigint" if go(node.get("argument")) == "bigint" else "number"
        if kind == "BinaryExpression":
            return self.binary(node, scope)
        if kind == "LogicalExpression":
            return _logical(node.get("operator"), go(node.get("left")), go(node.get("right")))
        if kind == "AssignmentExpression":
            op, right = str(node.get("operator")), go(node.get("right"))
            if op == "=":
                return right
            left = go(node.get("left"))
            return _logical(op[:-1], left, right) if op[:-1] in ("&&", "||", "??") else _arithmetic(op[:-1], left, right)
        if kind == "SequenceExpression":
            return go((node.get("expressions") or [None])[-1])
        if kind == "TaggedTemplateExpression":
            return self.called(node.get("tag"), scope)
        if kind == "YieldExpression":
            return self.sent(node, scope)
        if kind == "ConditionalExpression":
            types = sorted({go(node.get("consequent")), go(node.get("alternate"))})
            return "any" if "any" in types else " | ".join(types)
        if kind == "NewExpression":
            name = _name(node.get("callee"))
            arguments = ((node.get("typeParameters") or node.get("typeArguments") or {}).get("params")) or []
            return f"{name}<{', '.join(map(printed, arguments))}>" if name and arguments else _NEW.get(name, name) or "any"
        if kind == "ArrayExpression":
            types = sorted({go(e) for e in node.get("elements") or []})
            return f"Array<{types[0]}>" if len(types) == 1 and types[0] != "any" else "any[]" if "any" in types or not types else f"Array<{' | '.join(types)}>"
        if kind == "ObjectExpression":
            parts = [f"{_name(p.get('key'))}: {go(p.get('value'))}" for p in node.get("properties") or [] if isinstance(p, dict) and p.get("type") in ("ObjectProperty", "Property") and not p.get("computed")]
            return "{ " + "; ".join(parts) + " }" if parts else "{}"
        if kind in _FUNCTIONS:
            return self.signature(node, scope)
        if kind == "ClassExpression":
            return f"typeof {_name(node.get('id')) or '(Anonymous class)'}"
        return "any"

    def property(self, node: dict, scope: _Scope) -> str:
        of, key = node.get("object") or {}, node.get("property") or {}
        name = _name(key) if not node.get("computed") or key.get("type") == "StringLiteral" else None
        if of.get("type") == "Identifier" and name is not None:
            found = scope.find(str(of.get("name")))
            if found and found[0][0] == "enum":
                members = found[0][1].get("members") or (found[0][1].get("body") or {}).get("members") or []
                return f"{of['name']}.{name}" if any(_name((m or {}).get("id")) == name for m in members) else "any"
        place = key.get("value") if key.get("type") == "NumericLiteral" and isinstance(key.get("value"), int) and key["value"] >= 0 else None
        if name is not None or place is not None:
            value = self.at(of, (name if name is not None else place,), scope)
            if value is not None:
                return self.of(value, scope)
        whole = self.of(of, scope)
        if name is None:
            return whole[6:-1] if whole.startswith("Array<") else whole[:-2] if whole.endswith("[]") else "any"
        if whole.startswith("typeof import("):
            return f"{whole}.{name}"
        return "number" if name == "length" and self.member(whole, name, "") else "any"

    def binary(self, node: dict, scope: _Scope) -> str:
        """Left operands are often long chains: they are taken from the inside out."""
        spine = [node]
        while isinstance(left := spine[-1].get("left"), dict) and left.get("type") == "BinaryExpression" and id(left) not in self.types:
            spine.append(left)
        out = self.of(spine[-1].get("left"), scope)
        for n in reversed(spine):
            op = n.get("operator")
            out = "boolean" if op in _COMPARISONS else _arithmetic(op, out, self.of(n.get("right"), scope))
            if not self.asked:
                self.types[id(n)] = out
        return out

    def sent(self, node: dict, scope: _Scope) -> str:
        """What a yield gives back: the third type argument of the generator's declared type, the second of one that is delegated to."""
        note = printed((scope.function or {}).get("returnType")) if not node.get("delegate") else self.of(node.get("argument"), scope)
        parts = _arguments(note) if note.partition("<")[0] in ("AsyncGenerator", "Generator") else []
        n = 1 if node.get("delegate") else 2
        return parts[n] if len(parts) > n else "any"

    def signature(self, function: dict, scope: _Scope) -> str:
        return f"{_parameters(_of_function(function))} => {self.returned(function, scope)}"

    def returned(self, function: dict, scope: _Scope) -> str:
        """A function's return type: declared, else the union of what it returns, in a Promise if it is async, in a Generator if it is one."""
        declared = function.get("returnType") or (function.get("typeAnnotation") if function.get("type") in _SIGNATURES else None)
        if declared:
            return printed(declared)
        if id(function) in self.results:
            return self.results[id(function)]
        if id(function) in self.asked:
            return "any"
        self.asked.add(id(function))
        try:
            union, yields = self._returned(function, self.inside(function, scope))
        finally:
            self.asked.discard(id(function))
        if function.get("generator"):
            out = f"{'AsyncGenerator' if function.get('async') else 'Generator'}<{yields}, {union}, unknown>"
        else:
            out = union if not function.get("async") or union.startswith("Promise<") else f"Promise<{union}>"
        if not self.asked:
            self.results[id(function)] = out
        return out

    def _returned(self, function: dict, scope: _Scope) -> tuple[str, str]:
        body = function.get("body")
        union = lambda types: "any" if "any" in types else " | ".join(sorted(types))
        if not isinstance(body, dict):
            return "any", "any"
        if body.get("type") != "BlockStatement":
            return self.of(body, scope), "any"
        returns, yields = set(), set()
        stack: list[tuple[object, _Scope]] = [(body, scope)]
        while stack:
            n, at = stack.pop()
            if isinstance(n, list):
                stack += [(x, at) for x in reversed(n)]
            elif isinstance(n, dict) and (n is body or n.get("type") not in _FUNCTIONS):
                at = self.inside(n, at)
                if n.get("type") == "ReturnStatement":
                    returns.add(self.of(n["argument"], at) if n.get("argument") else "void")
                elif n.get("type") == "YieldExpression" and not n.get("delegate"):
                    yields.add(self.of(n.get("argument"), at) if n.get("argument") else "undefined")
                stack += [(x, at) for x in reversed(list(n.values())) if isinstance(x, (dict, list))]
        return union(returns or {"void"}), union(yields or {"never"})


def _arguments(note: str) -> list[str]:
    """The type arguments of a printed type."""
    out, depth = [""], 0
    for c in note[note.find("<") + 1 : -1]:
        depth += (c in "<({[") - (c in ">)}]")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _arithmetic(op: object, left: str, right: str) -> str:
    if op == "+":
        return "string" if "string" in (left, right) else left if left == right and left in ("number", "bigint") else "any"
    return "bigint" if left == right == "bigint" else "number" if op in _ARITHMETIC else "any"


def _logical(op: object, left: str, right: str) -> str:
    if op == "??":
        left = " | ".join(t for t in left.split(" | ") if t not in ("null", "undefined")) or right
    if left == right:
        return left
    if "any" in (left, right):
        return "any"
    if op == "&&":  # what is always true gives its right side
        return right if left.startswith(("Array<", "{", "(", "Promise<", "typeof ")) or left.endswith("[]") else "any"
    return " | ".join(sorted({*left.split(" | "), *right.split(" | ")}))


def expression(node: object) -> str:
    """The type of an expression by itself, without names around it."""
    return _Typer().of(node, _Scope(None, None))


def emitted(tree: object) -> Iterator[tuple[int, str, str]]:
    """(offset, type, mode) in preorder. The type of a direct callee's own identifier isn't emitted."""
    typer = _Typer()
    stack: list[tuple[object, str, str, _Scope]] = [(tree, "", "", _Scope(None, None))]
    while stack:
        value, edge, parent, scope = stack.pop()
        if isinstance(value, list):
            stack += [(v, edge, parent, scope) for v in reversed(value)]
            continue
        if not isinstance(value, dict):
            continue
        kind = value.get("type")
        if not isinstance(kind, str):
            stack += [(v, edge, parent, scope) for v in reversed(list(value.values()))]
            continue
        try:
            below = typer.inside(value, scope)
        except _TROUBLE:
            below = scope
        stack += [(v, k, kind, below) for k, v in reversed(list(value.items())) if k not in ("loc", "typeAnnotation", "returnType", "extra", "leadingComments", "trailingComments", "innerComments")]
        if kind in _CONTAINERS or (kind == "Identifier" and edge == "callee" and parent in _CALLS):
            continue
        try:
            found = list(_emit(typer, value, kind, scope))
        except _TROUBLE:  # this node has no type; those below are still visited
            continue
        yield from ((at, t, mode) for at, t, mode in found if isinstance(at, int) and 0 <= at < 1 << 31)


def _emit(typer: _Typer, value: dict, kind: str, scope: _Scope) -> Iterator[tuple[object, str, str]]:
    at = value.get("start")
    if kind in _FUNCTIONS:
        result = typer.returned(value, scope)
        yield at, result, "scored"
        for p in _of_function(value):
            yield p.get("start"), _parameter(p), "overwrite"
        name = value.get("id") or value.get("key")
        if isinstance(name, dict):
            yield name.get("start"), typer.signature(value, scope), "scored"
    elif kind in ("VariableDeclarator", "ClassProperty", "ClassPrivateProperty", "PropertyDefinition"):
        name, init = value.get("id") or value.get("key") or {}, value.get("init") or value.get("value")
        if name.get("type") in ("ObjectPattern", "ArrayPattern"):
            yield from _elements(typer, name, scope)
            return
        note = name.get("typeAnnotation") or value.get("typeAnnotation")
        t = printed(note) if note else typer.of(init, scope)
        yield at, t, "scored"
        if name.get("start") != at:
            yield name.get("start"), t, "scored"
    elif kind in ("ObjectProperty", "Property"):
        yield at, typer.of(value.get("value"), scope), "scored"
    elif kind in ("ClassDeclaration", "ClassExpression"):
        if isinstance(value.get("id"), dict):
            own = [_name(p) if isinstance(p.get("name"), str) else _name(p.get("name")) for p in (value.get("typeParameters") or {}).get("params") or []]
            yield at, _name(value["id"]) + (f"<{', '.join(own)}>" if own else ""), "scored"
    elif kind == "TSEnumDeclaration":
        for m in value.get("members") or (value.get("body") or {}).get("members") or []:
            yield m.get("start"), f"{_name(value.get('id'))}.{_name(m.get('id'))}", "scored"
    elif kind in _MEMBERS:
        t = typer.of(value, scope)
        yield at, t, "scored"
        yield (value.get("property") or {}).get("start"), t, "scored"
    else:
        t = typer.of(value, scope)
        if t != "any":
            yield at, t, "scored"


def _elements(typer: _Typer, pattern: dict, scope: _Scope) -> Iterator[tuple[object, str, str]]:
    """The names that a pattern binds."""
    stack: list[object] = [pattern]
    while stack:
        n = stack.pop()
        if isinstance(n, list):
            stack += reversed(n)
        elif isinstance(n, dict) and n.get("type") == "Identifier":
            yield n.get("start"), typer.bound(str(n.get("name")), scope), "scored"
        elif isinstance(n, dict):
            stack += [n.get(k) for k in ("argument", "elements", "properties", "left", "value") if isinstance(n.get(k), (dict, list))]


def type_candidates(documents: DataFrame, json_col: str = "ast_json") -> DataFrame:
    """CANDIDATES of documents (relative_name, ast_json). Null and malformed trees have none, nor have trees too deep for the JSON reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    tree = json.loads(text) if text is not None else None
                except (ValueError, RecursionError):
                    continue
                rows += [{"relative_name": name, "offset": o, "type": t, "seq": i, "mode": m} for i, (o, t, m) in enumerate(emitted(tree))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return documents.select("relative_name", F.col(json_col).alias("json")).mapInArrow(run, CANDIDATES)
