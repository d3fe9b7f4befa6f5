"""Syntax trees: JSON documents flattened into nodes, and what nodes tell."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import count, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "relative_name string, node_id int, parent_id int, depth int, edge string, ordinal int, type string, start int, end int, attrs map<string,string>"
_ARROW = pa.schema(
    [("relative_name", pa.string()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("edge", pa.string()), ("ordinal", pa.int32())]
    + [("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string()))]
)
_TALLY = pa.schema([("relative_name", pa.string()), ("type", pa.string()), ("depth", pa.int32()), ("n", pa.int64()), ("places", pa.int64())])
#: Rows that are sent back at a time.
_ROWS = 20_000
_SKIPPED = frozenset(("loc", "start", "end"))
_OWN = _SKIPPED | {"type"}
#: Per type and depth the nodes of a document, and the sum of their ordinals.
TALLY = "relative_name string, type string, depth int, n bigint, places bigint"


def visits(tree: object) -> Iterator[tuple[int, int | None, int, str, int, dict]]:
    """The nodes of a tree in preorder: objects with a string `type`. Arrays are passed through, positions skipped. Of each
    its number, parent, depth, edge, ordinal and object.

    Works on a stack, so depth has no limit but memory.
    """
    n = 0
    stack: list[tuple[Iterator[tuple[str, int, object]], int | None, int]] = [(iter([("", 0, tree)]), None, 0)]
    while stack:
        beside, parent, depth = stack[-1]
        for edge, ordinal, v in beside:
            if isinstance(v, list):
                stack.append((zip(repeat(edge), count(), v), parent, depth))
                break
            if isinstance(v, dict):
                here, below = parent, depth
                if isinstance(v.get("type"), str):
                    here, below = n, depth + 1
                    yield n, parent, depth, edge, ordinal, v
                    n += 1
                if inside := [(k, 0, x) for k, x in v.items() if isinstance(x, (dict, list)) and k not in _SKIPPED]:
                    stack.append((iter(inside), here, below))
                    break
        else:
            stack.pop()


def walk(tree: object) -> Iterator[dict]:
    """The nodes of a tree, as visits() finds them, with their own values."""
    for n, parent, depth, edge, ordinal, v in visits(tree):
        keys: list[str] = []
        texts: list[str] = []
        _plain(v, keys, texts)
        yield {"node_id": n, "parent_id": parent, "depth": depth, "edge": edge, "ordinal": ordinal, "type": v["type"], "start": _int(v.get("start")), "end": _int(v.get("end")), "attrs": list(zip(keys, texts, strict=True))}


def _plain(node: dict, keys: list[str], texts: list[str]) -> None:
    """Put a node's own values, as texts, at the end of two lists."""
    for k, v in node.items():
        if k not in _OWN and not isinstance(v, (dict, list)):
            keys.append(k)
            texts.append(v if isinstance(v, str) else str(v) if type(v) is int else json.dumps(v))


def _int(v: object) -> int | None:
    return v if isinstance(v, int) and not isinstance(v, bool) and -(1 << 31) <= v < 1 << 31 else None


def nodes(documents: DataFrame, json_col: str = "ast_json") -> DataFrame:
    """NODES of documents (relative_name, ast_json). Null or malformed JSON, and JSON too deep for the reader, has no nodes; see
    malformed(). Positions that don't fit an int are null."""

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, text in _texts(batch):
                try:
                    found = visits(json.loads(text))
                except (ValueError, RecursionError):
                    continue
                for node in found:
                    rows.append((name, *node))
                    if len(rows) > _ROWS:
                        yield _node_batch(rows)
                        rows = []
            if rows:
                yield _node_batch(rows)

    return documents.select("relative_name", F.col(json_col).alias("json")).mapInArrow(flatten, NODES)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str | None, str]]:
    """Names and texts of a batch, without null texts; one at a time, for texts may be long."""
    for name, text in zip(batch.column(0), batch.column(1), strict=True):
        if text.is_valid:
            yield name.as_py(), text.as_py()


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of NODES, from names and visits."""
    *columns, values = zip(*rows, strict=True)
    keys: list[str] = []
    texts: list[str] = []
    ends = [0]
    for v in values:
        _plain(v, keys, texts)
        ends.append(len(keys))
    columns += [[v["type"] for v in values], [_int(v.get("start")) for v in values], [_int(v.get("end")) for v in values]]
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=False)]
    return pa.RecordBatch.from_arrays([*arrays, pa.MapArray.from_arrays(ends, pa.array(keys, pa.string()), pa.array(texts, pa.string()))], schema=_ARROW)


class _Leaf:
    """A node without anything below, in a tree that is read to be counted; those of a type are one object."""

    __slots__ = ("type",)

    def __init__(self, type: str) -> None:
        self.type = type


_HELD = frozenset((dict, list, _Leaf))


def _read_to_count(text: str) -> object:
    """The tree of a text, its leaves as _Leaf and other objects that hold nothing as None: what is below the nodes is dropped
    while the text is read, so that of most nodes no object is kept."""
    leaves: dict[str, _Leaf] = {}

    def closed(v: dict) -> dict | _Leaf | None:
        for x in v.values():
            if type(x) in _HELD:
                return v
        t = v.get("type")
        return (leaves.get(t) or leaves.setdefault(t, _Leaf(t))) if type(t) is str else None

    try:
        return json.loads(text, object_hook=closed)
    except RecursionError:  # the calls need room of their own
        return json.loads(text)


def tally(tree: object) -> dict[tuple[str, int], list[int]]:
    """By type and depth how many nodes visits() finds in a tree that was read from JSON, and the sum of their ordinals. It may
    have _Leaf in it; a list of one kind of them is counted at once."""
    out: dict[tuple[str, int], list[int]] = {}
    stack: list[tuple[list, int]] = [([tree], 0)]  # values with their ordinals as places in a list, and depth
    while stack:
        beside, depth = stack.pop()
        first, many = beside[0] if beside else None, len(beside)
        if isinstance(first, _Leaf) and beside.count(first) == many:
            found = out.setdefault((first.type, depth), [0, 0])
            found[0] += many
            found[1] += many * (many - 1) // 2
            continue
        for ordinal, v in enumerate(beside):
            kind = type(v)
            if kind is list:
                stack.append((v, depth))
            elif kind in _HELD:
                t = v.type if kind is _Leaf else v.get("type")
                named = isinstance(t, str)
                if named:
                    found = out.setdefault((t, depth), [0, 0])
                    found[0] += 1
                    found[1] += ordinal
                if kind is dict:
                    stack += [(x if type(x) is list else [x], depth + named) for k, x in v.items() if type(x) in _HELD and k not in _SKIPPED]
    return out


def tallies(documents: DataFrame, json_col: str = "ast_json") -> DataFrame:
    """TALLY of documents: what nodes() has, grouped by name, type and depth, without a row for each node. Documents are counted
    where they are read, so that what leaves Python grows with the kinds of nodes, not with the nodes."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, text in _texts(batch):
                try:
                    found = tally(_read_to_count(text))
                except (ValueError, RecursionError):
                    continue
                for (t, depth), (n, places) in found.items():
                    rows.append((name, t, depth, n, places))
                    if len(rows) > _ROWS:
                        yield _arrow(rows, _TALLY)
                        rows = []
            if rows:
                yield _arrow(rows, _TALLY)

    each = documents.select("relative_name", F.col(json_col).alias("json")).mapInArrow(counted, TALLY)
    return each.groupBy("relative_name", "type", "depth").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))


def malformed(documents: DataFrame, json_col: str = "ast_json") -> DataFrame:
    """(path, stage, message) of the documents whose tree can't be read, by the reader that nodes() uses."""

    def bad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    json.loads(text)
                except RecursionError:
                    rows.append((name, "too deep"))
                except ValueError:
                    rows.append((name, "malformed JSON"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["path", "message"])

    asked = documents.where(F.col(json_col).isNotNull()).select("relative_name", json_col)
    return asked.mapInArrow(bad, "path string, message string").select("path", F.lit("tree").alias("stage"), "message")


def type_histogram(found: DataFrame) -> DataFrame:
    """(relative_name, type, n)."""
    return found.groupBy("relative_name", "type").agg(F.count("*").alias("n"))


def total_nodes(histogram: DataFrame) -> DataFrame:
    return histogram.groupBy("relative_name").agg(F.sum("n").alias("total_nodes"))


def shape_snapshot(histogram: DataFrame) -> DataFrame:
    """(relative_name, total_nodes, node_type_counts): the counts as entries sorted by type."""
    pairs = F.array_sort(F.collect_list(F.struct("type", "n")))
    return histogram.groupBy("relative_name").agg(F.sum("n").alias("total_nodes"), F.map_from_entries(pairs).alias("node_type_counts"))


def callee_offsets(found: DataFrame) -> DataFrame:
    """(relative_name, offset) of identifiers that are called directly: their own type isn't recorded."""
    calls = found.where(F.col("type").isin("CallExpression", "OptionalCallExpression")).select("relative_name", F.col("node_id").alias("parent_id"))
    callees = found.where((F.col("type") == "Identifier") & (F.col("edge") == "callee"))
    return callees.join(calls, ["relative_name", "parent_id"], "left_semi").select("relative_name", F.col("start").alias("offset"))


#: Kinds of nodes that hold others and have no type of their own.
CONTAINERS = ("SourceFile", "Block", "CaseBlock", "CaseClause", "CatchClause", "DefaultClause", "ExpressionStatement", "ImportDeclaration", "ModuleBlock", "NamedImports", "VariableDeclarationList")
_FUNCTIONS = ("ArrowFunctionExpression", "ClassMethod", "FunctionDeclaration", "FunctionExpression", "ObjectMethod")


def enclosing_function(tree: object) -> dict[int, int | None]:
    """Per node the nearest function around it, by node ids."""
    above: dict[int, tuple[int | None, bool]] = {}
    out = {}
    for node in walk(tree):
        parent = node["parent_id"]
        inside = None if parent is None else parent if above[parent][1] else above[parent][0]
        above[node["node_id"]] = (inside, node["type"] in _FUNCTIONS)
        out[node["node_id"]] = inside
    return out


def return_types(nodes_with_types: DataFrame) -> DataFrame:
    """(relative_name, function_id, type): the async return type of functions, from nodes (relative_name, function_id,
    type) that are returned there: the distinct types, sorted, joined by bars, in a Promise."""
    from strataleaf.functions.typestrings import promised, union_type

    out = nodes_with_types.groupBy("relative_name", "function_id").agg(union_type(F.col("type")).alias("type"))
    return out.withColumn("type", promised(F.col("type")))


class FirstVisit:
    """Serialises objects that share parts: the first visit to an object writes it, later ones leave it out
    (in arrays, as null). Identity counts, so this works on Python objects, not on JSON text."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def plain(self, value: object) -> object:
        """Depth first and in order, on a stack, so depth has no limit but memory."""
        if isinstance(value, (dict, list)) and id(value) in self.seen:
            raise LookupError
        out: list[object] = []
        stack: list[tuple[object, object, object]] = [(value, out, None)]  # what is visited, and where it goes
        while stack:
            v, into, key = stack.pop()
            again = isinstance(v, (dict, list)) and id(v) in self.seen
            if again and isinstance(into, dict):
                del into[key]  # its place was kept for the order of keys
                continue
            made = None if again else {k: None for k in v} if isinstance(v, dict) else [] if isinstance(v, list) else v
            if isinstance(into, dict):
                into[key] = made
            else:
                into.append(made)
            if again or not isinstance(v, (dict, list)):
                continue
            self.seen.add(id(v))
            stack += [(x, made, k) for k, x in reversed(list(v.items()))] if isinstance(v, dict) else [(x, made, None) for x in reversed(v)]
        return out[0]

    def dumps(self, value: object) -> str:
        return json.dumps(self.plain(value), separators=(",", ":"), ensure_ascii=False)
