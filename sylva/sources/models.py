"""Trees as JSON, and ensembles as files.

A leaf is {"leaf": index, "distribution": {label: weight}[, "annotation"]}; a split is {"key", "predicate": {op: value},
"left", "right"[, "annotation"]}.  Ensembles are tab-separated lines (tree, JSON), a Parquet table of nodes, or one
compact string.  Decoding never raises on foreign input other than ModelError.
"""

from __future__ import annotations

import base64
import json
import zlib
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..plans.tree import Leaf, Node, Predicate, Tree, compress, expand_compressed, with_paths

OPS = ("isEq", "notEq", "lt", "ltEq", "gt", "gtEq")
TAGS = ("ordinal", "nominal", "continuous", "sparse")


class ModelError(ValueError):
    """Text that is not a model."""


def single(value: Any, what: str) -> tuple[str, Any]:
    """The key and value of an object with exactly one."""
    if not isinstance(value, dict):
        raise ModelError(f"{what} is not an object")
    if not value:
        raise ModelError(f"{what} is empty")
    if len(value) > 1:
        raise ModelError(f"{what} has more than one key")
    return next(iter(value.items()))


def encode_predicate(p: Predicate) -> dict:
    return {p.op: p.value}


def decode_predicate(value: Any) -> Predicate:
    op, constant = single(value, "predicate")
    if op not in OPS:
        raise ModelError(f"unknown predicate {op!r}")
    if isinstance(constant, dict):
        constant = decode_tagged(constant)[1]
    if isinstance(constant, (list, type(None))):
        raise ModelError("a predicate needs a number, a string or a boolean")
    return Predicate(op, constant)


def encode_tagged(tag: str, value: Any) -> dict:
    if tag not in TAGS:
        raise ModelError(f"unknown tag {tag!r}")
    return {tag: value}


def decode_tagged(value: Any) -> tuple[str, Any]:
    tag, inner = single(value, "tagged value")
    if tag not in TAGS:
        raise ModelError(f"unknown tag {tag!r}")
    number = isinstance(inner, (int, float)) and not isinstance(inner, bool)
    if tag == "continuous" and not number:
        raise ModelError("continuous needs a number")
    return tag, inner


def encode_option(value: Any) -> list:
    return [] if value is None else [value]


def decode_option(value: Any) -> Any:
    if not isinstance(value, list) or len(value) > 1:
        raise ModelError("an option is a list of at most one value")
    return value[0] if value else None


def encode_boolean(value: bool) -> str:
    return "true" if value else "false"


def decode_boolean(text: Any) -> bool:
    if text not in ("true", "false"):
        raise ModelError("not exactly true or false")
    return text == "true"


def encode(tree: Tree) -> dict:
    note = {} if tree.annotation is None else {"annotation": tree.annotation}
    if isinstance(tree, Leaf):
        return {"leaf": tree.index, "distribution": {str(k): w for k, w in tree.target.items()}} | note
    return {"key": tree.feature, "predicate": encode_predicate(tree.predicate), "left": encode(tree.left), "right": encode(tree.right)} | note


def decode(value: Any) -> Tree:
    if not isinstance(value, dict):
        raise ModelError("a node is an object")
    note = value.get("annotation")
    if "leaf" in value:
        index, target = value["leaf"], value.get("distribution")
        if not isinstance(index, int) or isinstance(index, bool):
            raise ModelError("a leaf's index is an integer")
        numbers = isinstance(target, dict) and all(isinstance(w, (int, float)) and not isinstance(w, bool) for w in target.values())
        if not numbers:
            raise ModelError("a distribution is an object of numbers")
        return Leaf(index, target, note)
    if not isinstance(value.get("key"), str) or not {"predicate", "left", "right"} <= value.keys():
        raise ModelError("a split has a key, a predicate, a left and a right")
    return Node(value["key"], decode_predicate(value["predicate"]), decode(value["left"]), decode(value["right"]), note)


def dumps(tree: Tree) -> str:
    return json.dumps(encode(tree), separators=(",", ":"), ensure_ascii=False)


def loads(text: str) -> Tree:
    try:
        return decode(json.loads(text))
    except (json.JSONDecodeError, RecursionError, TypeError) as e:
        raise ModelError(str(e)) from e


def to_string(tree: Tree) -> str:
    """A compact string: parallel arrays, compressed, as base64."""
    return base64.b64encode(zlib.compress(json.dumps(compress(tree), separators=(",", ":")).encode())).decode()


def from_string(text: str) -> Tree:
    try:
        return expand_compressed(json.loads(zlib.decompress(base64.b64decode(text, validate=True))))
    except (ValueError, zlib.error, KeyError, IndexError, TypeError, RecursionError) as e:
        raise ModelError(str(e)) from e


# ---------------------------------------------------------------- files


def step(base: str, k: int) -> str:
    return f"{base}/step_{k:02d}"


def frame(spark: SparkSession, trees: dict[int, Tree]) -> DataFrame:
    return spark.createDataFrame([(i, dumps(t)) for i, t in trees.items()], "tree int, json string")


def write(spark: SparkSession, trees: dict[int, Tree], path: str, form: str = "tsv") -> None:
    if form == "tsv":
        lines = spark.createDataFrame([(f"{i}\t{dumps(t)}",) for i, t in trees.items()], "line string")
        lines.coalesce(1).write.mode("overwrite").text(path)
    elif form == "parquet":
        rows = []
        for i, tree in trees.items():
            for p, t in with_paths(tree):
                rows.append((i, p, json.dumps(encode(t) if isinstance(t, Leaf) else {"key": t.feature, "predicate": encode_predicate(t.predicate), "annotation": t.annotation})))
        spark.createDataFrame(rows, "tree int, path string, node string").coalesce(1).write.mode("overwrite").parquet(path)
    else:
        raise ValueError("form is tsv or parquet")


def read(spark: SparkSession, path: str, form: str = "tsv") -> dict[int, Tree]:
    if form == "tsv":
        out = {}
        for r in spark.read.text(path).collect():  # one line a tree
            index, _, text = r[0].partition("\t")
            out[int(index)] = loads(text)
        return dict(sorted(out.items()))
    nodes: dict[int, dict[str, dict]] = {}
    for r in spark.read.parquet(path).collect():
        nodes.setdefault(r["tree"], {})[r["path"]] = json.loads(r["node"])

    def build(own: dict[str, dict], p: str) -> Tree:
        n = own[p]
        if "leaf" in n:
            return decode(n)
        return Node(n["key"], decode_predicate(n["predicate"]), build(own, p + "L"), build(own, p + "R"), n.get("annotation"))

    return {i: build(own, "") for i, own in sorted(nodes.items())}


# ---------------------------------------------------------------- the older format

_NEGATION = {"isEq": "notEq", "notEq": "isEq", "lt": "gtEq", "gtEq": "lt", "gt": "ltEq", "ltEq": "gt"}
#: What a predicate lets through: smaller, equal and greater values.
_LETS = {"lt": frozenset("<"), "isEq": frozenset("="), "gt": frozenset(">"), "ltEq": frozenset("<="), "gtEq": frozenset(">="), "notEq": frozenset("<>")}
_NAMED = {lets: op for op, lets in _LETS.items()}


def _old_predicate(value: Any) -> Predicate:
    op, inner = single(value, "predicate")
    if op == "not":
        p = _old_predicate(inner)
        return Predicate(_NEGATION[p.op], p.value)
    if op == "or":
        if not isinstance(inner, list) or not inner:
            raise ModelError("or needs predicates")
        found = [_old_predicate(x) for x in inner]
        out = found[0]
        for p in found[1:]:
            if p.value != out.value:
                raise ModelError("or of different values")
            joined = _NAMED.get(_LETS[p.op] | _LETS[out.op])
            if joined is None:
                raise ModelError(f"no predicate is {out.op} or {p.op}")
            out = Predicate(joined, out.value)
        return out
    names = {"eq": "isEq", "lt": "lt", "isEq": "isEq", "notEq": "notEq", "ltEq": "ltEq", "gt": "gt", "gtEq": "gtEq"}
    if op not in names:
        raise ModelError(f"{op} can't be migrated")
    return Predicate(names[op], inner)


def _old_node(value: Any) -> dict:
    if isinstance(value, dict):
        return value
    if not isinstance(value, list) or len(value) != 2:
        raise ModelError("a split has two branches")
    left, right = value
    if left.get("feature") != right.get("feature"):
        raise ModelError("branches on different features")
    p, q = _old_predicate(left.get("predicate")), _old_predicate(right.get("predicate"))
    if Predicate(_NEGATION[p.op], p.value) != q:
        raise ModelError("branches aren't complements")
    return {"key": left["feature"], "predicate": encode_predicate(p), "left": _old_node(left.get("children")), "right": _old_node(right.get("children"))}


def migrate_model(lines: list[str]) -> list[str]:
    """Lines (tree, JSON) of the older format, in which a split is a list of two branches, in the present one."""
    out = []
    for line in lines:
        index, tab, text = line.rstrip("\n").partition("\t")
        if not tab:
            raise ModelError("a line is a tree's number, a tab and JSON")
        try:
            out.append(f"{index}\t{json.dumps(_old_node(json.loads(text)), separators=(',', ':'))}")
        except (json.JSONDecodeError, AttributeError) as e:
            raise ModelError(str(e)) from e
    return out
