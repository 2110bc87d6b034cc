"""Trees compressed to arrays, walked by numpy over whole Arrow batches.

The arrays go to the tasks with the function; rows stay in their stage, however deep the trees are.  A text is compared by
its place among the constants that predicates compare its feature with, so a batch's texts are looked up once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions.hashing import uniform_of
from ..plans import tree as T
from ..sources.storage import on_workers
from .features import Source, name

ORDERS = ("depth", "weighted", "random", "probabilistic")


def text_of(value: Any) -> str:
    """A predicate's constant as SQL spells it."""
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


class Walker:
    """What a task needs to walk trees: arrays by node, and the features and constants of their predicates."""

    def __init__(self, trees: dict[int, T.Tree], order: str = "depth", seed: str = "traversal"):
        if order not in ORDERS:
            raise ValueError(f"order is one of {ORDERS}")
        self.order, self.seed = order, seed
        nodes = [t for x in trees.values() for _, t in T.with_paths(x) if isinstance(t, T.Node)]
        self.numbers = sorted({t.feature for t in nodes if T.is_number(t.predicate.value)})
        self.texts = sorted({t.feature for t in nodes if not T.is_number(t.predicate.value)})
        constants: dict[str, set[str]] = {f: set() for f in self.texts}
        for t in nodes:
            if not T.is_number(t.predicate.value):
                constants[t.feature].add(text_of(t.predicate.value))
        self.constants = {f: sorted(c) for f, c in constants.items()}
        self.trees = {i: self._arrays(t) for i, t in trees.items()}

    def _arrays(self, tree: T.Tree) -> dict[str, np.ndarray]:
        c = T.compress(tree)
        n = len(c["leaf"])
        out = {k: np.zeros(n, d) for k, d in (("leaf", np.int64), ("column", np.int64), ("op", np.int8), ("value", np.float64), ("left", np.int64), ("left_weight", np.float64), ("right_weight", np.float64))}
        paths = [""] * n
        for k in range(n):
            left = c["left"][k]
            out["left"][k] = -1 if left is None else left
            if left is None:
                out["leaf"][k] = c["leaf"][k]
                continue
            feature, v = c["feature"][k], c["value"][k]
            out["op"][k] = T.OPERATORS.index(c["op"][k])
            if T.is_number(v):
                out["column"][k], out["value"][k] = self.numbers.index(feature), v
            else:  # constants have odd places, other texts the even ones between them
                out["column"][k] = len(self.numbers) + self.texts.index(feature)
                out["value"][k] = 2 * self.constants[feature].index(text_of(v)) + 1
            out["left_weight"][k], out["right_weight"][k] = (float(c["annotation"][j] or 0) for j in (left, left + 1))
            paths[left], paths[left + 1] = paths[k] + "L", paths[k] + "R"
        return out | {"path": np.array(paths, object)}

    def values(self, columns: list[pa.Array]) -> np.ndarray:
        """The values of a batch, rows times columns, NaN where missing."""
        out = [c.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns[: len(self.numbers)]]
        for f, column in zip(self.texts, columns[len(self.numbers) :]):
            own, known = self.constants[f], {}

            def place(t: str | None) -> float:
                if t not in known:
                    k = np.nan if t is None else bisect_left(own, t)
                    known[t] = k if t is None else 2.0 * k + (k < len(own) and own[k] == t)
                return known[t]

            out.append(np.array([place(t) for t in column.to_pylist()], np.float64))
        return np.stack(out, axis=1) if out else np.zeros((0, 0))

    def walk(self, tree: int, values: np.ndarray, rows: np.ndarray, ids: list[str | None], limit: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves that rows reach in a tree, in the order of a search; at most `limit` of each row."""
        a = self.trees[tree]
        at = np.zeros(len(rows), np.int64)
        while len(open_ := np.flatnonzero(a["left"][at] >= 0)):
            k = at[open_]
            v = values[rows[open_], a["column"][k]]
            goes = _compared(a["op"][k], v, a["value"][k])
            missing = np.flatnonzero(np.isnan(v))
            goes[missing] = self._left_first(tree, a, k[missing], rows[open_[missing]], ids)
            child = a["left"][k] + ~goes
            if limit == 1:
                at[open_] = child
                continue
            # Both children of a missing feature, side by side, the first one first.
            copies = np.ones(len(at), np.int64)
            copies[open_[missing]] = 2
            place = np.cumsum(copies) - copies
            at[open_] = child
            other = 2 * a["left"][k[missing]] + 1 - child[missing]
            at, rows = np.repeat(at, copies), np.repeat(rows, copies)
            at[place[open_[missing]] + 1] = other
            if limit is not None:  # each of them leads to a leaf at least
                keep = _ordinal(rows) < limit
                at, rows = at[keep], rows[keep]
        return rows, a["leaf"][at]

    def _left_first(self, tree: int, a: dict[str, np.ndarray], k: np.ndarray, rows: np.ndarray, ids: list[str | None]) -> np.ndarray:
        left, right = a["left_weight"][k], a["right_weight"][k]
        if self.order == "depth":
            return np.ones(len(k), bool)
        if self.order == "weighted":
            return left >= right
        coin = np.array([uniform_of(self.seed, tree, ids[r], p) for r, p in zip(rows.tolist(), a["path"][k])], np.float64)
        return coin < 0.5 if self.order == "random" else coin * (left + right) < left


def _compared(op: np.ndarray, v: np.ndarray, constant: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v), bool)
    for code in np.unique(op).tolist():
        own = op == code
        out[own] = T.compare(T.OPERATORS[code], v[own], constant[own])
    return out


def _ordinal(groups: np.ndarray) -> np.ndarray:
    """The place of each element in its run of equal numbers."""
    start = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return np.arange(len(groups)) - np.repeat(start, np.diff(np.append(start, len(groups))))


def _mapped(rows: DataFrame, walker: Walker, source: Source, own: list[str], more: list[ST.StructField], fn, tree: str | None = None) -> DataFrame:
    """mapInArrow over own columns of rows; fn(own columns, values, ids, trees) gives all columns of a batch."""
    on_workers(rows.sparkSession)
    n = len(own)
    values = [source.number(f) for f in walker.numbers] + [source.text(f) for f in walker.texts]
    id_ = F.col("id") if "id" in rows.columns else F.lit(None)
    trees = F.col(name(tree)).cast("long") if tree else F.lit(None).cast("long")
    sent = rows.select(*[F.col(name(c)) for c in own], trees, id_.cast("string"), *values)
    names = [f"c{k}" for k in range(len(sent.columns))]
    fields = [ST.StructField(f"c{k}", rows.schema[c].dataType) for k, c in enumerate(own)] + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = fn(b, walker.values(b.columns[n + 2 :]), b.column(n + 1).to_pylist(), b.column(n).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    out = sent.toDF(*names).mapInArrow(run, ST.StructType(fields))
    return out.toDF(*own, *[f.name for f in more])


def leaves_by_walk(rows: DataFrame, walker: Walker, source: Source, tree: str = "tree", leaf: str = "leaf", ord_: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows with the index of their first leaf; or, with `ord_`, a row for each leaf that they may reach, numbered from 1.

    Rows whose tree is none of the walker's have no leaf: null, or no row.
    """
    own = [c for c in rows.columns if c not in (leaf, ord_)]
    n = len(own)

    def found(b: pa.RecordBatch, x: np.ndarray, ids: list, trees: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        parts = [none, *(walker.walk(i, x, np.flatnonzero(trees == i), ids, most) for i in walker.trees)]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def first(b, x, ids, trees):
        at, to = found(b, x, ids, trees, 1)
        out = np.full(b.num_rows, -1, np.int32)
        out[at] = to
        return [*b.columns[:n], pa.array(out, mask=out < 0)]

    def every(b, x, ids, trees):
        at, to = found(b, x, ids, trees, limit)
        order = np.argsort(at, kind="stable")  # rows keep their order, and a row its leaves'
        at, to = at[order], to[order]
        place = _ordinal(at) + 1 if len(at) else at
        return [*(c.take(pa.array(at)) for c in b.columns[:n]), pa.array(place.astype(np.int32)), pa.array(to.astype(np.int32))]

    number = [ST.StructField(x, ST.IntegerType()) for x in ([ord_] if ord_ else []) + [leaf]]
    return _mapped(rows, walker, source, own, number, every if ord_ else first, tree)


def votes_by_walk(rows: DataFrame, walker: Walker, source: Source, votes: dict[int, dict[int, list[float]]], size: int, column: str) -> DataFrame:
    """Rows with an array of `size` numbers: the sum over trees of the votes of the leaf that the row reaches."""
    own = rows.columns
    tables = {i: np.array([of.get(k, [0.0] * size) for k in range(max(of) + 1)]).reshape(-1, size) for i, of in votes.items()}

    def sums(b, x, ids, trees):
        total, every = np.zeros((b.num_rows, size)), np.arange(b.num_rows)
        for i, table in tables.items():
            at, to = walker.walk(i, x, every, ids, 1)
            total[at] += table[to]
        offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * size)
        return [*b.columns[: len(own)], pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))]

    return _mapped(rows, walker, source, own, [ST.StructField(column, ST.ArrayType(ST.DoubleType()))], sums)
