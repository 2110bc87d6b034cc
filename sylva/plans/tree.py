"""Decision trees as small immutable values on the driver: predicates, nodes and their algebra.

A tree is a Leaf, or a Node whose left branch takes rows for which its predicate holds.  Targets are dicts from label to
weight.  Every leaf and node carries a `path` ('' at the root, then 'L' and 'R'), which names it for good; leaf indices are
renumbered from left to right after every change.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.hashing import uniform_of

Target = dict[Any, float]

_OPS = {
    "isEq": ("===", operator.eq),
    "notEq": ("!=", operator.ne),
    "lt": ("<", operator.lt),
    "ltEq": ("<=", operator.le),
    "gt": (">", operator.gt),
    "gtEq": (">=", operator.ge),
}
OPERATORS = tuple(_OPS)
_OPPOSITE = {"isEq": "notEq", "notEq": "isEq", "lt": "gtEq", "gtEq": "lt", "gt": "ltEq", "ltEq": "gt"}


def compare(op: str, a: Any, b: Any) -> Any:
    """A comparison by its name, of values or of Columns."""
    return _OPS[op][1](a, b)


def is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


@dataclass(frozen=True)
class Predicate:
    """One comparison of a feature's value with a constant."""

    op: str
    value: Any

    def __post_init__(self):
        if self.op not in _OPS:
            raise ValueError(f"unknown predicate {self.op!r}")

    def __call__(self, value: Any) -> bool:
        return _OPS[self.op][1](value, self.value)

    def __invert__(self) -> Predicate:
        return Predicate(_OPPOSITE[self.op], self.value)

    def map(self, f: Callable[[Any], Any]) -> Predicate:
        """The constant rewritten; the predicate keeps its meaning only if f keeps order."""
        return Predicate(self.op, f(self.value))

    def display(self, name: str = "x") -> str:
        return f"{name} {_OPS[self.op][0]} {self.value}"

    __str__ = display

    def column(self, feature: Column) -> Column:
        return _OPS[self.op][1](feature, F.lit(self.value))


@dataclass(frozen=True)
class Leaf:
    index: int
    target: Target = field(default_factory=dict)
    annotation: Any = None


@dataclass(frozen=True)
class Node:
    feature: str
    predicate: Predicate
    left: Leaf | Node
    right: Leaf | Node
    annotation: Any = None

    def children(self, row: dict) -> list[Leaf | Node]:
        """Where a row may go: one child, or both if the feature is missing (None or NaN)."""
        value = row.get(self.feature)
        if value is None or value != value:
            return [self.left, self.right]
        return [self.left if self.predicate(value) else self.right]


Tree = Leaf | Node


def singleton(target: Target | None = None) -> Leaf:
    return Leaf(0, target or {})


def add(a: Target, b: Target) -> Target:
    return {k: a.get(k, 0) + b.get(k, 0) for k in [*a, *(k for k in b if k not in a)]}


def total(t: Target) -> float:
    return sum(t.values())


# ---------------------------------------------------------------- traversal of the structure


def fold(tree: Tree, leaf: Callable[[Leaf], Any], node: Callable[[Node, Any, Any], Any]) -> Any:
    if isinstance(tree, Leaf):
        return leaf(tree)
    return node(tree, fold(tree.left, leaf, node), fold(tree.right, leaf, node))


def leaves(tree: Tree) -> Iterator[Leaf]:
    stack = [tree]
    while stack:
        t = stack.pop()
        if isinstance(t, Leaf):
            yield t
        else:
            stack += [t.right, t.left]


def with_paths(tree: Tree, path: str = "") -> Iterator[tuple[str, Tree]]:
    """Every node with its path, parents first."""
    yield path, tree
    if isinstance(tree, Node):
        yield from with_paths(tree.left, path + "L")
        yield from with_paths(tree.right, path + "R")


def depth(tree: Tree) -> int:
    return fold(tree, lambda _: 0, lambda _, a, b: 1 + max(a, b))


def target_of(tree: Tree) -> Target:
    return fold(tree, lambda x: x.target, lambda _, a, b: add(a, b))


def leaf_at(tree: Tree, index: int) -> Leaf | None:
    return next((x for x in leaves(tree) if x.index == index), None)


# ---------------------------------------------------------------- changes


def renumber(tree: Tree, start: int = 0) -> Tree:
    """Leaf indices from left to right, from `start` on."""
    count = iter(range(start, start + sum(1 for _ in leaves(tree))))

    def walk(t: Tree) -> Tree:
        if isinstance(t, Leaf):
            return replace(t, index=next(count))
        left = walk(t.left)
        return replace(t, left=left, right=walk(t.right))

    return walk(tree)


def map_leaves(tree: Tree, f: Callable[[Leaf], Tree]) -> Tree:
    return fold(tree, f, lambda n, a, b: replace(n, left=a, right=b))


def update_leaves(tree: Tree, f: Callable[[int], Tree | None]) -> Tree:
    """Leaves for which f gives a tree are replaced by it, then all are renumbered."""
    return renumber(map_leaves(tree, lambda x: f(x.index) or x))


def grow(tree: Tree, f: Callable[[int], tuple[str, Predicate, Target, Target] | None]) -> Tree:
    """Leaves for which f gives a split (feature, predicate, left and right target) become nodes."""

    def split(leaf: Leaf) -> Tree:
        found = f(leaf.index)
        return Node(found[0], found[1], Leaf(0, found[2]), Leaf(0, found[3])) if found else leaf

    return renumber(map_leaves(tree, split))


def annotate(tree: Tree, f: Callable[[Target], Any], combine: Callable[[Any, Any], Any] = operator.add) -> Tree:
    """Annotations of leaves from their targets; those of nodes combine their children's."""
    return fold(
        tree,
        lambda x: replace(x, annotation=f(x.target)),
        lambda n, a, b: replace(n, left=a, right=b, annotation=combine(a.annotation, b.annotation)),
    )


def map_annotation(tree: Tree, f: Callable[[Any], Any]) -> Tree:
    return fold(
        tree,
        lambda x: replace(x, annotation=f(x.annotation)),
        lambda n, a, b: replace(n, left=a, right=b, annotation=f(n.annotation)),
    )


def map_features(tree: Tree, f: Callable[[str], str]) -> Tree:
    return fold(tree, lambda x: x, lambda n, a, b: replace(n, feature=f(n.feature), left=a, right=b))


def map_predicates(tree: Tree, f: Callable[[Any], Any]) -> Tree:
    """Constants of all predicates rewritten by an order-preserving f."""
    return fold(tree, lambda x: x, lambda n, a, b: replace(n, predicate=n.predicate.map(f), left=a, right=b))


def prune(tree: Tree, held_out: dict[int, Target], error: Callable[[Target, Target], float]) -> Tree:
    """Bottom-up: two leaves merge if their errors on held-out targets sum to no less than the merged leaf's.

    error(held-out target, training target); a leaf without held-out rows has an empty held-out target.
    Leaves are renumbered afterwards.
    """

    def merge(n: Node, a: tuple[Tree, Target], b: tuple[Tree, Target]) -> tuple[Tree, Target]:
        (left, left_held), (right, right_held) = a, b
        both = add(left_held, right_held)
        if isinstance(left, Leaf) and isinstance(right, Leaf):
            target = add(left.target, right.target)
            if error(left_held, left.target) + error(right_held, right.target) >= error(both, target):
                return Leaf(left.index, target), both
        return replace(n, left=left, right=right), both

    return renumber(fold(tree, lambda x: (x, held_out.get(x.index, {})), merge)[0])


# ---------------------------------------------------------------- single rows


def search(tree: Tree, row: dict, order: str = "depth", id_: Any = None, seed: str = "traversal", index: int = 0) -> Iterator[Leaf]:
    """All leaves that a row with missing features may reach, in order.

    order: which child of a missing feature goes first.  'depth': left; 'weighted': the one with the larger
    annotation, left of equals; 'random': by a fair coin; 'probabilistic': left in the share of the annotations.
    Coins are the hashes that routing on the cluster uses, of the tree's index, the row's id and the node's path.
    """
    stack = [("", tree)]
    while stack:
        path, t = stack.pop()
        if isinstance(t, Leaf):
            yield t
            continue
        after = [(path + "LR"[x is t.right], x) for x in t.children(row)]
        if len(after) == 2:
            a, b = (float(x.annotation or 0) for _, x in after)
            coin = lambda: uniform_of(seed, index, id_, path)  # noqa: B023, E731
            first = {"depth": lambda: True, "weighted": lambda: a >= b, "random": lambda: coin() < 0.5, "probabilistic": lambda: coin() * (a + b) < a}[order]()  # noqa: B023
            after = after if first else after[::-1]
        stack += after[::-1]


def limited(found: Iterator[Leaf], n: int) -> list[Leaf]:
    if n <= 0:
        raise ValueError("the limit must be positive")
    return [leaf for leaf, _ in zip(found, range(n))]


def leaf_for(tree: Tree, row: dict, **how: Any) -> Leaf | None:
    return next(search(tree, row, **how), None)


def compress(tree: Tree) -> dict[str, list]:
    """The tree as parallel arrays in breadth-first order; `left` is the position of the left child, right is next to it."""
    out: dict[str, list] = {k: [] for k in ("leaf", "feature", "op", "value", "left", "target", "annotation")}
    queue, at = [tree], 1
    for t in queue:
        node = isinstance(t, Node)
        if node:
            queue += [t.left, t.right]
        row = (None if node else t.index, t.feature if node else None, t.predicate.op if node else None, t.predicate.value if node else None, at if node else None, None if node else t.target, t.annotation)
        for column, value in zip(out.values(), row):
            column.append(value)
        at += 2 * node
    return out


def expand_compressed(arrays: dict[str, list], at: int = 0) -> Tree:
    """The inverse of compress."""
    if arrays["left"][at] is None:
        return Leaf(arrays["leaf"][at], arrays["target"][at], arrays["annotation"][at])
    left = arrays["left"][at]
    predicate = Predicate(arrays["op"][at], arrays["value"][at])
    return Node(arrays["feature"][at], predicate, expand_compressed(arrays, left), expand_compressed(arrays, left + 1), arrays["annotation"][at])
