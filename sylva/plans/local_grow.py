"""Growth of the subtree below a leaf from the rows that reach it, in one task.

The grower works on columns of one group (numpy), with the same splits and scores as the distributed plan: numbers
by < at every distinct value, strings by equality, ties to the smaller feature and value.  Rows without the chosen
feature go the way that routing sends them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..operators.evaluate import AccuracySplit, BrierSplit, ChiSquared, Evaluator, MinWeight, VotedError
from .tree import Leaf, Node, Predicate, Tree


def _target(labels: np.ndarray, names: list[str], w: np.ndarray) -> dict[str, float]:
    sums = np.bincount(labels, w, len(names))
    return {n: float(s) for n, s in zip(names, sums) if s}


def chi_squared(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Of many splits: left (splits x labels) and the total of each label; -inf where a side is empty."""
    right = total - left
    n, lt, rt = total.sum(), left.sum(axis=1), right.sum(axis=1)
    own = total > 0
    out = np.full(len(left), -np.inf)
    ok = (lt > 1e-12) & (rt > 1e-12)
    for side, size in ((left[ok], lt[ok]), (right[ok], rt[ok])):
        expected = size[:, None] * total[None, own] / n
        part = ((side[:, own] - expected) ** 2 / expected).sum(axis=1)
        out[ok] = np.where(np.isinf(out[ok]), 0, out[ok]) + part
    return out


def multiplied_chi_squared(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same with a label counted once for each side on which it occurs."""
    right = total - left
    out = np.full(len(left), -np.inf)
    ok = (left.sum(axis=1) > 1e-12) & (right.sum(axis=1) > 1e-12)
    left, right, own = left[ok], right[ok], total > 0
    many = (left > 1e-12).astype(float) + (right > 1e-12)
    out[ok] = 0
    for side in (left, right):
        expected = side.sum(axis=1)[:, None] * total[None, own] / total.sum()
        out[ok] += (many[:, own] * (side[:, own] - expected) ** 2 / expected).sum(axis=1)
    return out


def _by_sides(error: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A score from the errors (side, its weight) of both sides, over the weight of all."""

    def score(left: np.ndarray, total: np.ndarray) -> np.ndarray:
        right = total - left
        lt, rt = left.sum(axis=1), right.sum(axis=1)
        ok = (lt > 1e-12) & (rt > 1e-12)
        out = np.full(len(left), -np.inf)
        out[ok] = -(error(left[ok], lt[ok]) + error(right[ok], rt[ok])) / (lt[ok] + rt[ok])
        return out

    return score


def scorer(evaluator: Evaluator) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The score of an evaluator on arrays; an error for those that only Spark can compute."""
    kind = type(evaluator)
    if kind is ChiSquared:
        return multiplied_chi_squared if evaluator.label_multiplicity else chi_squared
    if kind is BrierSplit:
        return _by_sides(lambda side, w: w - (side * side).sum(axis=1) / w)
    if kind is AccuracySplit:
        return _by_sides(lambda side, w: w - side.max(axis=1))
    if kind is VotedError:
        return _by_sides(evaluator.local)
    if kind is MinWeight:
        inner, condition = scorer(evaluator.inner), evaluator.condition
        try:
            plain = np.asarray(condition(np.array([1.0, 2.0]))).dtype == bool
        except Exception:
            plain = False
        if plain:
            return lambda left, total: np.where(condition(left.sum(axis=1)) & condition((total - left).sum(axis=1)), inner(left, total), -np.inf)
    raise ValueError(f"growth in memory can't compute {evaluator}: use expand")


def _numeric(v: np.ndarray, y: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, code = np.unique(v, return_inverse=True)
    grid = np.zeros((len(values), k))
    np.add.at(grid, (code, y), w)
    return values, np.cumsum(grid, axis=0) - grid


def _nominal(v: np.ndarray, y: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, code = np.unique(v.astype(str), return_inverse=True)
    grid = np.zeros((len(values), k))
    np.add.at(grid, (code, y), w)
    return values, grid


def grow(
    columns: dict[str, np.ndarray],
    numeric: dict[str, bool],
    label: np.ndarray,
    weight: np.ndarray,
    depth: int,
    min_size: float = 10,
    score: Callable[[np.ndarray, np.ndarray], np.ndarray] = chi_squared,
    allowed: Callable[[str, str], bool] | None = None,
    left: Callable[[str, np.ndarray], np.ndarray] | None = None,
) -> Tree:
    """A tree of at most `depth` levels.  allowed(path, feature): whether a node may use a feature; left(path, rows): which of
    the rows without the feature of a node go left, all if not given."""
    names, y = np.unique(np.asarray(label, dtype=str), return_inverse=True)
    names = list(names)
    missing = {f: np.array([x is None or x != x for x in v]) for f, v in columns.items()}

    def node(rows: np.ndarray, levels: int, path: str) -> Tree:
        target = _target(y[rows], names, weight[rows])
        if not levels or len(target) < 2 or sum(target.values()) <= min_size:
            return Leaf(0, target)
        best = None
        for f in sorted(columns):
            if allowed and not allowed(path, f):
                continue
            own = rows[~missing[f][rows]]
            if not len(own):
                continue
            v = columns[f][own]
            values, sides = (_numeric(v.astype(float), y[own], weight[own], len(names)) if numeric[f] else _nominal(v, y[own], weight[own], len(names)))
            found = np.round(score(sides, np.bincount(y[own], weight[own], len(names))), 9)
            k = int(found.argmax())
            if np.isfinite(found[k]) and (best is None or found[k] > best[0]):
                best = (found[k], f, float(values[k]) if numeric[f] else str(values[k]))
        if best is None:
            return Leaf(0, target)
        _, f, value = best
        predicate = Predicate("lt" if numeric[f] else "isEq", value)
        v = columns[f][rows]
        goes = missing[f][rows].copy()
        there = ~goes
        if left and goes.any():
            goes[goes] = left(path, rows[goes])
        goes[there] = v[there].astype(float) < value if numeric[f] else v[there].astype(str) == value
        if goes.all() or not goes.any():
            return Leaf(0, target)
        return Node(f, predicate, node(rows[goes], levels - 1, path + "L"), node(rows[~goes], levels - 1, path + "R"))

    return node(np.arange(len(y)), depth, "")
