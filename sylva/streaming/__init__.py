"""Scoring of streams.

A model is a set of expressions over a row, so the same routing and voting that scores a table scores a stream, without
state: soft votes of one row are sums over its own trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import Columns, Source, name
from ..operators.routing import CASE_NODES, leaf_case
from ..operators.walk import Walker, votes_by_walk
from ..plans import tree as T


def shares(leaf: T.Leaf, labels: list[str]) -> list[float]:
    """A leaf's soft vote for each label."""
    n = max(sum(max(w, 0.0) for w in leaf.target.values()), 1.0)
    return [max(leaf.target.get(label, 0.0), 0.0) / n for label in labels]


def score(rows: DataFrame, trees: dict[int, T.Tree], labels: list[str], order: str = "depth", source: Source | None = None, case_nodes: int = CASE_NODES) -> DataFrame:
    """The columns of rows (a table or a stream) and p_<label>, the soft vote of each label.

    A small tree is one CASE that gives the shares of its leaf; trees of more than case_nodes nodes are walked in Arrow
    batches.  No aggregation over rows: it runs in append mode, in one stage.
    """
    source, out = source or Columns(rows), rows
    small = {i: t for i, t in trees.items() if sum(1 for _ in T.with_paths(t)) <= case_nodes}
    large = {i: t for i, t in trees.items() if i not in small}
    id_ = F.col("id") if "id" in rows.columns else F.lit(None).cast("string")
    votes = [F.array(*[F.lit(0.0)] * len(labels))]
    if large:
        walked = "__walked"
        while walked in rows.columns:
            walked += "_"
        of = {i: {x.index: shares(x, labels) for x in T.leaves(t)} for i, t in large.items()}
        out = votes_by_walk(rows, Walker(large, order), source, of, len(labels), walked)
        votes.append(F.col(walked))
    for i, t in small.items():
        votes.append(leaf_case(t, source, order, id_, "traversal", i, of=lambda leaf: F.array(*map(F.lit, shares(leaf, labels)))))
    total = votes[0]
    for more in votes[1:]:
        total = F.zip_with(total, more, lambda a, b: a + b)
    return out.select(*[F.col(name(c)) for c in rows.columns], *[(total[k] / len(trees)).alias(f"p_{label}") for k, label in enumerate(labels)])


def serve(rows: DataFrame, trees: dict[int, T.Tree], labels: list[str], checkpoint: str, path: str, fmt: str = "parquet"):
    """Start scoring a stream into files; returns the running query."""
    return score(rows, trees, labels).writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append").start(path)


def score_one(row: dict, trees: dict[int, T.Tree]) -> T.Target:
    """The soft vote for one row on the driver, as a scoring service would answer."""
    from ..operators.voting import soft_target

    found = [T.leaf_for(t, row, id_=row.get("id"), index=i) for i, t in trees.items()]
    return soft_target([x.target for x in found if x])
