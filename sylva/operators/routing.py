"""Routing of rows to the leaves of trees.

Shallow trees are compiled to one nested CASE per tree, which stays inside whole-stage code generation and needs no
shuffle.  Deep or many-leaved trees are compressed to arrays that numpy walks over whole Arrow batches, in the scan's stage
as well, so that no expression grows with the tree; or, by route_by_level, a table of nodes is joined once a level.  All
ways give the same leaves.  Where a feature is missing (null or NaN), the order of the two children decides; the coin flips
of the random orders are hashes of the row's id and the node's path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import uniform
from ..plans import tree as T
from .features import Columns, Source, name
from .walk import ORDERS, Walker, leaves_by_walk, text_of

#: Nodes in all trees up to which a CASE is used.
CASE_NODES = 256
#: Rows of the node table up to which it is broadcast; beyond it the joins are shuffled.
BROADCAST_NODES = 500_000


def _nodes(trees: dict[int, T.Tree]) -> int:
    return sum(1 for t in trees.values() for _ in T.with_paths(t))


def test(source: Source, node: T.Node) -> Column:
    """Whether a row goes left at a node; null where the feature is missing."""
    v = node.predicate.value
    if T.is_number(v):
        return T.Predicate(node.predicate.op, float(v)).column(source.number(node.feature))
    return T.Predicate(node.predicate.op, text_of(v)).column(source.text(node.feature))


def left_first(node: T.Node, path: str, order: str, id_: Column | str = "id", seed: str = "traversal", tree: int = 0) -> Column:
    """Whether the left child of a node comes first for a row without its feature."""
    a, b = (float(x.annotation or 0) for x in (node.left, node.right))
    if order == "depth":
        return F.lit(True)
    if order == "weighted":
        return F.lit(a >= b)
    if order == "random":
        return uniform(seed, F.lit(tree), id_, F.lit(path)) < 0.5
    if order == "probabilistic":
        return uniform(seed, F.lit(tree), id_, F.lit(path)) * (a + b) < a
    raise ValueError(f"order is one of {ORDERS}")


def leaf_case(
    tree: T.Tree, source: Source, order: str = "depth", id_: Column | str = "id", seed: str = "traversal", index: int = 0,
    of: Callable[[T.Leaf], Column] = lambda leaf: F.lit(leaf.index),
) -> Column:
    """The index of the first leaf of a row, or what `of` gives for the leaf, as one expression."""

    def walk(t: T.Tree, path: str) -> Column:
        if isinstance(t, T.Leaf):
            return of(t)
        left = F.coalesce(test(source, t), left_first(t, path, order, id_, seed, index))
        return F.when(left, walk(t.left, path + "L")).otherwise(walk(t.right, path + "R"))

    return walk(tree, "")


def nodes_frame(spark: SparkSession, trees: dict[int, T.Tree]) -> DataFrame:
    """tree, path, leaf, feature, op, num, str, left_weight and right_weight: one row per node."""
    rows = []
    for i, tree in trees.items():
        for path, t in T.with_paths(tree):
            if isinstance(t, T.Leaf):
                rows.append((i, path, t.index, None, None, None, None, None, None))
            else:
                v = t.predicate.value
                number = T.is_number(v)
                a, b = (float(x.annotation or 0) for x in (t.left, t.right))
                rows.append((i, path, None, t.feature, t.predicate.op, float(v) if number else None, None if number else text_of(v), a, b))
    return spark.createDataFrame(rows, "tree int, path string, leaf int, feature string, op string, num double, str string, left_weight double, right_weight double")


def route_by_level(rows: DataFrame, trees: dict[int, T.Tree], order: str = "depth", seed: str = "traversal", source: Source | None = None, tree: str = "tree", leaf: str = "leaf") -> DataFrame:
    """Rows with the index of their first leaf in the tree named by column `tree`, by one join a level."""
    source, own = source or Columns(rows), list(rows.columns)
    frame = nodes_frame(rows.sparkSession, trees)
    if _nodes(trees) <= BROADCAST_NODES:
        frame = F.broadcast(frame)
    nodes = frame.toDF(*[f"__{c}" for c in frame.columns])
    # The input's columns go into a struct, so that none can be taken for a column of the table of nodes.
    features = {t.feature for x in trees.values() for _, t in T.with_paths(x) if isinstance(t, T.Node)}
    at = rows.select(F.struct("*").alias("__row"), F.col(name(tree)).alias("__tree"), *[c.alias(f"__{k}") for k, c in source.packed(features).items()], (F.col("id") if "id" in own else F.lit(None)).alias("__id"))
    number, text = source.unpacked("__feature")
    left = F.lit(None).cast("boolean")
    for op in T.OPERATORS:
        value = F.when(F.col("__num").isNotNull(), T.compare(op, number, F.col("__num"))).when(F.col("__str").isNotNull(), T.compare(op, text, F.col("__str")))
        left = F.when(F.col("__op") == op, value).otherwise(left)
    coin = uniform(seed, "__tree", "__id", "__path")
    first = {
        "depth": F.lit(True),
        "weighted": F.col("__left_weight") >= F.col("__right_weight"),
        "random": coin < 0.5,
        "probabilistic": coin * (F.col("__left_weight") + F.col("__right_weight")) < F.col("__left_weight"),
    }[order]
    kept = at.columns
    at = at.withColumn("__path", F.lit(""))
    for _ in range(max(map(T.depth, trees.values()), default=0)):
        step = F.when(F.col("__feature").isNull(), F.lit("")).when(F.coalesce(left, first), F.lit("L")).otherwise(F.lit("R"))
        at = at.join(nodes, ["__tree", "__path"], "left").select(*kept, F.concat("__path", step).alias("__path"))
    at = at.join(nodes.select("__tree", "__path", "__leaf"), ["__tree", "__path"])
    return at.select(*[F.col("__row").getField(c).alias(c) for c in own if c != leaf], F.col("__leaf").alias(leaf))


def route(
    rows: DataFrame, trees: dict[int, T.Tree], order: str = "depth", seed: str = "traversal", source: Source | None = None, tree: str = "tree", leaf: str = "leaf", case_nodes: int | None = None,
) -> DataFrame:
    """Rows with columns `tree` and `leaf`.  Rows without a column `tree` are routed through every tree.

    A column named like `leaf` is replaced, after its value was read as a feature; where a feature is named like `tree`, the
    caller gives these two other names.
    """
    source = source or Columns(rows)
    if tree not in rows.columns:
        rows = rows.withColumn(tree, F.explode(F.array(*[F.lit(i) for i in trees])))
    elif isinstance(source, Columns) and any(isinstance(t, T.Node) and source.column(t.feature) == tree for x in trees.values() for _, t in T.with_paths(x)):
        raise ValueError(f"{tree} is a feature: name the column of trees differently")
    if _nodes(trees) > (CASE_NODES if case_nodes is None else case_nodes):
        return leaves_by_walk(rows, Walker(trees, order, seed), source, tree=tree, leaf=leaf)
    found = F.lit(None).cast("int")
    for i, t in trees.items():
        found = F.when(F.col(name(tree)) == i, leaf_case(t, source, order, "id", seed, i)).otherwise(found)
    return rows.withColumn(leaf, found)


def all_leaves(
    rows: DataFrame, trees: T.Tree | dict[int, T.Tree], limit: int | None = None, order: str = "depth", seed: str = "traversal", source: Source | None = None, tree: str = "tree", leaf: str = "leaf", case_nodes: int | None = None,
) -> DataFrame:
    """Every leaf that a row may reach, in the order of a search: `ord` from 1, at most `limit` of them.

    trees: one tree, or several by number; then rows have a column `tree`, or are searched in every tree.  Where a feature
    is missing, the leaves of the child that comes first are before the other's.  Columns of these names are replaced, after
    their values were read as features.
    """
    if limit is not None and limit <= 0:
        raise ValueError("the limit must be positive")
    if order not in ORDERS:
        raise ValueError(f"order is one of {ORDERS}")
    source, columns = source or Columns(rows), rows.columns
    several = isinstance(trees, dict)
    trees = trees if several else {0: trees}
    number = name(tree) if several else "__tree"
    if not several:
        rows = rows.withColumn("__tree", F.lit(0))
    elif tree not in columns:
        rows, columns = rows.withColumn(tree, F.explode(F.array(*[F.lit(i) for i in trees]))), [*columns, tree]
    if _nodes(trees) > (CASE_NODES if case_nodes is None else case_nodes):
        out = leaves_by_walk(rows, Walker(trees, order, seed), source, tree=tree if several else "__tree", leaf=leaf, ord_="ord", limit=limit)
        return out if several else out.drop("__tree")
    cases = []

    def walk(i: int, t: T.Tree, condition: Column, path: str, key: list[Column]) -> None:
        if isinstance(t, T.Leaf):
            cases.append(F.when(condition, F.struct(F.concat(F.lit(""), *key).alias("key"), F.lit(t.index).alias("leaf"))))
            return
        here = test(source, t)
        first = left_first(t, path, order, "id", seed, i)
        # A digit for each node above: 0 on the side that comes first.
        walk(i, t.left, condition & F.coalesce(here, F.lit(True)), path + "L", [*key, F.when(first, F.lit("0")).otherwise(F.lit("1"))])
        walk(i, t.right, condition & F.coalesce(~here, F.lit(True)), path + "R", [*key, F.when(first, F.lit("1")).otherwise(F.lit("0"))])

    for i, t in trees.items():
        walk(i, t, F.col(number) == i, "", [])
    found = F.array_sort(F.array_compact(F.array(*cases)))
    if limit is not None:
        found = F.slice(found, 1, limit)
    out = rows.select(*[F.col(name(c)) for c in columns if c not in (leaf, "ord")], F.posexplode(found).alias("ord", "__leaf"))
    return out.withColumn("ord", F.col("ord") + 1).withColumn(leaf, F.col("__leaf.leaf")).drop("__leaf")


def targets_frame(spark: SparkSession, trees: dict[int, T.Tree]) -> DataFrame:
    """tree, leaf, label, weight, and the leaf's sum of positive weights and number of labels: the targets of all leaves.
    Up to BROADCAST_NODES of them are broadcast."""
    rows = [
        (i, x.index, str(k), float(w), float(sum(max(v, 0.0) for v in x.target.values())), len(x.target))
        for i, t in trees.items()
        for x in T.leaves(t)
        for k, w in x.target.items()
    ]
    out = spark.createDataFrame(rows, "tree int, leaf int, label string, weight double, total double, labels int")
    return F.broadcast(out) if len(rows) <= BROADCAST_NODES else out


def leaf_targets(routed: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """Sums of weights by (tree, leaf, label); rows without a label count nowhere."""
    routed = routed.where(F.col(label).isNotNull())
    return routed.groupBy("tree", "leaf", F.col(label).alias("label")).agg(F.sum(weight).alias("weight"))


def top_leaves(found: DataFrame, n: int) -> DataFrame:
    """The first n leaves of each row of a table with id, tree and ord."""
    order = Window.partitionBy("id", "tree").orderBy("ord")
    return found.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")
