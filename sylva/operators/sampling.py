"""Samplers: which rows train which tree, which validate it, and which features a node may split on.

A sampler gives Columns.  `times(tree)` is how often a row is in the tree's training set, `validates(tree)` whether it
is in its validation set, `feature(tree, node, name)` whether a node may use a feature.  `tree` is a Column or an int, so
the same sampler works on one tree and on rows joined to all trees.  All randomness is a hash of the row's id: samples
don't depend on partitioning, and a row with the same id is always treated alike.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from dataclasses import dataclass, replace
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hash32, uniform

BUCKETS = 1 << 16  # parts of a range of values, of which one holds a quantile


def _tree(tree: Column | int) -> Column:
    return tree if isinstance(tree, Column) else F.lit(tree)


class Sampler(ABC):
    num_trees: int
    id_column: str = "id"
    time_column: str = "ts"

    @abstractmethod
    def times(self, tree: Column | int) -> Column: ...

    def validates(self, tree: Column | int) -> Column:
        return self.times(tree) == 0

    def feature(self, tree: Column | int, node: Column | int, name: Column) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class SingleTree(Sampler):
    """One tree that trains, and validates, on all rows."""

    num_trees: int = 1

    def times(self, tree):
        return F.lit(1)

    def validates(self, tree):
        return F.lit(True)


@dataclass(frozen=True)
class KFold(Sampler):
    """Tree t leaves out fold t; the fold of a row is its hash modulo the number of trees."""

    num_trees: int
    seed: str = "kfold"

    def fold(self) -> Column:
        return F.pmod(hash32(self.seed, self.id_column), F.lit(self.num_trees)).cast("int")

    def times(self, tree):
        return F.when(self.fold() == _tree(tree), 0).otherwise(1)


def poisson_count(u: Column, rate: float) -> Column:
    """Inverse of the Poisson distribution at u: how many terms of its distribution function lie at or below u."""
    terms, p, cdf = [], math.exp(-rate), 0.0
    for k in range(int(rate + 12 * math.sqrt(rate) + 12)):
        cdf += p
        p *= rate / (k + 1)
        if 1 - cdf < 2.0**-33:
            break
        terms.append(cdf)

    def count(v: Column) -> Column:
        out = F.lit(0)
        for c in terms:
            out = out + (v >= F.lit(c)).cast("int")
        return out

    # A variable of its own, so that u, which may be a hash, is worked out once and not for each term.
    return F.element_at(F.transform(F.array(u), count), 1)


@dataclass(frozen=True)
class RandomForest(Sampler):
    """Bootstrap counts from a Poisson distribution, and a random subset of features at every node.

    Rows drawn 0 times are out of the bag and validate.
    """

    num_trees: int
    feature_rate: float
    sampling_rate: float = 1.0
    seed: str = "rf"

    def times(self, tree):
        return poisson_count(uniform(self.seed, _tree(tree), self.id_column), self.sampling_rate)

    def feature(self, tree, node, name):
        node = node if isinstance(node, Column) else F.lit(node)
        return uniform(self.seed + "-feature", _tree(tree), node, name) < self.feature_rate


@dataclass(frozen=True)
class TimeGrouped(Sampler):
    """Trees of `base` for each of `groups` phases of time: a row trains trees of its own phase only.

    With `strict`, a row validates only if the base sampler says so too.
    """

    base: Sampler
    period: int
    groups: int
    strict: bool = False

    @property
    def num_trees(self) -> int:
        return self.base.num_trees * self.groups

    def times(self, tree):
        t = _tree(tree)
        phase = F.pmod(F.floor(F.col(self.time_column) / self.period), F.lit(self.groups))
        inner = self.base.times(F.floor(t / self.groups).cast("int"))
        return F.when(phase == F.pmod(t, F.lit(self.groups)), inner).otherwise(0)

    def validates(self, tree):
        out = self.times(tree) == 0
        return out & self.base.validates(F.floor(_tree(tree) / self.groups).cast("int")) if self.strict else out

    def feature(self, tree, node, name):
        return self.base.feature(tree, node, name)


@dataclass(frozen=True)
class OutOfTime(Sampler):
    """Rows before the threshold train as the base sampler says; rows from it on validate every tree."""

    base: Sampler
    threshold: int

    @property
    def num_trees(self) -> int:
        return self.base.num_trees

    def times(self, tree):
        return F.when(F.col(self.time_column) < self.threshold, self.base.times(tree)).otherwise(0)

    def validates(self, tree):
        return F.col(self.time_column) >= self.threshold

    def feature(self, tree, node, name):
        return self.base.feature(tree, node, name)


def exact_quantile(rows: DataFrame, column: str, quantile: float) -> int:
    """The value of a column of whole numbers at rank ceil(quantile * rows), as percentile_disc.

    The range is cut into BUCKETS equal parts, their rows are counted, and the part that holds the rank is cut again: a pass
    each, four at most, in which no task holds more than a count for each part.
    """
    rows = rows.select(F.col(column).cast("long").alias("__v"))
    n, low, high = rows.agg(F.count("__v"), F.min("__v"), F.max("__v")).first()
    if not n:
        raise ValueError(f"no values in {column}")
    rank = max(1, math.ceil(Fraction(str(quantile)) * n))
    while low < high:
        width = -(-(high - low + 1) // BUCKETS)
        parts = rows.where(F.col("__v").between(low, high)).groupBy(F.expr(f"(__v - {low}L) div {width}L").alias("part")).count()
        for part, count in sorted(map(tuple, parts.collect())):
            if rank <= count:
                low, high = low + part * width, min(high, low + (part + 1) * width - 1)
                break
            rank -= count
    return low


def out_of_time(base: Sampler, rows: DataFrame, quantile: float = 0.8, exact: bool = True, compression: int | None = None, finest: int = 20) -> OutOfTime:
    """OutOfTime with the threshold at a quantile of the rows' times, or near it if not `exact`; with `compression`, at the upper bound that a dyadic
    tree of times compressed so knows of it, times told apart down to 2**finest."""
    if compression is not None:
        from .splitters import dyadic_quantiles

        stats = rows.groupBy(F.col(base.time_column).cast("double").alias("num")).agg(F.count("*").cast("double").alias("w"))
        stats = stats.where("num is not null").select(F.lit("ts").alias("feature"), "num", F.lit(None).cast("string").alias("str"), F.lit("all").alias("label"), "w")
        return OutOfTime(base, int(dyadic_quantiles(stats, [], quantile, compression, finest, 62 - finest).first()["upper"]))
    if exact:
        return OutOfTime(base, exact_quantile(rows, base.time_column, quantile))
    at = F.percentile_approx(F.col(base.time_column), F.lit(quantile), F.lit(1_000_000))
    return OutOfTime(base, int(rows.agg(at.cast("long")).first()[0]))


def training_rows(rows: DataFrame, sampler: Sampler, weight: str = "weight") -> DataFrame:
    """Rows times trees, without those that don't train; the weight is multiplied by the number of copies."""
    numbers = F.sequence(F.lit(0), F.lit(sampler.num_trees - 1))
    # Drawn inside the array: a filter after the explode would work out the sampler's hashes again.
    drawn = F.transform(numbers, lambda t: F.struct(t.alias("tree"), sampler.times(t).cast("int").alias("times")))
    out = rows.withColumn("__drawn", F.explode(F.filter(drawn, lambda d: d["times"] > 0)))
    return out.withColumns({"tree": F.col("__drawn.tree"), weight: F.col(weight) * F.col("__drawn.times")}).drop("__drawn")


def validation_rows(rows: DataFrame, sampler: Sampler) -> DataFrame:
    """Rows times the trees that they validate."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(sampler.num_trees - 1)))
    return rows.withColumn("tree", trees).where(sampler.validates(F.col("tree")))


def with_seed(sampler: Sampler, seed: str) -> Sampler:
    return replace(sampler, seed=seed)


def downsampled(rows: DataFrame, rate: Column, seed: str = "local") -> DataFrame:
    """Rows kept with a probability (a Column), by a hash of (id, tree, leaf)."""
    return rows.where(uniform(seed, "id", "tree", "leaf") < rate)


def sampled_leaves(leaves: DataFrame, most: int, seed: str = "leaves") -> DataFrame:
    """At most `most` leaves of each tree, chosen by hash: a bottom-k sample."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("tree").orderBy(hash32(seed, "tree", "leaf"), "leaf")
    return leaves.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most).drop("__r")
