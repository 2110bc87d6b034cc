"""Scores of candidate splits, the best split of each node, and when to stop splitting.

Candidates are rows (keys..., feature, op, num, str, label, lw, rw), see splitters.  An evaluator gives one row a candidate:
(keys..., feature, op, num, str, lt, rt, score), higher better, and leaves out candidates it can't judge.  Candidates with
a side of no weight are never splits.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CANDIDATE = ["feature", "op", "num", "str"]


def _grouped(candidates: DataFrame, keys: list[str], *scores: Column) -> DataFrame:
    sides = (F.sum("lw").alias("lt"), F.sum("rw").alias("rt"))
    return candidates.groupBy(*keys, *CANDIDATE).agg(*sides, *scores).where("lt > 0 and rt > 0")


class Evaluator(ABC):
    @abstractmethod
    def evaluate(self, candidates: DataFrame, keys: list[str]) -> DataFrame: ...


@dataclass(frozen=True)
class ChiSquared(Evaluator):
    """The chi-squared statistic of the label by side table.

    With label_multiplicity, a label counts once for each side on which it occurs, as when the keys of both sides
    are concatenated.
    """

    label_multiplicity: bool = False

    def evaluate(self, candidates, keys):
        if not self.label_multiplicity:
            # (l - b lt/n)^2 sums to n^2 / (lt rt) (sum of l^2 / b - lt^2 / n) over both sides, and so with r: by the lighter
            # side the numbers stay small, and equal counts score alike in any order of labels, however large n is.
            part = lambda c: F.sum(F.when(F.col("lw") + F.col("rw") > 0, F.col(c) * F.col(c) / (F.col("lw") + F.col("rw"))).otherwise(0.0))
            sums = _grouped(candidates, keys, part("lw").alias("l2"), part("rw").alias("r2"))
            lt, rt = F.col("lt"), F.col("rt")
            n = lt + rt
            lighter = F.when(lt <= rt, F.col("l2") - lt * lt / n).otherwise(F.col("r2") - rt * rt / n)
            return sums.withColumn("score", n / lt * (n / rt) * lighter).drop("l2", "r2")
        # Per candidate in one aggregation: sum over cells of (o - e)^2 / e = sum of o^2 / e - n, with e = side * label / n.
        many = (F.col("lw") > 0).cast("double") + (F.col("rw") > 0).cast("double")
        both = F.col("lw") + F.col("rw")
        square = lambda c: F.sum(F.when(both > 0, many * F.col(c) * F.col(c) / both).otherwise(0.0))
        cross = lambda c: F.sum(F.when(both > 0, many * F.col(c)).otherwise(0.0))
        sums = _grouped(
            candidates, keys, square("lw").alias("l2"), square("rw").alias("r2"), cross("lw").alias("l1"), cross("rw").alias("r1"),
            F.sum(F.when(both > 0, many * both).otherwise(0.0)).alias("m1"),
        )
        n, lt, rt = F.col("lt") + F.col("rt"), F.col("lt"), F.col("rt")
        # sum m (l - b lt/n)^2 / (b lt/n) = n/lt sum m l^2/b - 2 sum m l + lt/n sum m b
        left = n / lt * F.col("l2") - 2 * F.col("l1") + lt / n * F.col("m1")
        right = n / rt * F.col("r2") - 2 * F.col("r1") + rt / n * F.col("m1")
        return sums.withColumn("score", left + right).drop("l1", "l2", "r1", "r2", "m1")


@dataclass(frozen=True)
class MinWeight(Evaluator):
    """Only candidates both of whose sides satisfy a condition on their weight."""

    condition: Callable[[Column], Column]
    inner: Evaluator = ChiSquared()

    def evaluate(self, candidates, keys):
        return self.inner.evaluate(candidates, keys).where(self.condition(F.col("lt")) & self.condition(F.col("rt")))


@dataclass(frozen=True)
class BrierSplit(Evaluator):
    """Minus the mean squared error of each side's label shares against its own labels, weighted."""

    def evaluate(self, candidates, keys):
        # A side's sum over rows and labels of (1{label} - p)^2 is total - sum of w^2 / total.
        square = lambda c: F.sum(F.col(c) * F.col(c))
        sums = _grouped(candidates, keys, square("lw").alias("l2"), square("rw").alias("r2"))
        lt, rt = F.col("lt"), F.col("rt")
        return sums.withColumn("score", -(lt - F.col("l2") / lt + rt - F.col("r2") / rt) / (lt + rt)).drop("l2", "r2")


@dataclass(frozen=True)
class AccuracySplit(Evaluator):
    """Minus the share of rows whose label isn't the most frequent one of their side."""

    def evaluate(self, candidates, keys):
        sums = _grouped(candidates, keys, F.max("lw").alias("lm"), F.max("rw").alias("rm"))
        n = F.col("lt") + F.col("rt")
        return sums.withColumn("score", -(n - F.col("lm") - F.col("rm")) / n).drop("lm", "rm")


@dataclass(frozen=True)
class ErrorSplit(Evaluator):
    """Minus a caller's error of both sides, an aggregate expression over columns lw, rw and label."""

    error: Callable[[], Column]

    def evaluate(self, candidates, keys):
        return _grouped(candidates, keys, self.error().alias("__e")).withColumn("score", -F.col("__e")).drop("__e")


class _Columns:
    """Vectors by label as arrays of a column."""

    total = staticmethod(lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x))
    most = staticmethod(lambda v: F.array_max(v))
    least1 = staticmethod(lambda t: F.greatest(t, F.lit(1.0)))
    scaled = staticmethod(lambda v, t: F.transform(v, lambda x: x / t))
    both = staticmethod(lambda f, a, b: F.zip_with(a, b, f))

    @staticmethod
    def first(v: Column, m: Column) -> Column:
        """1 at the first label whose number is m, 0 elsewhere."""
        at = F.array_position(v, m)
        return F.transform(v, lambda x, i: F.when(i + 1 == at, 1.0).otherwise(0.0))


class _Arrays:
    """Vectors by label as rows of numpy arrays."""

    total = staticmethod(lambda v: v.sum(axis=1, keepdims=True))
    most = staticmethod(lambda v: v.max(axis=1, keepdims=True))
    least1 = staticmethod(lambda t: np.maximum(t, 1.0))
    scaled = staticmethod(lambda v, t: v / t)
    both = staticmethod(lambda f, a, b: f(a, b))
    first = staticmethod(lambda v, m: (np.arange(v.shape[1]) == (v == m).argmax(axis=1)[:, None]).astype(float))


#: What a target's weights by label, in the order of labels, make a leaf predict: a number for each label.
VOTERS = {
    "soft": lambda w, o: o.scaled(w, o.least1(o.total(w))),
    "mode": lambda w, o: o.first(w, o.most(w)),
}
#: What a prediction p costs on the rows of weights w, summed over them.
ERRORS = {
    "brier": lambda w, p, o: o.total(o.both(lambda a, q: a * (1 - 2 * q), w, p)) + o.total(w) * o.total(o.both(lambda q, r: q * r, p, p)),
    "accuracy": lambda w, p, o: o.total(w) - o.total(o.both(lambda a, q: a * q, w, o.first(p, o.most(p)))),
}


@dataclass(frozen=True)
class VotedError(Evaluator):
    """Minus the mean error, over the rows of both sides, of what a voter makes of each side.

    error and voter are names of ERRORS and VOTERS, or functions like those: written once, over vectors by label, they run
    on Spark's arrays and, where a tree grows in one task, on numpy's.
    """

    error: str | Callable = "brier"
    voter: str | Callable = "soft"

    def of(self, w, o):
        """The error of one side."""
        error, voter = (kinds[f] if isinstance(f, str) else f for f, kinds in ((self.error, ERRORS), (self.voter, VOTERS)))
        return error(w, voter(w, o), o)

    def evaluate(self, candidates, keys):
        # A row a label is few: the labels of one candidate, in their order.
        cells = F.sort_array(F.collect_list(F.struct(F.col("label").alias("label"), F.col("lw").cast("double").alias("l"), F.col("rw").cast("double").alias("r"))))
        sums = _grouped(candidates, keys, cells.alias("__cells"))
        sums = sums.withColumns({"__l": F.col("__cells.l"), "__r": F.col("__cells.r")})
        cost = self.of(F.col("__l"), _Columns) + self.of(F.col("__r"), _Columns)
        return sums.withColumn("score", -cost / (F.col("lt") + F.col("rt"))).drop("__cells", "__l", "__r")

    def local(self, w: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The errors of sides w (sides x labels)."""
        return self.of(w, _Arrays)[:, 0]


def best_splits(scored: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """The best candidate of each node; ties of the rounded score go to the smaller feature, then value."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", digits)), "feature", "op", F.asc_nulls_last("num"), "str")
    ok = scored.where(F.col("score").isNotNull() & ~F.isnan("score"))
    return ok.withColumn("__r", F.row_number().over(order)).where(F.col("__r") == 1).drop("__r")


@dataclass(frozen=True)
class Stopper:
    """Leaves with more than one label and more than min_size of weight are split; those with more than max_in_memory
    on the cluster, the others in one task, downsampled to about max_in_memory."""

    max_in_memory: float = 10_000
    min_size: float = 10

    def splits(self, target: dict) -> bool:
        return sum(w > 0 for w in target.values()) > 1 and sum(target.values()) > self.min_size

    def splits_distributed(self, target: dict) -> bool:
        return sum(target.values()) > self.max_in_memory

    def local_rate(self, target: dict) -> float:
        return min(1.0, self.max_in_memory / max(sum(target.values()), 1e-300))

    def columns(self, leaves: DataFrame, keys: list[str]) -> DataFrame:
        """The same three rules on (keys..., label, weight): splits, splits_distributed, local_rate."""
        totals = leaves.groupBy(*keys).agg(F.sum("weight").alias("total"), F.sum((F.col("weight") > 0).cast("int")).alias("labels"))
        return totals.select(
            *keys,
            "total",
            ((F.col("labels") > 1) & (F.col("total") > self.min_size)).alias("splits"),
            (F.col("total") > self.max_in_memory).alias("splits_distributed"),
            F.least(F.lit(1.0), F.lit(float(self.max_in_memory)) / F.col("total")).alias("local_rate"),
        )
