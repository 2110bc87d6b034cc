"""Whole runs: cross-validated training with validation, importance and pruning, on the cluster or one level at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..operators import metrics
from ..operators.evaluate import Stopper
from ..operators.sampling import KFold, SingleTree
from ..operators.splitters import Feature
from ..sources.instances import from_csv, write_metrics
from .forest import Forest


def cross_validated(rows: DataFrame, features: tuple[Feature, ...], base: str, folds: int = 4, levels: int = 3, local_levels: int = 10, stopper: Stopper = Stopper()) -> Forest:
    """Levels on the cluster, then in memory; errors and importances before and after pruning go to files below base."""
    forest = Forest(rows, features, KFold(folds), stopper=stopper).expand_times(levels, base).expand_in_memory(local_levels, f"{base}/grown")
    write_metrics(forest.validate(), f"{base}/brier")
    write_metrics(forest.feature_importance(), f"{base}/importance")
    forest = forest.update_targets().prune(path=f"{base}/pruned")
    write_metrics(forest.validate(), f"{base}/brier_pruned")
    write_metrics(forest.feature_importance(), f"{base}/importance_pruned")
    return forest


def from_labelled_text(spark: SparkSession, path: str, names: list[str], base: str, kind: str = "continuous", **how) -> Forest:
    """cross_validated on text lines whose last field is the label."""
    return cross_validated(from_csv(spark, path, names), tuple(Feature(n, kind) for n in names), base, **how)


def one_leaf_at_a_time(rows: DataFrame, features: tuple[Feature, ...], steps: int, stopper: Stopper = Stopper()) -> Iterator[tuple[Forest, float]]:
    """A single tree that splits one leaf a step, with its accuracy on its own rows after each."""
    forest = Forest(rows, features, SingleTree(), stopper=stopper).update_targets()
    for _ in range(steps):
        forest = forest.expand(max_leaves=1, local=True)
        right, wrong = forest.validate(metrics.accuracy).first()
        yield forest, right / max(right + wrong, 1)
