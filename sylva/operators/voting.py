"""Votes: the targets of the trees that predict a row, combined.

Input of a voter: (id, tree, label, weight), the target of the leaf that the row reaches in each tree; or, for `mean`,
(id, tree, value).  Output: (id, label, p), or one value per id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans.tree import Target
from ..sources.storage import on_workers


def predictions(routed: DataFrame, targets: DataFrame, keep: list[str] = ("id",)) -> DataFrame:
    """Rows with (tree, leaf) joined to the leaves' targets."""
    return routed.select(*keep, "tree", "leaf").join(targets, ["tree", "leaf"]).drop("leaf")


def soft(votes: DataFrame, ids: list[str] = ("id",)) -> DataFrame:
    """The mean over trees of each tree's shares; negative weights count 0, and a total below 1 counts 1.

    Votes that bring their leaf's total and number of labels, as those of predictions() do, are summed in one shuffle.
    """
    ids = list(ids)
    if not {"total", "labels"} <= set(votes.columns):
        per_tree = Window.partitionBy(*ids, "tree")
        votes = votes.withColumn("total", F.sum(F.greatest("weight", F.lit(0.0))).over(per_tree)).withColumn("labels", F.count("*").over(per_tree))
    share = F.greatest("weight", F.lit(0.0)) / F.greatest("total", F.lit(1.0))
    summed = votes.groupBy(*ids, "label").agg(F.sum(share).alias("__s"), F.sum(1 / F.col("labels")).alias("__t"))
    trees = F.round(F.sum("__t").over(Window.partitionBy(*ids)))
    return summed.select(*ids, "label", (F.col("__s") / trees).alias("p"))


def mode(votes: DataFrame, ids: list[str] = ("id",)) -> DataFrame:
    """The share of trees whose largest label it is; ties go to the smaller label."""
    ids = list(ids)
    best = votes.groupBy(*ids, "tree").agg(F.min_by("label", F.struct((-F.col("weight")).alias("w"), "label")).alias("label"))
    per_id = Window.partitionBy(*ids)
    counted = best.groupBy(*ids, "label").agg(F.count("*").alias("n"))
    return counted.select(*ids, "label", (F.col("n") / F.sum("n").over(per_id)).alias("p"))


def threshold(shares: DataFrame, at: float, label: str = "true", ids: list[str] = ("id",)) -> DataFrame:
    """Whether the share of a label exceeds `at`; a label without votes has share 0."""
    p = F.coalesce(F.max(F.when(F.col("label") == label, F.col("p"))), F.lit(0.0))
    return shares.groupBy(*ids).agg((p > at).alias("vote"))


def mean(values: DataFrame, value: str = "value", ids: list[str] = ("id",)) -> DataFrame:
    """The mean of the trees' numbers; 0 without any."""
    return values.groupBy(*ids).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("vote"))


def combined(votes: DataFrame, aggregate: Column, ids: list[str] = ("id",), name: str = "vote") -> DataFrame:
    """Any aggregate of the votes of an id."""
    return votes.groupBy(*ids).agg(aggregate.alias(name))


def folded(votes: DataFrame, fold: Callable[[list[Target]], Target], ids: list[str] = ("id",)) -> DataFrame:
    """Any function of the list of targets that an id's trees give, one for each tree in their order: (ids..., label, p).

    For aggregates that no Column expresses: votes of an id are collected (a row a tree and label), and the function runs in
    Arrow batches of ids.  Labels are texts.
    """
    ids = list(ids)
    on_workers(votes.sparkSession)
    cells = F.sort_array(F.collect_list(F.struct("tree", F.col("label").cast("string").alias("label"), F.col("weight").cast("double").alias("weight"))))
    rows = votes.groupBy(*ids).agg(cells.alias("__cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, labels, shares = [], [], []
            for k, own in enumerate(b.column(b.num_columns - 1).to_pylist()):
                targets: dict[int, Target] = {}
                for c in own:
                    targets.setdefault(c["tree"], {})[c["label"]] = c["weight"]
                for label, p in fold(list(targets.values())).items():
                    at.append(k)
                    labels.append(label)
                    shares.append(float(p))
            kept = [c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(labels, pa.string()), pa.array(shares, pa.float64())], [*ids, "label", "p"])

    fields = [votes.schema[c] for c in ids] + [T.StructField("label", T.StringType()), T.StructField("p", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType(fields))


def adapted(voter: Callable, before: Callable | None = None, after: Callable | None = None) -> Callable:
    """A voter that votes on before(votes) and returns after(result); of tables, or of lists of targets.

    A `before` that changes weights or labels of a table keeps only (ids, tree, label, weight), as totals change with them.
    """

    def vote(votes, *args, **kwargs):
        result = voter(before(votes) if before else votes, *args, **kwargs)
        return after(result) if after else result

    return vote


# The same on the driver, for single rows and for pruning.


def soft_target(targets: list[Target]) -> Target:
    out: Target = {}
    for t in targets:
        clean = {k: max(w, 0.0) for k, w in t.items()}
        n = max(sum(clean.values()), 1.0)
        for k, w in clean.items():
            out[k] = out.get(k, 0.0) + w / n / len(targets)
    return out


def mode_target(targets: list[Target]) -> Target:
    best = [min(t, key=lambda k: (-t[k], str(k))) for t in targets if t]
    return {k: best.count(k) / len(best) for k in dict.fromkeys(best)}


def threshold_target(voter: Callable[[list[Target]], Target], at: float, label=True) -> Callable[[list[Target]], bool]:
    return lambda targets: voter(targets).get(label, 0.0) > at


def mean_target(values: list[float]) -> float:
    return sum(values) / len(values) if values else 0.0
