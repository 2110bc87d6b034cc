"""Errors of predictions against actual labels.

Input: actual (id, label, weight) and predicted (id, label, p).  A row without any prediction counts nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.tree import Target

# ---------------------------------------------------------------- Brier score


def brier(actual: DataFrame, predicted: DataFrame, by: list[str] = (), classes: int | None = None, ids: list[str] = ("id",)) -> DataFrame:
    """Weighted mean over rows of the mean over labels of (1{label is the actual one} - p)^2.

    Labels whose difference is 0 don't count in the mean over labels, of which there is at least one, unless `classes`
    fixes its denominator.  Columns `by` are in both inputs; without them, one row: brier and weight.
    """
    ids, by = [*ids, *(b for b in by if b not in ids)], list(by)
    p = predicted.select(*ids, F.col("label").alias("__l"), "p")
    a = actual.select(*ids, "label", "weight")
    pairs = a.join(p, ids)
    diff = F.when(F.col("__l") == F.col("label"), 1 - F.col("p")).otherwise(-F.col("p"))
    per = pairs.groupBy(*ids, "label", "weight").agg(
        F.sum(diff * diff).alias("__sq"),
        F.sum((diff != 0).cast("int")).alias("__n"),
        F.max((F.col("__l") == F.col("label")).cast("int")).alias("__hit"),
    )
    # A label that nobody predicted differs by 1.
    square = F.col("__sq") + F.when(F.col("__hit") == 1, 0.0).otherwise(1.0)
    count = F.col("__n") + F.when(F.col("__hit") == 1, 0).otherwise(1)
    x = square / (F.lit(classes) if classes else F.greatest(count, F.lit(1)))
    out = per.withColumn("__x", x)
    aggregates = (F.try_divide(F.sum(F.col("__x") * F.col("weight")), F.sum("weight")).alias("brier"), F.sum("weight").alias("weight"))
    return out.groupBy(*by).agg(*aggregates) if by else out.agg(*aggregates)


def brier_target(actual: Target, predicted: Target) -> tuple[float, float]:
    """The same for one prediction on the driver: mean and weight."""
    n = sum(actual.values())
    if not predicted or not n:
        return 0.0, 0.0
    out = 0.0
    for label, w in actual.items():
        diffs = [(k == label) - predicted.get(k, 0.0) for k in {*predicted, label}]
        out += w * sum(d * d for d in diffs) / max(sum(d != 0 for d in diffs), 1)
    return out / n, n


# ---------------------------------------------------------------- accuracy


def accuracy(actual: DataFrame, predicted: DataFrame, by: list[str] = (), ids: list[str] = ("id",)) -> DataFrame:
    """Weights of rows whose most probable label (the smaller of equals) is, and is not, the actual one."""
    ids, by = [*ids, *(b for b in by if b not in ids)], list(by)
    best = predicted.groupBy(*ids).agg(F.min_by("label", F.struct((-F.col("p")).alias("p"), "label")).alias("__best"))
    hit = F.col("label") == F.col("__best")
    aggregates = (
        F.coalesce(F.sum(F.when(hit, F.col("weight"))), F.lit(0)).cast("double").alias("correct"),
        F.coalesce(F.sum(F.when(~hit, F.col("weight"))), F.lit(0)).cast("double").alias("incorrect"),
    )
    joined = actual.join(best, ids)
    return joined.groupBy(*by).agg(*aggregates) if by else joined.agg(*aggregates)


def accuracy_target(actual: Target, predicted: Target) -> tuple[float, float]:
    if not predicted:
        return 0.0, 0.0
    best = min(predicted, key=lambda k: (-predicted[k], str(k)))
    right = actual.get(best, 0.0)
    return right, sum(actual.values()) - right


# ---------------------------------------------------------------- binned binary errors


def binned_errors(scored: DataFrame, p: Column | str = "p", positive: Column | str = "positive", weight: str = "weight", bins: int = 100) -> DataFrame:
    """(bin, t, f): the weight of positive and of negative rows by the whole percent of p."""
    p, positive = (F.col(c) if isinstance(c, str) else c for c in (p, positive))
    return scored.groupBy(F.floor(p * bins).cast("int").alias("bin")).agg(
        F.sum(F.when(positive, F.col(weight)).otherwise(0)).cast("double").alias("t"),
        F.sum(F.when(positive, 0).otherwise(F.col(weight))).cast("double").alias("f"),
    )


def confusion_by_threshold(bins: DataFrame) -> DataFrame:
    """A confusion matrix (bin, tp, tn, fp, fn) for each observed bin as threshold.  At most as many rows as bins."""
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    before = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0.0))
    return bins.select("bin", F.sum("t").over(upto).alias("tp"), before("f").alias("tn"), F.sum("f").over(upto).alias("fp"), before("t").alias("fn"))


def auc(bins: DataFrame) -> DataFrame:
    """The area under the curve of true against false positive rate, by trapezoids from (0, 0); null without both classes."""
    m = confusion_by_threshold(bins)
    rates = m.select("bin", F.try_divide("fp", F.col("fp") + F.col("tn")).alias("x"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("y"))
    order = Window.orderBy(F.desc("bin"))
    before = lambda c: F.coalesce(F.lag(c).over(order), F.lit(0.0))
    area = rates.select(((F.col("x") - before("x")) * (F.col("y") + before("y")) / 2).alias("a"))
    return area.agg(F.sum("a").alias("auc"))


RATES = {
    "positives": "tp + fn",
    "negatives": "fp + tn",
    "sensitivity": "try_divide(tp, tp + fn)",
    "specificity": "try_divide(tn, fp + tn)",
    "ppv": "try_divide(tp, tp + fp)",
    "npv": "try_divide(tn, tn + fn)",
    "fpr": "try_divide(fp, fp + tn)",
    "fdr": "try_divide(fp, fp + tp)",
    "fnr": "try_divide(fn, fn + tp)",
    "accuracy": "try_divide(tp + tn, tp + fn + fp + tn)",
    "f1": "try_divide(2 * tp, 2 * tp + fp + fn)",
    "recall": "try_divide(tp, tp + fn)",
    "tpr": "try_divide(tp, tp + fn)",
    "tnr": "try_divide(tn, fp + tn)",
    "precision": "try_divide(tp, tp + fp)",
}


def rates(confusion: DataFrame) -> DataFrame:
    """The derived rates of confusion matrices (tp, tn, fp, fn); null where the denominator is 0."""
    return confusion.select("*", *[F.expr(e).alias(n) for n, e in RATES.items()])
