"""What the two classifiers share: labelled samples of bounded size, and scores appended to rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, map_arrow, materialise, texts_of

Scorer = Callable[[list[str]], np.ndarray]


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, size: int) -> DataFrame:
    """(doc_id, y, text) of at most `size` labelled rows whose doc_id satisfies `keep`, chosen by hashes.

    A document with several labels counts as 1 if any is; equal rows count once.  `size` bounds the ids that are broadcast
    and, as an id may stand in many rows, the rows.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(size)
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = materialise(rows.withColumn("at", F.xxhash64("doc_id", "text")), "labelled")
    first = rows.select("at", "doc_id").distinct().orderBy("at", "doc_id").limit(size)
    return rows.join(F.broadcast(first), ["at", "doc_id"], "left_semi").dropDuplicates(["at", "doc_id"]).select("doc_id", "y", "text")


def append_score(docs: DataFrame, keep: list[str], scorer: Scorer, name: str) -> DataFrame:
    """The columns `keep` of docs and `name`, the score of the whole text (null: empty)."""

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(b)
        found = np.concatenate([scorer(texts[lo:hi]) for lo, hi in chunks(texts, 500_000)])
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(found, pa.float64())], [*keep, name])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])
    return map_arrow(docs.select(*dict.fromkeys([*keep, "text"])), score, schema)


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges that begin at first[i] and end at first[i + 1]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]
