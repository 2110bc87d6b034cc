"""Quality scores: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Tokens are runs of letters and digits, and runs of other signs.  n-grams of one and two tokens are taken of the
tokens themselves (lower-cased) and, of one to three, of their shapes: kind, capitals, digits, length class and
whether a token repeats the one before.  Each is hashed to one of 2**BITS weights; a text's score is the logistic of
the dot product of the weights with its n-gram frequencies, a sparse dot product over its own n-grams.

The regression is fitted on at most SAMPLE labelled rows, in one task and in a fixed order; what leaves the
task is the vector of weights (2**BITS floats), whatever the corpus.

Edge cases: null and empty texts have no n-grams and score the logistic of the bias; without labelled documents of
both classes every score is the share of label 1 (0.5 without labels); repeated rows are scored alike; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, map_arrow, materialise, mix, span_hashes, spread, table, texts_of
from .scoring import append_score, fold, labelled_sample, per_doc

SAMPLE, BITS = 12_000, 18
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 4
SCALE = 8.0  # of frequencies: an n-gram that is the whole text counts SCALE times its weight

_kind = np.ones(256, np.int8)  # 0 space, 1 sign, 2 letter or digit
_kind[:33] = 0
_kind[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 2


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all n-grams and where each text's begin."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    at = np.cumsum([0, *(len(r) + 1 for r in raw)])
    plain = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    low = np.frombuffer(b"\n".join([*(r.lower() for r in raw), b""]), np.uint8)  # ASCII only: lengths stay
    kind = np.concatenate([[0], _kind[plain], [0]])
    edge = np.flatnonzero(kind[1:] != kind[:-1])  # a token begins or ends at each
    start = edge[kind[edge + 1] > 0]
    end = np.append(edge, len(plain))[np.searchsorted(edge, start) + 1]
    first, n = np.searchsorted(start, at), len(start)
    word = span_hashes(low, start, end)
    capital = np.concatenate([[0], np.cumsum((plain >= 65) & (plain <= 90))])
    digit = np.concatenate([[0], np.cumsum((plain >= 48) & (plain <= 57))])
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    size, capitals = end - start, capital[end] - capital[start]
    same = np.zeros(n, bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    shape = _kind[plain[start]].astype(np.int64) * 1000 + np.minimum(size, 12) // 3 * 100 + (digit[end] > digit[start]) * 10
    shape = shape + np.where(capitals == 0, 0, np.where(capitals == size, 3, np.where(capitals == 1, 1, 2))) + same * 5
    # Of a sign token the shape is the token itself.
    shape = np.where(_kind[plain[start]] == 1, word ^ U64(0xC2B2AE3D27D4EB4F), mix(shape.astype(U64)))
    families = []
    for base, length in ((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3)):
        h = np.full(n, length * 977 + (base is shape), U64)
        for k in range(length):
            shifted = np.full(n, k + 1, U64)  # past the end of a text
            shifted[: n - k] = np.where(doc[: n - k] == doc[k:], base[k:], U64(k + 1)) if k else base
            h = mix(h ^ shifted)
        families.append(h)
    index = (np.stack(families, axis=1) >> U64(64 - BITS)).astype(np.int64).ravel()
    return index, first * len(families)


@dataclass
class Model:
    weights: np.ndarray | None
    bias: float

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.bias)
        index, first = ngrams(texts)
        total = per_doc(self.weights[index], first) * SCALE / np.maximum(np.diff(first), 1)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (label, indices, values) in the given order; index 2**BITS is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for y, i, x in rows:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(slice(None))
    return w[:-1], float(w[-1])


def _features(b: pa.RecordBatch) -> pa.RecordBatch:
    index, first = ngrams(texts_of(b))
    ids, values = [], []
    for lo, hi in zip(first[:-1], first[1:]):
        i, n = np.unique(index[lo:hi], return_counts=True)
        ids.append(i.astype(np.int32).tobytes())
        values.append((n * (SCALE / max(hi - lo, 1))).astype(np.float32).tobytes())
    return pa.RecordBatch.from_arrays([b.column("y"), b.column("rank"), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], ["y", "rank", "i", "x"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        for y, _, i, x in zip(*(b.column(c).to_pylist() for c in ("y", "rank", "i", "x"))):
            ids = np.append(np.frombuffer(i, np.int32), 1 << BITS)
            rows.append((y, ids, np.append(np.frombuffer(x, np.float32), 1.0)))
    w, bias = ftrl(rows)
    yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], ["w", "bias"])


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", size: int = SAMPLE) -> Model:
    """A model learned from at most `size` labelled rows that satisfy `keep` (a condition on doc_id)."""
    sample = labelled_sample(docs, labels, label, keep, size).select("y", "text", F.xxhash64("text", F.lit(11)).alias("rank"))
    sample = materialise(map_arrow(sample, _features, "y int, rank long, i binary, x binary"), "sample")
    positives, total = sample.agg(F.sum("y"), F.count("*")).first()
    if not positives or positives == total:
        return Model(None, positives / total if total else 0.5)
    row = sample.repartition(1).sortWithinPartitions("rank", "y", "i").mapInArrow(_train, "w binary, bias double").first()
    return Model(np.frombuffer(row[0], np.float32), row[1])


def op7_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = spread(table(spark, sf_dir, "documents")), F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    scored = append_score(docs, ["doc_id"], fit(docs, table(spark, sf_dir, "labels"), ~held_out), "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
