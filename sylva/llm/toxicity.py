"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words (a small fixed list, and words and word beginnings learned from
labelled documents), how near they stand to a second-person pronoun, rates of capitals, punctuation and
obfuscation (digits or signs in place of letters, letters drawn out), and length.

The model is fitted on at most SAMPLE labelled rows.  Lexicons are learned in two folds, and a document's
features for the fit use the lexicon of the other fold, so that a word seen in one document only doesn't
explain that document.  Three quarters of the sample grow the trees, one quarter calibrates them.

Edge cases: null and empty texts have all-zero features and get a score as any other; without labelled
documents of both classes every score is the share of label 1 (0 without labels); repeated rows are scored
alike; an empty table gives an empty table; other columns are ignored, or kept by reject().
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, kept, map_arrow, materialise, sealed, spread, table, texts_of
from .scoring import append_score, fold, labelled_sample, per_doc

SAMPLE = 12_000  # labelled rows for the fit
SUPPORT, ODDS = (3, 0.004), 8.0  # a lexicon entry: in so many toxic documents and so large a share of them; odds against others

# Words that insult in any corpus, and second-person pronouns of the corpus's languages.
INSULTS = frozenset("idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown dumb".split())
SECOND = frozenset(
    "you your yours yourself u ur tu toi te vous votre vos ton ta tes du dich dir dein deine ihr euch euer sie"
    " usted ustedes ti tú tuyo vosotros vuestro".split()
)
LEET = str.maketrans("013457@$!", "oieastasi")
PREFIXES = (4, 5, 6)
NEAR = 5

WORDS = re.compile(r"[^\W_](?:[\w@$!]*[^\W_])?")
_DRAWN = re.compile(r"(.)\1\1")


def entries(word: str) -> list[str]:
    """What the lexicon may hold of a word: the word, and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


# ---------------------------------------------------------------- features

PRONOUN, FIXED, LEARNED, BEGINNING, HIDDEN, DRAWN, MIXED = (1 << k for k in range(7))


class Codes(dict):
    """Bits of a word, worked out at its first use."""

    def __init__(self, lexicon: frozenset[str], limit: int = 300_000):
        self.lexicon, self.limit = lexicon, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        code = PRONOUN * (word in SECOND) | FIXED * (word in INSULTS) | LEARNED * (word in self.lexicon)
        code |= BEGINNING * any(f"{word[:n]}*" in self.lexicon for n in PREFIXES if len(word) >= n)
        if not word.isalpha():
            plain = word.translate(LEET)
            code |= MIXED * (any(c.isalpha() for c in word) and not word.isalnum() or bool(re.search(r"[^\W\d_]\d[^\W\d_]", word)))
            code |= HIDDEN * (plain != word and (plain in INSULTS or plain in self.lexicon))
        if _DRAWN.search(word):
            code |= DRAWN
            code |= HIDDEN * (_DRAWN.sub(r"\1", word) in INSULTS)
        self[word] = code
        return code


_classes = np.zeros((256, 5), bool)  # capitals, marks !?, other punctuation, digits, all but spaces
_classes[65:91, 0] = True
_classes[[33, 63], 1] = True
_classes[[*range(34, 48), *range(58, 63), 64, *range(91, 97), *range(123, 127)], 2] = True
_classes[48:58, 3] = True
_classes[33:, 4] = True
_codes: dict[int, Codes] = kept({})


def features(texts: list[str], lexicon: frozenset[str]) -> np.ndarray:
    if (key := hash(lexicon)) not in _codes:
        _codes.clear()
        _codes[key] = Codes(lexicon)
    words = [WORDS.findall(t.lower()) for t in texts]
    n = np.array([len(w) for w in words])
    first = np.concatenate([[0], np.cumsum(n)])
    code = np.fromiter(map(_codes[key].__getitem__, (w for ws in words for w in ws)), np.uint8, first[-1])
    bad = (code & (FIXED | LEARNED | BEGINNING | HIDDEN)) != 0
    doc = np.repeat(np.arange(len(texts)), n)
    spoken = np.concatenate([[0], np.cumsum((code & PRONOUN) != 0)])
    i = np.arange(first[-1])
    near = spoken[np.minimum(i + NEAR + 1, first[doc + 1])] - spoken[np.maximum(i - NEAR, first[doc])] > 0
    bits = [(code & b) != 0 for b in (FIXED, LEARNED, BEGINNING, HIDDEN, PRONOUN, DRAWN, MIXED)]
    counts = np.stack([per_doc(x, first) for x in (*bits, bad, bad & near)], axis=1)
    raw = [t.encode("utf-8", "replace") for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    kinds = _classes[np.frombuffer(b"".join(raw), np.uint8)]
    chars = np.stack([per_doc(kinds[:, k], at) for k in range(5)], axis=1)
    upper = np.array([sum(w.isupper() and len(w) > 1 for w in t.split()) if c > 3 else 0 for t, c in zip(texts, chars[:, 0])])
    length = np.maximum(n, 1)[:, None]
    return np.concatenate(
        [
            counts / length,
            np.log1p(counts[:, [0, 1, 2, 3, 7, 8]]),
            chars[:, :4] / np.maximum(chars[:, 4:], 1),
            upper[:, None] / length,
            np.log1p(n)[:, None],
            (counts[:, [7]] > 0) * counts[:, [8]] / np.maximum(counts[:, [7]], 1),
        ],
        axis=1,
    )


# ---------------------------------------------------------------- lexicon


def _tally(sample: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """In how many documents of each fold an entry stands."""

    def count(b: pa.RecordBatch) -> pa.Table:
        tally = [Counter(), Counter()]
        for text, half in zip(texts_of(b), b.column("half").to_pylist()):
            seen = {e for w in set(WORDS.findall(text.lower())) for e in entries(w)}
            tally[half].update(seen if wanted is None else seen & wanted)
        names = [*tally[0], *tally[1]]
        halves, n = [0] * len(tally[0]) + [1] * len(tally[1]), [*tally[0].values(), *tally[1].values()]
        return pa.table({"entry": pa.array(names, pa.string()), "half": pa.array(halves, pa.int32()), "n": pa.array(n, pa.int64())})

    rows = map_arrow(sample.select("text", "half"), count, "entry string, half int, n long")
    return rows.groupBy("entry").agg(*[F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)])


def learn_lexicons(sample: DataFrame, sizes: dict[tuple[int, int], int]) -> list[frozenset[str]]:
    """Of fold 0, of fold 1, and of both.  sizes: documents by (half, y).

    SUPPORT bounds what comes to the driver by the length of a document, not by the size of the vocabulary.
    """
    folds = ((0,), (1,), (0, 1))
    documents = [[sum(sizes.get((h, y), 0) for h in halves) for y in (0, 1)] for halves in folds]
    least = [max(SUPPORT[0], SUPPORT[1] * n[1]) for n in documents]
    toxic = _tally(sample.where("y = 1"), None).where(f"n0 >= {least[0]} or n1 >= {least[1]} or n0 + n1 >= {least[2]}")
    toxic = {r[0]: (r[1], r[2]) for r in toxic.collect()}
    clean = {r[0]: (r[1], r[2]) for r in _tally(sample.where("y = 0"), frozenset(toxic)).collect()}
    out = []
    for halves, n, enough in zip(folds, documents, least):
        own = []
        for e, counts in toxic.items():
            p, q = sum(counts[h] for h in halves), sum(clean.get(e, (0, 0))[h] for h in halves)
            odds = (p + 0.5) / (n[1] + 1) / ((q + 0.5) / (n[0] + 1))
            if p >= enough and odds >= ODDS:
                own.append(e)
        out.append(frozenset(own))
    return out


# ---------------------------------------------------------------- trees


@dataclass
class Boosted:
    """Trees as arrays by level order: feature, threshold (left if at most it) and, for leaves, value."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1] if len(self.feature) else 0
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 2.0) -> Boosted:
    """Logistic loss, Newton leaves, splits on quantile histograms."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], axis=1)  # > edges[k] means code > k
    n, width = x.shape
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    raw, inner = np.full(n, base), 2**depth - 1
    feature, threshold, value = (np.zeros((trees, k), kind) for k, kind in ((inner, np.int64), (inner, float), (inner + 1, float)))
    for k in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h, node = y - p, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            low, count = 2**level - 1, 2**level
            cell = ((node - low)[:, None] * width + np.arange(width)) * bins + code
            sums = [np.bincount(cell.ravel(), np.repeat(v, width), count * width * bins).reshape(count, width, bins) for v in (g, h)]
            left_g, left_h = (np.cumsum(s, axis=2) for s in sums)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            gain[:, :, -1] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for j in range(count):
                f, b = divmod(int(best[j]), bins)
                feature[k, low + j] = f
                split = gain[j, f, b] > 1e-9 and b < len(edges[f])
                threshold[k, low + j] = edges[f][b] if split else np.inf
            node = 2 * node + 1 + (x[np.arange(n), feature[k, node]] > threshold[k, node])
        leaf = node - inner
        value[k] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        raw += value[k][leaf]
    return Boosted(base, feature, threshold, value)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (mean raw score, share of label 1) to interpolate between."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of raw, sum of y, count
    for r, t in zip(raw[order], y[order]):
        blocks.append([float(r), float(t), 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    at = np.array([b[0] / b[2] for b in blocks])
    share = np.array([b[1] / b[2] for b in blocks])
    return at, np.maximum.accumulate(np.clip(share, 0, 1))


# ---------------------------------------------------------------- the operator


@dataclass
class Model:
    lexicon: frozenset[str]
    trees: Boosted | None
    knots: tuple[np.ndarray, np.ndarray]
    share: float

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        raw = self.trees.raw(features(texts, self.lexicon))
        # A little of the trees' own score keeps the order within a pooled block.
        return 0.98 * np.interp(raw, *self.knots) + 0.02 / (1 + np.exp(-raw))


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", size: int = SAMPLE) -> Model:
    """A model learned from at most `size` labelled rows that satisfy `keep` (a condition on doc_id)."""
    sample = labelled_sample(docs, labels, label, keep, size)
    # Folds go by text, so that copies of a document are never on both sides.
    sample = materialise(
        sample.select("y", "text", F.expr("cast(pmod(xxhash64(text), 2) as int)").alias("half"), F.expr("pmod(xxhash64(text, 7), 4) = 0").alias("late")),
        "sample",
    )
    sizes = {(r[0], r[1]): r[2] for r in sample.groupBy("half", "y").count().collect()}
    positives, total = sum(n for (_, y), n in sizes.items() if y == 1), sum(sizes.values())
    if not positives or positives == total:
        return Model(frozenset(), None, (np.zeros(1), np.zeros(1)), positives / total if total else 0.0)
    lexicons = learn_lexicons(sample, sizes)

    def measure(b: pa.RecordBatch) -> pa.RecordBatch:
        half, texts = np.array(b.column("half").to_pylist()), texts_of(b)
        x = np.zeros((len(texts), len(features([""], lexicons[0])[0])))
        for h in (0, 1):
            own = np.flatnonzero(half == h)
            for lo, hi in chunks(part := [texts[i] for i in own], 500_000):
                x[own[lo:hi]] = features(part[lo:hi], lexicons[1 - h])
        return pa.RecordBatch.from_arrays([b.column("y"), b.column("late"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "late", "x"])

    # At most SAMPLE rows of numbers; sorted, so that the fit doesn't depend on the order in which tasks end.
    rows = sorted(map(tuple, map_arrow(sample, measure, "y int, late boolean, x array<double>").collect()))
    y, late, x = (np.array([r[c] for r in rows], float) for c in range(3))
    late = late > 0
    if len(set(y[~late])) < 2 or len(set(y[late])) < 2:
        late = np.zeros(len(y), bool)
    trees = boost(x[~late], y[~late])
    held = late if late.any() else ~late
    return Model(lexicons[2], trees, isotonic(trees.raw(x[held]), y[held]), positives / total)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns kept, whose score is below the threshold; the model is learned from all labels."""
    model = fit(docs, labels, F.lit(True))
    plain, undo = sealed(docs, "text")
    return undo(append_score(plain, plain.columns, model, "__toxicity").where(F.col("__toxicity") < threshold))


def op3_toxicity_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = spread(table(spark, sf_dir, "documents")), F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    scored = append_score(docs, ["doc_id"], fit(docs, table(spark, sf_dir, "labels"), ~held_out), "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
