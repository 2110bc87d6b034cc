import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sylva.llm import quality, toxicity
from sylva.llm.scoring import fold, labelled_sample

BIG = "/root/testdata/sf0.1"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    p = y == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def held(spark, rows, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = [r for r in rows.collect() if r.held_out and r.doc_id in labels]
    return np.array([labels[r.doc_id] for r in rows]), np.array([r.score for r in rows]), np.array([r.predicted for r in rows])


def test_toxicity_on_held_out_rows(spark):
    y, s, p = held(spark, toxicity.op3_toxicity_boosted_trees(spark, BIG), "toxic")
    assert auc(y, s) > 0.98 and p[y == 1].mean() > 0.85 and p[y == 0].mean() < 0.03
    assert ((s - y) ** 2).mean() < 0.03 and s.min() >= 0 and s.max() <= 1


def test_quality_on_held_out_rows(spark):
    y, s, p = held(spark, quality.op7_ftrl_quality(spark, BIG), "quality")
    assert auc(y, s) > 0.98 and p[y == 1].mean() > 0.98 and p[y == 0].mean() < 0.1


def test_held_out_rule_and_rows(spark, sf):
    import zlib

    rows = toxicity.op3_toxicity_boosted_trees(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    assert spark.createDataFrame([(None,)], "doc_id long").select(fold("doc_id", 4)).first()[0] is None


def test_edges(spark):
    docs = spark.createDataFrame([(1, "you idiot", 1), (2, None, 2), (2, None, 2), (None, "", 3)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for labels, share in ((none, 0.0), (one, 1.0)):
        model = toxicity.fit(docs, labels, F.lit(True))
        assert model(["x"])[0] == share
        kept = toxicity.reject(docs, labels)
        assert kept.columns == docs.columns and kept.count() == (4 if share == 0 else 0)
    assert quality.fit(docs, none, F.lit(True))(["", "x"]).tolist() == [0.5, 0.5]
    assert quality.fit(docs, one, F.lit(True))([""])[0] == 1.0
    assert toxicity.reject(docs.limit(0), none).count() == 0


def test_features_and_ngrams_of_odd_texts():
    texts = ["", " ", "!!!", "IDIOT you", "1d10t", "é" * 10, "a\x00b", "stuuupid", "😀" * 5]
    x = toxicity.features(texts, frozenset(["trol*"]))
    assert x.shape[0] == len(texts) and np.isfinite(x).all() and not x[0].any()
    assert x[3, 0] == 0.5 and x[3, 8] == 0.5  # one of two words insults, near a pronoun
    assert x[7, 3] == 1  # drawn out
    index, first = quality.ngrams(texts)
    assert first[0] == 0 and first[-1] == len(index) and first[1] == 0 and first[2] == 0
    alone = [quality.ngrams([t])[0].tolist() for t in texts]
    assert [index[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == alone


def test_isotonic_is_monotone_and_boosting_fits():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0.5)).astype(float)
    trees = toxicity.boost(x, y)
    p = 1 / (1 + np.exp(-trees.raw(x)))
    assert ((p > 0.5) == y).mean() > 0.95
    at, share = toxicity.isotonic(trees.raw(x), y)
    assert (np.diff(share) >= 0).all() and (np.diff(at) > 0).all()


def test_ftrl_learns_a_sparse_rule():
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(800):
        i = rng.choice(200, 10, replace=False)
        rows.append((int(7 in i or 11 in i), np.append(i, 1 << quality.BITS), np.append(np.full(10, 0.8), 1.0)))
    w, bias = quality.ftrl(rows)
    assert set(np.argsort(-w)[:2]) == {7, 11} and bias < 0


# ---------------------------------------------------------------- plain versions


def plain_boost(x, y, trees, depth, rate, bins, ridge):
    """Boosted trees grown node by node, every split of every feature tried by counting."""
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]))) for c in x.T]
    base = math.log((sum(y) + 1) / (len(y) - sum(y) + 1))
    raw, model = [base] * len(y), []

    def grow(rows, left, g, h):
        best = (1e-9, None)
        total_g, total_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
        for f in range(x.shape[1]) if left else ():
            for cut in cuts[f]:
                a, b = sum(g[i] for i in rows if x[i, f] <= cut), sum(h[i] for i in rows if x[i, f] <= cut)
                gain = a * a / (b + ridge) + (total_g - a) ** 2 / (total_h - b + ridge) - total_g**2 / (total_h + ridge)
                if gain > best[0] + 1e-12:
                    best = (gain, (f, cut))
        if best[1] is None:
            return rate * total_g / (total_h + ridge)
        f, cut = best[1]
        return f, cut, grow([i for i in rows if x[i, f] <= cut], left - 1, g, h), grow([i for i in rows if x[i, f] > cut], left - 1, g, h)

    def value(t, row):
        while isinstance(t, tuple):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        return t

    for _ in range(trees):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        model.append(grow(list(range(len(y))), depth, [b - a for a, b in zip(p, y)], [a * (1 - a) for a in p]))
        raw = [r + value(model[-1], row) for r, row in zip(raw, x)]
    return np.array(raw)


def test_boosting_against_plain_version():
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(120, 3)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=120) * 0.3 > 0).astype(float)
    how = {"trees": 5, "depth": 2, "rate": 0.3, "bins": 8, "ridge": 1.0}
    assert np.allclose(toxicity.boost(x, y, **how).raw(x), plain_boost(x, y, **how))


def test_isotonic_against_plain_version():
    rng = np.random.default_rng(12)
    raw, y = rng.normal(size=60), rng.integers(0, 2, 60).astype(float)
    at, share = toxicity.isotonic(raw, y)
    fitted = np.interp(np.sort(raw), at, share)
    ys = y[np.argsort(raw)]
    # The best increasing fit: at each place the least over ends of the greatest mean over beginnings.
    want = [min(max(ys[a : b + 1].mean() for a in range(i + 1)) for b in range(i, 60)) for i in range(60)]
    blocks = sorted(set(np.round(want, 12)))
    assert np.allclose(blocks, sorted(set(np.round(share, 12)))) and (np.diff(fitted) >= -1e-12).all()


def test_features_against_plain_counter():
    texts = ["You IDIOT!! you are st00pid, a m0ron...", "Nice day, friend. Call 555.", "TROLLING trolls are sooo dumb, u know", "", "a1b 2 c"]
    lexicon = frozenset(["nasty", "trol*"])
    got = toxicity.features(texts, lexicon)
    for row, text in zip(got, texts):
        words = toxicity.WORDS.findall(text.lower())
        n = max(len(words), 1)
        hidden = lambda w: (p := w.translate(toxicity.LEET)) != w and not w.isalpha() and (p in toxicity.INSULTS or p in lexicon)
        drawn = lambda w: re.search(r"(.)\1\1", w)
        kinds = {
            "fixed": [w in toxicity.INSULTS for w in words],
            "learned": [w in lexicon for w in words],
            "beginning": [any(w[:k] + "*" in lexicon for k in (4, 5, 6) if len(w) >= k) for w in words],
            "hidden": [bool(hidden(w) or drawn(w) and re.sub(r"(.)\1\1", r"\1", w) in toxicity.INSULTS) for w in words],
            "pronoun": [w in toxicity.SECOND for w in words],
            "drawn": [bool(drawn(w)) for w in words],
        }
        bad = [any(kinds[k][i] for k in ("fixed", "learned", "beginning", "hidden")) for i in range(len(words))]
        near = [b and any(kinds["pronoun"][max(0, i - 5) : i + 6]) for i, b in enumerate(bad)]
        assert np.allclose(row[:6], [sum(v) / n for v in kinds.values()]) and np.allclose(row[7:9], [sum(bad) / n, sum(near) / n])
        counts = [sum(kinds[k]) for k in ("fixed", "learned", "beginning", "hidden")] + [sum(bad), sum(near)]
        assert np.allclose(row[9:15], np.log1p(counts))
        seen = max(sum(not c.isspace() for c in text), 1)
        assert np.isclose(row[15], sum("A" <= c <= "Z" for c in text) / seen) and np.isclose(row[16], sum(c in "!?" for c in text) / seen)
        assert np.isclose(row[18], sum(c.isdigit() for c in text) / seen) and np.isclose(row[20], np.log1p(len(words)))


def test_lexicons_against_plain_counts(spark):
    rng = random.Random(4)
    words = [f"w{k}x" for k in range(40)]
    rows = [(int(y), " ".join(rng.choices(words, k=8)) + (" vile vileness" if y and rng.random() < 0.6 else ""), k % 2) for k, y in enumerate(rng.choices([0, 1], k=300))]
    sample = spark.createDataFrame(rows, "y int, text string, half int")
    sizes = Counter((h, y) for y, _, h in rows)
    for halves, got in zip(((0,), (1,), (0, 1)), toxicity.learn_lexicons(sample, sizes)):
        want = set()
        seen = [(y, {e for w in t.split() for e in toxicity.entries(w)}) for y, t, h in rows if h in halves]
        positives, negatives = sum(y for y, _ in seen), sum(1 - y for y, _ in seen)
        for e in set().union(*(s for _, s in seen)):
            p, q = sum(e in s for y, s in seen if y), sum(e in s for y, s in seen if not y)
            if p >= max(3, 0.004 * positives) and (p + 0.5) / (positives + 1) / ((q + 0.5) / (negatives + 1)) >= 8:
                want.add(e)
        assert got == want and "vile" in got


def plain_ftrl(rows, epochs):
    """Follow the regularised leader with one dictionary entry a weight."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0)) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for y, row in rows:
            w = {i: weight(i) for i in row}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in row.items())))
            for i, x in row.items():
                g = (p - y) * x
                sigma = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / quality.ALPHA
                z[i], n[i] = z.get(i, 0) + g - sigma * w[i], n.get(i, 0) + g * g
    return weight


def test_ftrl_against_plain_version():
    rng = np.random.default_rng(7)
    rows, plain = [], []
    for _ in range(60):
        ids = rng.choice(50, 6, replace=False)
        x = rng.random(6)
        y = int(3 in ids or x[0] > 0.9)
        rows.append((y, np.append(ids, 1 << quality.BITS), np.append(x, 1.0)))
        plain.append((y, dict(zip([*ids.tolist(), 1 << quality.BITS], [*x.tolist(), 1.0]))))
    w, bias = quality.ftrl(rows)
    weight = plain_ftrl(plain, quality.EPOCHS)
    assert np.allclose(w[:50], [weight(i) for i in range(50)]) and np.isclose(bias, weight(1 << quality.BITS)) and np.count_nonzero(w[50:]) == 0


def test_scores_are_sparse_dot_products():
    texts = ["The cat sat. The CAT sat!", "", "aa bb"]
    weights = np.random.default_rng(1).normal(size=1 << quality.BITS)
    got = quality.Model(weights, 0.25)(texts)
    index, first = quality.ngrams(texts)
    for k, score in enumerate(got):
        own = Counter(index[first[k] : first[k + 1]].tolist())
        total = sum(weights[i] * n / max(sum(own.values()), 1) * quality.SCALE for i, n in own.items())
        assert np.isclose(score, 1 / (1 + math.exp(-total - 0.25)))


def test_sample_is_bounded_by_rows(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 2900, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 1500).cast("string")).alias("text"))
    labels = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    rows = labelled_sample(docs, labels, "toxic", F.lit(True), 50).collect()
    assert len(rows) == 50 == len({(r.doc_id, r.text) for r in rows})
    assert {(r.doc_id, r.text, r.y) for r in rows} <= {(r.doc_id, r.text, r.doc_id % 2) for r in docs.collect()}


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "you idiot", 1, 2, 3)], "doc_id long, text string, __toxicity int, `a.b` int, c1 int")
    kept = toxicity.reject(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "you idiot", 1, 2, 3)]
