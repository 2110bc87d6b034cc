"""Candidates from sketches and dyadic trees, alone and inside a forest."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.operators import splitters
from sylva.operators.evaluate import AccuracySplit, BrierSplit, Stopper, VotedError
from sylva.operators.sampling import RandomForest, SingleTree, out_of_time
from sylva.operators.splitters import Feature, MapFeatures
from sylva.plans import tree as T
from sylva.plans.forest import Forest
from sylva.sources import models


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(12)
    out = []
    for k in range(3000):
        x = rng.random() * 1000 - 200
        out.append((k, k, "a" if x < 137 or rng.random() < 0.05 else "b", 1.0, x, f"v{min(int(rng.expovariate(0.05)), 300)}"))
    return spark.createDataFrame(out, "id long, ts long, label string, weight double, x double, s string").repartition(4).cache()


def test_digests_split_where_exact_quantiles_do(rows):
    feature = (Feature("x", "continuous"),)
    for how in ({"cuts": 40, "digests": 800}, {"cuts": 40}, {"dyadic": 7}):
        forest = Forest(rows, feature, SingleTree(), stopper=Stopper(100, 100), **how).expand_times(2)
        root = forest.trees[0]
        assert root.feature == "x" and abs(root.predicate.value - 137) < 30 and root.predicate.op == ("ltEq" if "digests" in how else "lt")
        assert T.depth(root) == 2
        assert sum(T.total(x.target) for x in T.leaves(forest.update_targets().trees[0])) == 3000
        assert models.loads(models.dumps(root)) == root


def test_weights_count_in_digests_and_sketches(rows):
    double = rows.withColumn("weight", F.when(F.col("label") == "a", 3.0).otherwise(1.0)).withColumn("tree", F.lit(0))
    total = {r[0]: r[1] for r in double.groupBy("label").agg(F.sum("weight")).collect()}
    for r in splitters.quantile_digests(double, [Feature("x", "continuous")], ["tree"], 5, 1000).collect():
        assert abs(r.lw + r.rw - total[r.label]) < 1e-6
    parents = double.groupBy("tree", "label").agg(F.sum("weight").alias("weight"))
    stats = splitters.statistics(double, [Feature("s", "sparse")], ["tree"])
    exact, sketch = (
        {(r["str"], r.label): (r.lw, r.rw) for r in c.collect()}
        for c in (splitters.heavy_hitters(stats, parents, ["tree"], 15), splitters.heavy_hitter_sketches(double, [Feature("s", "sparse")], parents, ["tree"], 15, 5000))
    )
    assert exact == sketch
    rough = splitters.heavy_hitter_sketches(double, [Feature("s", "sparse")], parents, ["tree"], 15, 64).collect()
    assert rough and all(abs(r.lw - exact[r["str"], r.label][0]) <= 3 * 3.5 / 64 * 3000 for r in rough if (r["str"], r.label) in exact)


def test_forests_of_sketches_over_bootstraps_and_maps(rows):
    forest = Forest(rows, (Feature("x", "continuous"), Feature("s", "sparse")), RandomForest(2, 1.0), stopper=Stopper(200, 200), cuts=20, digests=400, tracked=2000, capacity=50).expand_times(1)
    assert all(t.feature == "x" for t in forest.trees.values())
    value = lambda kind, num, text: F.struct(F.lit(kind).alias("kind"), num.cast("double").alias("num"), text.cast("string").alias("str"))
    none = F.lit(None)
    open_ = rows.select("id", "ts", "label", "weight", F.create_map(F.lit("x"), value("continuous", F.col("x"), none), F.lit("s"), value("sparse", none, F.col("s"))).alias("features"))
    for how in ({"cuts": 20, "digests": 400, "tracked": 2000}, {"cuts": 20}, {"dyadic": 6}):
        grown = Forest(open_, MapFeatures(), SingleTree(), stopper=Stopper(200, 200), **how).expand_times(1)
        assert grown.trees[0].feature == "x" and abs(grown.trees[0].predicate.value - 137) < 60


def test_dyadic_trees_of_any_sign(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=400) * 50, [0.0, -1.0, 0.5, 1e6, -1e6]])
    df = spark.createDataFrame([("f", float(v), None, "a", 1.0) for v in values], "feature string, num double, str string, label string, w double")
    nodes = splitters.dyadic_tree(df, [], 4, 0, 30).collect()
    base = np.floor(values)
    for r in nodes:
        inside = np.floor(base / 2.0**r.level) == r["at"]
        assert r.w == inside.sum() > len(values) / 16 and (r.level == 0 or r.left + r.right == r.w)
    # Every interval that holds enough is there.
    assert len(nodes) == sum((np.unique(np.floor(base / 2.0**k), return_counts=True)[1] > len(values) / 16).sum() for k in range(31))
    bounds = splitters.dyadic_quantiles(df, [], 0.5, 4, 0, 30).first()
    assert bounds.lower <= np.median(values) <= bounds.upper


def test_time_quantiles_are_bounded(rows):
    exact = out_of_time(SingleTree(), rows, 0.8, exact=True).threshold
    at = out_of_time(SingleTree(), rows, 0.8, compression=6, finest=0).threshold
    assert exact <= at <= exact + 3000 / 32


def test_unions_of_older_predicates():
    import itertools

    tests = {"lt": lambda a: a < 0, "isEq": lambda a: a == 0, "gt": lambda a: a > 0, "ltEq": lambda a: a <= 0, "gtEq": lambda a: a >= 0, "notEq": lambda a: a != 0}
    for p, q in itertools.product(tests, repeat=2):
        want = [tests[p](a) or tests[q](a) for a in (-1, 0, 1)]
        named = [op for op in tests if [tests[op](a) for a in (-1, 0, 1)] == want]
        if named:
            assert models._old_predicate({"or": [{p: 3}, {q: 3}]}) == T.Predicate(named[0], 3)
        else:
            with pytest.raises(models.ModelError):
                models._old_predicate({"or": [{p: 3}, {q: 3}]})
    assert models._old_predicate({"or": [{"not": {"lt": 3}}, {"eq": 3}]}) == T.Predicate("gtEq", 3)


def test_voted_errors_split_alike_on_the_cluster_and_in_memory(rows):
    squared = lambda w, o: o.scaled(w, o.least1(o.total(w)))
    cases = [(VotedError("brier", "soft"), BrierSplit()), (VotedError("accuracy", "mode"), AccuracySplit()), (VotedError(lambda w, p, o: o.total(w) - o.total(o.both(lambda a, q: a * q, w, p)), squared), None)]
    for voted, plain in cases:
        found = []
        for e in (voted, plain):
            if e:
                forest = Forest(rows, (Feature("x", "continuous"),), SingleTree(), e, Stopper(10_000, 100)).update_targets()
                found += [forest.expand(local=True).trees[0], forest.expand_in_memory(1).trees[0]]
        assert len({(t.feature, t.predicate) for t in found}) == 1 and T.depth(found[0]) == 1


def test_voted_errors_by_hand():
    from sylva.operators.evaluate import _Arrays

    w = np.array([[3.0, 1.0, 0.0], [2.0, 2.0, 4.0], [0.2, 0.2, 0.0]])
    for k, row in enumerate(w):
        t = row.sum()
        p = row / max(t, 1)
        want = sum(row[y] * sum((float(y == l) - p[l]) ** 2 for l in range(3)) for y in range(3))
        assert abs(VotedError().local(w, None)[k] - want) < 1e-12
        assert abs(VotedError("accuracy", "mode").local(w, None)[k] - (t - row.max())) < 1e-12
    assert _Arrays.first(w, _Arrays.most(w)).tolist() == [[1, 0, 0], [0, 0, 1], [1, 0, 0]]


def test_frequent_values_by_sketches_are_those_of_all_counts(spark):
    rng = random.Random(5)
    for values, weights in ((400, (1.0,)), (4000, (1.0, 0.5))):  # within and beyond what the sketches track
        data = [(0, rng.choice("ab"), rng.choice(weights), f"v{int(values * rng.random() ** 1.2)}") for _ in range(12_000)]
        rows = spark.createDataFrame(data, "tree int, label string, weight double, s string").repartition(4).cache()
        parents = rows.groupBy("tree", "label").agg(F.sum("weight").alias("weight"))
        feature = [Feature("s", "sparse")]
        exact = splitters.heavy_hitters(splitters.statistics(rows, feature, ["tree"]), parents, ["tree"], 10)
        sketch = splitters.heavy_hitter_sketches(rows, feature, parents, ["tree"], 10, 500)
        assert sorted(map(str, exact.collect())) == sorted(map(str, sketch.select(*exact.columns).collect()))
        rows.unpersist()


def test_time_quantiles_are_exact(spark, monkeypatch):
    times = spark.range(3_000_000, numPartitions=4).select((F.col("id") * 7919 % 3_000_017 - 1000).alias("ts"))
    want = sorted(k * 7919 % 3_000_017 - 1000 for k in range(3_000_000))
    for q in (0.05, 0.5, 0.8, 0.999):  # some are a few ranks off by an approximate percentile of so many values
        assert out_of_time(SingleTree(), times, q).threshold == want[int(round(3_000_000 * q)) - 1]
    monkeypatch.setattr("sylva.operators.sampling.BUCKETS", 3)
    few = spark.createDataFrame([(v,) for v in (5, None, -(10**15), 7, 7, 10**15)], "ts long")
    assert [out_of_time(SingleTree(), few, q).threshold for q in (0.0, 0.2, 0.4, 0.41, 0.8, 1.0)] == [-(10**15), -(10**15), 5, 7, 7, 10**15]
