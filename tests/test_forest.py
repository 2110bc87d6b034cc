import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva import streaming
from sylva.operators import evaluate, metrics, routing, sampling, splitters, voting
from sylva.operators.evaluate import ChiSquared, Stopper
from sylva.operators.sampling import KFold, OutOfTime, RandomForest, SingleTree, TimeGrouped
from sylva.operators.splitters import Feature
from sylva.plans import local_grow
from sylva.plans import tree as T
from sylva.plans.forest import Forest
from sylva.sources import instances, models

XY = (Feature("x", "ordinal"), Feature("c", "nominal"))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = []
    for k in range(600):
        x, c = float(rng.integers(0, 20)), "uvw"[rng.integers(0, 3)]
        label = "yes" if (x < 8) != (c == "u") else "no"
        if rng.random() < 0.05:
            label = "yes"
        data.append((k, k, label, 1.0, None if k % 11 == 0 else x, None if k % 13 == 0 else c))
    return spark.createDataFrame(data, "id long, ts long, label string, weight double, x double, c string").cache()


def test_each_row_reaches_one_leaf_and_targets_add_up(rows):
    f = Forest(rows, XY, KFold(3), stopper=Stopper(10, 10)).expand_times(3).update_targets()
    n = rows.count()
    for i, t in f.trees.items():
        trained = sampling.training_rows(rows, f.sampler).where(F.col("tree") == i).count()
        assert T.total(T.target_of(t)) == trained < n
    assert f.validation().groupBy("id").count().where("count <> 1").count() == 0


def test_growth_learns(rows):
    f = Forest(rows, XY, KFold(3), stopper=Stopper(10, 10)).expand_times(3)
    right, wrong = f.validate(metrics.accuracy).first()
    assert right / (right + wrong) > 0.8
    pruned = f.update_targets().prune()
    assert sum(1 for t in pruned.trees.values() for _ in T.leaves(t)) <= sum(1 for t in f.trees.values() for _ in T.leaves(t))
    importance = {r["feature"]: r["brier"] for r in f.feature_importance().collect()}
    assert set(importance) == {"x", "c"} and min(importance.values()) > f.validate().first()["brier"]


def test_local_growth_takes_the_same_first_split(rows):
    whole = rows.where("x is not null and c is not null")
    far = Forest(whole, XY, SingleTree(), stopper=Stopper(10, 10)).update_targets().expand().trees[0]
    near = Forest(whole, XY, SingleTree(), stopper=Stopper(10_000, 10)).update_targets().expand_in_memory(1).trees[0]
    assert (far.feature, far.predicate) == (near.feature, near.predicate)
    assert T.add(far.left.target, {}) == near.left.target and far.right.target == near.right.target


def test_local_grower_sends_complements_down():
    x = np.array([1.0, 2, 3, 4, None, 6], dtype=object)
    t = local_grow.grow({"x": x}, {"x": True}, np.array(["a", "a", "a", "b", "a", "b"]), np.ones(6), 3, 0)
    assert t.predicate == T.Predicate("lt", 4.0) and t.left.target == {"a": 4.0} and t.right.target == {"b": 2.0}


def test_save_and_load(rows, tmp_path):
    f = Forest(rows, XY, KFold(2), stopper=Stopper(10, 10)).expand_times(2, str(tmp_path / "m"))
    assert f.load(models.step(str(tmp_path / "m"), 2)).trees == f.trees
    for form in ("tsv", "parquet"):
        f.save(str(tmp_path / form), form)
        assert f.load(str(tmp_path / form), form).trees == f.trees


def test_unseen_leaves_have_empty_targets_and_trees_stay(rows):
    t = T.Node("x", T.Predicate("lt", -5.0), T.Leaf(0, {"yes": 9.0}), T.Leaf(1))
    f = Forest(rows.where("x is not null"), XY, SingleTree(), trees={0: t, 1: t})
    out = f.update_targets().trees
    assert set(out) == {0, 1} and out[0].left.target == {} and out[1] == T.Node(t.feature, t.predicate, T.Leaf(0), T.Leaf(1))


def test_random_forest_and_other_samplers(rows):
    n = rows.count()
    rf = RandomForest(2, 0.5)
    drawn = rows.select(*[rf.times(k).alias(f"t{k}") for k in (0, 1)]).agg(F.avg("t0"), F.avg("t1"), F.corr("t0", "t1")).first()
    assert abs(drawn[0] - 1) < 0.2 and abs(drawn[1] - 1) < 0.2 and abs(drawn[2]) < 0.2
    late = OutOfTime(KFold(2), 400)
    assert sampling.training_rows(rows, late).where("ts >= 400").count() == 0
    assert sampling.validation_rows(rows, late).count() == 2 * (n - 400)
    found = sampling.out_of_time(KFold(2), rows, 0.5)
    assert abs(found.threshold - n // 2) <= 1
    grouped = TimeGrouped(SingleTree(), 100, 3)
    assert grouped.num_trees == 3
    per_tree = {r[0]: r[1] for r in sampling.training_rows(rows, grouped).groupBy("tree").count().collect()}
    assert per_tree == {0: 200, 1: 200, 2: 200}
    strict = TimeGrouped(KFold(2), 100, 3, strict=True)
    assert sampling.validation_rows(rows, strict).count() < sampling.validation_rows(rows, TimeGrouped(KFold(2), 100, 3)).count()


def test_feature_subsets_hold_in_both_growers(rows):
    f = Forest(rows, XY, RandomForest(4, 0.5), stopper=Stopper(10, 10)).expand_times(2)
    g = Forest(rows, XY, RandomForest(4, 0.5), stopper=Stopper(10_000, 10)).update_targets().expand_in_memory(2)
    sampler = RandomForest(4, 0.5)
    for forest in (f, g):
        used = [(i, p, t.feature) for i, tree in forest.trees.items() for p, t in T.with_paths(tree) if isinstance(t, T.Node)]
        table = rows.sparkSession.createDataFrame(used, "tree int, node string, feature string")
        assert used and table.where(~sampler.feature(F.col("tree"), F.col("node"), F.col("feature"))).count() == 0


def test_quantile_cuts_and_heavy_hitters(rows):
    base = rows.withColumn("tree", F.lit(0)).withColumn("leaf", F.lit(0))
    cand = splitters.quantiles(base, [XY[0]], ["tree"], 4, exact=True)
    total = base.where("x is not null").count()
    for r in cand.groupBy("num").agg(F.sum("lw").alias("l"), F.sum("rw").alias("r")).collect():
        assert r["l"] + r["r"] == total and r["l"] == base.where(F.col("x") < r["num"]).count()
    stats = splitters.statistics(base, [Feature("c", "sparse")], ["tree"])
    parents = base.groupBy("tree", "label").agg(F.sum("weight").alias("weight"))
    hot = splitters.heavy_hitters(stats, parents, ["tree"], 1)
    for r in hot.groupBy("str").agg(F.sum("lw").alias("l"), F.sum("rw").alias("r")).collect():
        assert r["l"] + r["r"] == base.count() and r["l"] == base.where(F.col("c") == r["str"]).count()


def test_sketches_agree_with_exact_results(spark, sf):
    from sylva import queries as Q

    rows = Q.events(spark, sf).withColumn("tree", F.lit(0))
    exact = {r[0]: r[1] for r in rows.groupBy(F.col("user_id").cast("string")).count().collect()}
    for r in splitters.approximate_heavy_hitters(rows, "user_id", ["tree"], 10).collect():
        assert r["n"] == exact[r["str"]]
    sketch, sure = (splitters.quantiles(rows, [Feature("value", "continuous")], ["tree"], 5, exact=e).select("num").distinct().orderBy("num").collect() for e in (False, True))
    assert np.allclose([r[0] for r in sketch], [r[0] for r in sure])


def test_mixed_kinds_are_refused(rows):
    with pytest.raises(ValueError):
        Forest(rows, (Feature("c", "ordinal"),))
    with pytest.raises(ValueError):
        Forest(rows, (Feature("nothing", "ordinal"),))


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 5.0)], "id long, x double")
    t = T.Node("x", T.Predicate("lt", 1.0), T.Leaf(0), T.Leaf(1))
    for routed in (routing.route(df, {0: t}), routing.route_by_level(df.withColumn("tree", F.lit(0)), {0: t})):
        assert {r["id"]: r["leaf"] for r in routed.collect()} == {1: 0, 2: 0, 3: 1}


def test_level_wise_routing_agrees_with_case(rows):
    f = Forest(rows, XY, SingleTree(), stopper=Stopper(5, 5)).expand_times(4)
    trees = {0: T.annotate(f.trees[0], T.total)}
    for order in routing.ORDERS:
        a = {r["id"]: r["leaf"] for r in routing.route(rows, trees, order).collect()}
        b = {r["id"]: r["leaf"] for r in routing.route_by_level(rows.withColumn("tree", F.lit(0)), trees, order).collect()}
        assert a == b


def test_voters():
    a, b = {"a": 1, "b": 2, "c": 3}, {"a": 2, "c": 5}
    soft = voting.soft_target([a, b])
    assert soft == pytest.approx({"a": (1 / 6 + 2 / 7) / 2, "b": (2 / 6) / 2, "c": (3 / 6 + 5 / 7) / 2})
    assert voting.soft_target([]) == {} and voting.mode_target([]) == {}
    assert voting.mode_target([{"a": 1, "b": 3, "c": 2}, {"a": 2, "c": 5}, {"b": 3, "c": 4}]) == pytest.approx({"b": 1 / 3, "c": 2 / 3})
    assert voting.mean_target([]) == 0 and voting.mean_target([1, 2, 3, 4]) == 2.5 and voting.mean_target([1.1, -3, 0.1]) == pytest.approx(-0.6)
    doubled = voting.adapted(voting.mean_target, lambda values: [2 * x for x in values], str)
    assert doubled([1, 2]) == "3.0" and voting.adapted(voting.mean_target)([1, 2]) == 1.5
    assert voting.threshold_target(voting.soft_target, 0.4, "c")([a]) and not voting.threshold_target(voting.soft_target, 0.5, "c")([a])


def test_chi_squared_formula(spark):
    cand = spark.createDataFrame([("f", "lt", 1.0, None, "a", 10.0, 20.0), ("f", "lt", 1.0, None, "b", 30.0, 5.0), ("f", "lt", 1.0, None, "z", 0.0, 4.0)], "feature string, op string, num double, str string, label string, lw double, rw double")
    o = np.array([[10, 20], [30, 5], [0, 4]], float)
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert ChiSquared().evaluate(cand, []).first()["score"] == pytest.approx(((o - e) ** 2 / e).sum())
    many = (o > 0).sum(1, keepdims=True)
    assert ChiSquared(True).evaluate(cand, []).first()["score"] == pytest.approx((many * (o - e) ** 2 / e).sum())
    best = evaluate.best_splits(ChiSquared().evaluate(cand, []).withColumn("k", F.lit(1)), ["k"]).first()
    assert (best["lt"], best["rt"]) == (40.0, 29.0)


def test_binary_metrics(spark):
    bins = metrics.binned_errors(spark.createDataFrame([(0.9, True, 1.0), (0.8, True, 1.0), (0.7, False, 1.0), (0.1, False, 1.0)], "p double, positive boolean, weight double"))
    assert metrics.auc(bins).first()[0] == 1.0
    one = metrics.binned_errors(spark.createDataFrame([(0.5, True, 1.0), (0.5, False, 1.0)], "p double, positive boolean, weight double"))
    assert metrics.auc(one).first()[0] == 0.5
    r = metrics.rates(spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (3.0, 4.0, 1.0, 2.0)], "tp double, tn double, fp double, fn double")).orderBy("tp").collect()
    assert r[0]["f1"] is None and r[1]["f1"] == pytest.approx(6 / 9) and r[1]["precision"] == 0.75


def test_csv_maps_and_metrics_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text("1.5,2,yes\n,3,no\n")
    df = instances.from_csv(spark, str(tmp_path / "in.csv"), ["a", "b"], {"b": "int"})
    assert [(r.a, r.b, r.label) for r in df.collect()] == [(1.5, 2, "yes"), (None, 3, "no")]
    maps = spark.createDataFrame([(1, 0, {"a": 1.0}, {"x": 2, "y": 1})], "id long, ts long, features map<string,double>, target map<string,long>")
    assert sorted((r.label, r.weight, r.a, r.b) for r in instances.from_maps(maps, ["a", "b"]).collect()) == [("x", 2.0, 1.0, None), ("y", 1.0, 1.0, None)]
    instances.write_metrics(spark.range(2), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep="\t").count() == 2
    assert [f.kind for f in splitters.infer_features(df, ["id", "ts", "label", "weight"])] == ["continuous", "ordinal"]


def test_stream_scores_as_the_table_does(spark, sf, tmp_path):
    from sylva import queries as Q

    rows = Q.orders(spark, sf).limit(200)
    rows.write.parquet(str(tmp_path / "in"))
    trees = Q.fixed_forest()
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.serve(stream, trees, ["F", "O", "P"], str(tmp_path / "cp"), str(tmp_path / "out"))
    q.processAllAvailable()
    q.stop()
    got = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["id"]: r for r in streaming.score(spark.read.parquet(str(tmp_path / "in")), trees, ["F", "O", "P"]).collect()}
    assert got == want and len(got) == 200
    r = next(iter(want.values()))
    alone = streaming.score_one(r.asDict(), trees)
    assert all(abs(alone.get(k, 0) - r[f"p_{k}"]) < 1e-12 for k in "FOP")


def test_combinators(rows):
    seen = []
    f = Forest(rows, XY).tee(seen.append).flat_map_trees(lambda r, s, t: {0: T.singleton({"a": 1.0})}).flat_map_sampler(lambda r, s, t: KFold(2))
    assert len(seen) == 1 and f.trees == {0: T.singleton({"a": 1.0})} and f.sampler == KFold(2)
    assert Forest(rows, XY).out_of_time(0.5).sampler.num_trees == 1


def test_targets_of_leaves_with_more_rows_than_a_task_takes(spark):
    light = spark.range(8000).select("id", F.lit(0).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"), F.lit(0.01).alias("weight"), (F.col("id") % 100).cast("double").alias("x"))
    tree = Forest(light, (Feature("x", "ordinal"),), SingleTree(), stopper=Stopper(10_000, 10)).update_targets().expand_in_memory(1, max_rows=2000).trees[0]
    assert abs(sum(T.total(x.target) for x in T.leaves(tree)) - 80) < 8  # 20 before: a quarter of the rows, not scaled


def test_local_growth_takes_the_split_of_the_evaluator(rows):
    whole = rows.where("x is not null and c is not null")
    heavy = evaluate.MinWeight(lambda w: w >= 60)
    for e in (heavy, evaluate.BrierSplit(), evaluate.AccuracySplit(), ChiSquared(label_multiplicity=True)):
        far = Forest(whole, XY, SingleTree(), e, Stopper(10, 10)).update_targets().expand().trees[0]
        near = Forest(whole, XY, SingleTree(), e, Stopper(10_000, 10)).update_targets().expand_in_memory(1).trees[0]
        assert (far.feature, far.predicate) == (near.feature, near.predicate), e
    deep = Forest(whole, XY, SingleTree(), heavy, Stopper(10_000, 10)).update_targets().expand_in_memory(4).trees[0]
    assert all(T.total(x.target) >= 60 for x in T.leaves(deep))
    for more in ({"evaluator": evaluate.ErrorSplit(lambda: F.sum("lw"))}, {"evaluator": evaluate.MinWeight(lambda w: F.sqrt(w) > 3)}, {"randomized": True}, {"cuts": 4}):
        with pytest.raises(ValueError):
            Forest(whole, (Feature("x", "continuous"),), SingleTree(), stopper=Stopper(10_000, 10), **more).update_targets().expand_in_memory(1)


def test_embeddings_are_split_on_any_component_as_by_brute_force(spark, tmp_path):
    from sylva import queries

    x = np.round(np.random.default_rng(3).normal(size=(200, 64)), 1)
    y = (x[:, 40] >= 0.3).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y))], "vec_id long, embedding array<double>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    rows, features = queries._embeddings(spark, str(tmp_path))
    assert [f.name for f in features] == [f"e{k}" for k in range(64)]
    tree = Forest(rows, features, SingleTree(), stopper=Stopper(2000, 20)).update_targets().expand_in_memory(1).trees[0]
    columns = {r["id"]: r for r in rows.withColumns({f"v_{f.name}": f.value() for f in features}).collect()}
    best = None
    for f in sorted(f.name for f in features):
        v = np.array([columns[k][f"v_{f}"] for k in range(200)])
        for cut in np.unique(v)[1:]:
            table = np.array([[((v < cut) == side)[y == k].sum() for k in (0, 1)] for side in (True, False)], float)
            expected = table.sum(axis=1)[:, None] * table.sum(axis=0)[None] / 200
            score = round(float(((table - expected) ** 2 / expected).sum()), 9)
            if best is None or score > best[0]:
                best = (score, f, T.Predicate("lt", float(cut)))
    assert (tree.feature, tree.predicate) == best[1:] and tree.feature == "e40"


def test_rows_without_a_label_count_nowhere(spark):
    rows = [(k, 0, None if k % 5 == 0 else "ab"[k % 2], 1.0, float(k % 7), "xyz"[k % 3]) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, ts long, label string, weight double, f double, g string")
    features = (Feature("f", "ordinal"), Feature("g", "nominal"))
    with_nulls, without = (Forest(d, features, KFold(2), stopper=Stopper(1, 1)) for d in (df, df.where("label is not null")))
    for grow in (lambda f: f.expand(local=True), lambda f: f.expand_in_memory(2)):
        assert grow(with_nulls.update_targets()).trees == grow(without.update_targets()).trees
    assert None not in T.target_of(with_nulls.update_targets().trees[0])


def exhaustive(rows, features, levels, minimum, goes_left):
    """A tree by trying every split of every feature on lists of rows; chi-squared, ties to the smaller feature and value."""
    target = {}
    for r in rows:
        target[r["label"]] = target.get(r["label"], 0.0) + r["weight"]
    if not levels or len(target) < 2 or sum(target.values()) <= minimum:
        return target
    best = None
    for f in sorted(features):
        own = [r for r in rows if r[f] is not None]
        for v in sorted({r[f] for r in own}):
            side = lambda r: r[f] < v if features[f] else r[f] == v  # noqa: E731, B023
            sums = [{k: sum(r["weight"] for r in own if r["label"] == k and side(r) == s) for k in {r["label"] for r in own}} for s in (True, False)]
            n = [sum(x.values()) for x in sums]
            if min(n) <= 0:
                continue
            expected = lambda k, s: (sums[0][k] + sums[1][k]) * n[s] / sum(n)  # noqa: E731, B023
            score = round(sum((sums[s][k] - expected(k, s)) ** 2 / expected(k, s) for s in (0, 1) for k in sums[0]), 9)
            if best is None or score > best[0]:
                best = (score, f, v, side)
    if best is None:
        return target
    _, f, v, side = best
    left = [r for r in rows if (goes_left(r) if r[f] is None else side(r))]
    right = [r for r in rows if not (goes_left(r) if r[f] is None else side(r))]
    return (f, v, exhaustive(left, features, levels - 1, minimum, goes_left), exhaustive(right, features, levels - 1, minimum, goes_left))


def plain(tree):
    return tree.target if isinstance(tree, T.Leaf) else (tree.feature, tree.predicate.value, plain(tree.left), plain(tree.right))


def test_growth_against_exhaustive_search(spark):
    import random

    rng = random.Random(3)
    rows = []
    for k in range(240):
        f, g = rng.choice([None, 1.0, 2.0, 3.0, 4.0]), rng.choice([None, "x", "y", "z"])
        label = "a" if (f or 0) > 2 and g != "x" or rng.random() < 0.2 else rng.choice("bc")
        rows.append({"id": k, "ts": 0, "label": label, "weight": float(rng.randint(1, 3)), "f": f, "g": g, "h": rng.choice([0.0, 1.0])})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, ts long, label string, weight double, f double, g string, h double")
    features = (Feature("f", "ordinal"), Feature("g", "nominal"), Feature("h", "ordinal"))
    forest = Forest(df, features, stopper=Stopper(1e9, 5)).update_targets()
    want = exhaustive(rows, {"f": True, "g": False, "h": True}, 3, 5, lambda r: True)
    assert plain(forest.expand_in_memory(3).trees[0]) == want
    assert plain(forest.expand(local=True).update_targets().expand(local=True).update_targets().expand(local=True).update_targets().trees[0]) == want


def test_order_of_missing_features_in_memory(spark):
    rows = [(k, 0, "ab"[k % 2], 1.0, None if k % 3 else float(k % 2)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, ts long, label string, weight double, f double")
    for order in ("depth", "random", "probabilistic"):
        grown = Forest(df, (Feature("f", "ordinal"),), stopper=Stopper(1000, 1), order=order).update_targets().expand_in_memory(1)
        assert isinstance(grown.trees[0], T.Node) and plain(grown.trees[0]) == plain(grown.update_targets().trees[0])


def test_samplers_of_ones_own_are_refused_in_memory(spark):
    class Odd(SingleTree):
        def feature(self, tree, node, name):
            return name == "f"

    rows = spark.createDataFrame([(1, 0, "a", 1.0, 1.0), (2, 0, "b", 1.0, 2.0)], "id long, ts long, label string, weight double, f double")
    with pytest.raises(ValueError, match="use expand"):
        Forest(rows, (Feature("f", "ordinal"),), Odd(), stopper=Stopper(1, 1)).update_targets().expand_in_memory(1)


def test_permutation_by_buckets_equals_one_sorted_group(spark):
    rows = [(k, 0, "ab"[k % 2], 1.0, float(k), None if k % 4 == 0 else str(k)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, ts long, label string, weight double, f double, g string")
    forest = Forest(df, (Feature("f", "continuous"), Feature("g", "nominal")))
    one, many = (sorted(tuple(r) for r in forest.permuted(10, buckets).select("id", "permuted", "f", F.coalesce("g", F.lit("none"))).collect()) for buckets in (1, 1024))
    assert one == many and len(one) == 490


def test_growth_in_memory_from_another_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
from sylva.operators.splitters import Feature
from sylva.operators.evaluate import Stopper
from sylva.plans.forest import Forest
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
rows = spark.createDataFrame([(k, 0, 'ab'[k % 2], 1.0, float(k % 2)) for k in range(20)], 'id long, ts long, label string, weight double, f double')
print('GROWN', Forest(rows, (Feature('f', 'ordinal'),), stopper=Stopper(100, 1)).update_targets().expand_in_memory(1).trees[0].feature)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert "GROWN f" in subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300).stdout


def test_stopper_counts_rows_without_the_feature_of_the_last_split(spark):
    # Left of x < 1 are 40 rows, of which 24 lack x: more than the stopper's 30 only with them.
    rows = [(k, 0, "ab"[k % 2] if k < 40 else "b", 1.0, None if k < 24 else float(k >= 40), float(k % 2)) for k in range(100)]
    df = spark.createDataFrame(rows, "id long, ts long, label string, weight double, x double, y double")
    whole, only_x = (Feature("x", "ordinal"), Feature("y", "ordinal")), (Feature("x", "ordinal"),)
    first = Forest(df, only_x, stopper=Stopper(30, 30)).update_targets().expand()
    assert first.partial and not first.update_targets().partial
    assert T.depth(Forest(df, whole, stopper=Stopper(30, 30), trees=first.trees, partial=True).expand().trees[0]) == 2
    again = first.expand_from(1, 1)
    assert sum(T.total(x.target) for x in T.leaves(again.trees[0])) == 100


def test_leaves_with_more_rows_than_a_task_takes_grow_from_all_of_them(spark):
    rng = np.random.default_rng(4)
    none = lambda v: None if rng.random() < 0.1 else v
    rows = [(k, 0, "abc"[int(rng.integers(3))], float(rng.integers(1, 3)), none(float(rng.integers(12))), none("xyz"[int(rng.integers(3))])) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, ts long, label string, weight double, f double, g string").cache()
    for sampler, order in ((KFold(2), "depth"), (RandomForest(2, 0.7), "random")):
        forest = Forest(df, (Feature("f", "ordinal"), Feature("g", "nominal")), sampler, stopper=Stopper(1e9, 20), order=order).update_targets()
        whole = forest.expand_in_memory(3)
        for most in (250, 1):
            assert {i: plain(t) for i, t in forest.expand_in_memory(3, max_rows=most).trees.items()} == {i: plain(t) for i, t in whole.trees.items()}


def test_voters_work_on_bounded_parts_and_shuffle_no_votes(spark, monkeypatch):
    monkeypatch.setattr("sylva.plans.forest.VOTE_ROWS", 100)
    df = spark.range(0, 1000, 1, 3).select("id", F.lit(0).alias("ts"), F.lit("a").alias("label"), F.lit(1.0).alias("weight"), (F.col("id") % 10).cast("double").alias("x"))
    trees = {i: T.Node("x", T.Predicate("lt", float(i)), T.Leaf(0, {"a": 3.0, "b": 1.0}), T.Leaf(1, {"b": 2.0})) for i in (3, 6)}
    forest = Forest(df, (Feature("x", "ordinal"),), KFold(2), trees=trees)
    cut = lambda votes: votes.select("id", "tree", "label", F.least("weight", F.lit(2.0)).alias("weight"))
    sums = lambda votes: votes.groupBy("id", "tree").agg(F.sum("weight").alias("value"))
    for voter in (voting.soft, voting.mode, voting.adapted(voting.soft, cut), voting.adapted(voting.mean, sums), lambda v: voting.combined(v, F.max("weight"))):
        found = forest.predict(df, voter)
        assert found.select("id").distinct().count() == 1000
        assert found.rdd.getNumPartitions() == 11
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_a_draw_is_hashed_once(rows):
    drawn = sampling.training_rows(rows.select("id", "weight"), RandomForest(2, 0.5))
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1  # not once for each term of the distribution
    want = rows.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("tree")).withColumn("w", RandomForest(2, 0.5).times(F.col("tree")).cast("double")).where("w > 0")
    assert sorted(map(tuple, drawn.select("id", "tree", "weight").collect())) == sorted(map(tuple, want.collect()))


def test_equal_counts_score_alike_however_many_rows_there_are(spark):
    rng = np.random.default_rng(6)
    left, every = [13.0, 15.0, 18.0, 14.0, 16.0], [1199871.0, 1200317.0, 1199011.0, 1200744.0, 1200057.0]
    cells = [(0, "s", "isEq", None, f"v{k}", "abcde"[i], left[i], every[i] - left[i]) for k in range(100) for i in rng.permutation(5)]
    df = spark.createDataFrame(cells, "tree int, feature string, op string, num double, str string, label string, lw double, rw double")
    scores = ChiSquared().evaluate(df.coalesce(1), ["tree"]).select(F.round("score", 9)).distinct().collect()
    n, lt = sum(every), sum(left)
    want = sum((l - b * lt / n) ** 2 / (b * lt / n) + (b * lt / n - l) ** 2 / (b * (n - lt) / n) for l, b in zip(left, every))
    assert len(scores) == 1 and abs(scores[0][0] - want) < 1e-8
